"""Null ids and texts, empty and blank ones, repeated rows, ties."""

ODD = [(None, "abc def"), (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (5, "a  b"), (6, "x" * 30000), (7, "é漢😀 1"), (None, None), (8, "a\x00b")]
