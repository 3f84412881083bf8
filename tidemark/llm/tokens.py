"""Byte-level BPE ids by the tokenizers library, each distinct word encoded once.

The pre-tokenizer of a byte-level BPE always starts a new piece at a space that stands alone between two
characters that aren't white space, and pieces are merged each by itself. So the ids of a text are those of its
stretches between such spaces, in order. Stretches recur: their ids are kept, up to `KEPT`, then those of long
ones are learnt anew.
A stretch of letters with a full stop, a comma or a line end is put together from its parts, which are pieces
of their own too. What looks like anything else goes to the library whole.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np

KEPT = 500_000
_LONG = 9
#: All white space but the space itself, as regular expressions have it.
_OTHER_SPACE = [chr(c) for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_ALPHA = re.compile(_LETTERS).fullmatch
_WORD = re.compile(f"({_LETTERS})([.,]?)(?:\n({_LETTERS})([.,]?))?")


def _crowded(text: str) -> bool:
    """Whether a space has white space beside it."""
    return "  " in text or any(c in text and (f"{c} " in text or f" {c}" in text) for c in _OTHER_SPACE[: 9 if text.isascii() else None])


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Texts to ids, as bytes of little-endian unsigned 32-bit integers.

    Strings of special tokens in a text are ordinary text. None counts as empty.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # The same model for words that are cut already and spelt in its alphabet, a letter for each byte.
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.alphabet = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(other)}
        self.alphabet[32] = " "
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.opens[k] = token.startswith("Ġ")
        self.spaced: dict[str, bytes] = {}  # ids of a stretch that follows a space, with that space
        self.bare: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space. Words are letters only, and so one piece each."""
        lines = []
        for k in range(0, len(words), 128):
            line = " ".join(words[k : k + 128])
            spelt = line if line.isascii() else line.encode().decode("latin-1").translate(self.alphabet)
            lines.append("Ġ" + spelt.replace(" ", " Ġ"))
        ids = np.array([k for e in self.merger.encode_batch_fast(lines, add_special_tokens=False) for k in e.ids], "<u4")
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(words):
            return self._ids([" " + w for w in words])
        data, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def _learn(self, parts: list[str]) -> None:
        made, rest, bare = [], [], {}
        plain = [p for p in parts if p.isalpha()]
        if not _ALPHA("".join(plain)):
            plain = [p for p in plain if _ALPHA(p)]
        words = dict.fromkeys(plain)
        for p in set(parts).difference(words):
            if m := _WORD.fullmatch(p):
                first, stop, word, end = m.groups()
                if first not in self.spaced:
                    words[first] = None
                for x in (stop, word, end):
                    if x and x not in self.bare:
                        bare[x] = None
                if len(first) < len(p):
                    made.append((p, first, stop, word, end))
            else:
                rest.append(p)
        if bare:
            bare["\n"] = None
            self.bare.update(zip(bare, self._ids(list(bare))))
        if words:
            self.spaced.update(zip(words, self._spaced(list(words))))
        if rest:
            self.spaced.update(zip(rest, self._ids([" " + p for p in rest])))
        for p, first, stop, word, end in made:
            tail = self.bare["\n"] + self.bare[word] if word else b""
            self.spaced[p] = self.spaced[first] + (self.bare[stop] if stop else b"") + tail + (self.bare[end] if end else b"")

    @staticmethod
    def _shorten(kept: dict[str, bytes]) -> None:
        """Drops the longer half or more: short words are those that come again."""
        by = Counter(map(len, kept))
        limit = room = 0
        while room + by[limit] <= KEPT // 2 and limit < _LONG:
            room += by[limit]
            limit += 1
        short = {p: ids for p, ids in kept.items() if len(p) < limit}
        kept.clear()
        kept.update(short)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.spaced) + len(self.bare) > KEPT:
            for kept in (self.spaced, self.bare):
                self._shorten(kept)
        if "\n" not in self.bare:
            self.bare["\n"] = self._ids(["\n"])[0]
        split = []
        for text in texts:
            text = text or ""
            if _crowded(text) or text[:1].isspace():
                head, *parts = _CUT.split(text)
            else:
                head, *parts = text.split(" ")
            if parts and parts[-1] == "":  # a text that ends with a space
                parts.pop()
                head, parts = (head, [*parts[:-1], parts[-1] + " "]) if parts else (head + " ", [])
            split.append((head, parts))
        known = self.spaced
        if new := set().union(*[parts for _, parts in split]).difference(known):
            self._learn(list(new))
        opening = self.bare
        if heads := {h for h, _ in split}.difference(opening):
            opening.update(zip(heads, self._ids(list(heads))))
        out = [opening[h] + b"".join(map(known.__getitem__, parts)) for h, parts in split]
        for kept, fresh in ((known, new), (opening, heads)):
            for p in fresh:
                if len(p) > _LONG:
                    kept.pop(p, None)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path)
