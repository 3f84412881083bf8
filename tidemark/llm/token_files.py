"""Token ids in binary files of bit-plane shuffled, compressed chunks.

A file holds the documents of one range of ids in ascending order. Their token ids are cut into chunks of
`CHUNK` ids whatever the documents' ends. Of a chunk, plane k holds byte (or bit) k of every id, and each plane
is compressed by itself with zstandard. Behind the chunks stands an index: where each plane starts, the
documents' ids and their numbers of tokens. A file is written to its end under a name of its own before its row
of the manifest exists, so that a task that is run again leaves at most a file that no manifest names.

    file  = "TMPLANE1" chunk* index length(index, 8 bytes) "TMPLANE1"
    chunk = plane 0, plane 1, ...           (zstandard frames)
    index = zstandard frame of JSON: {"width", "planes", "sizes" [of each plane of each chunk], "counts" [ids of
            each chunk]} then line end, then doc ids (null: a flag byte each), then token counts, as <i8 arrays
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, scratch, tidy
from tidemark.llm.tokens import encoder, vocabulary

CHUNK = 1 << 16
LEVEL = 3
END_ID = 2
_MAGIC = b"TMPLANE1"


def shuffled(ids: np.ndarray, width: int, planes: str) -> list[bytes]:
    """The planes of a chunk of `width`-byte ids."""
    raw = np.ascontiguousarray(ids.astype(f"<u{width}")).view(np.uint8).reshape(-1, width)
    if planes == "byte":
        return [raw[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def unshuffled(parts: list[bytes], n: int, width: int, planes: str) -> np.ndarray:
    """Ids, as unsigned 32-bit integers, of the planes of a chunk."""
    rows = [np.frombuffer(p, np.uint8) for p in parts]
    if planes == "bit":
        bits = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    else:
        raw = np.stack(rows, axis=1)
    return np.ascontiguousarray(raw).view(f"<u{width}").ravel().astype("<u4")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Writer:
    """Writes one file; holds one chunk of ids and 16 bytes a document."""

    def __init__(self, path: str, width: int, planes: str, chunk: int, level: int):
        import zstandard

        system, inner = _open(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out, self.width, self.planes, self.chunk = system.open_output_stream(inner), width, planes, chunk
        self.packer = zstandard.ZstdCompressor(level=level)
        self.waiting, self.n = [], 0
        self.sizes, self.counts, self.docs, self.lengths = [], [], [], []
        self.out.write(_MAGIC)

    def add(self, doc: int | None, ids: bytes) -> None:
        ids = np.frombuffer(ids, "<u4")
        if self.width < 4 and int(ids.max(initial=0)) >> 8 * self.width:
            raise ValueError(f"id {ids.max()} doesn't fit {self.width} bytes")
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n += len(ids)
        if self.n >= self.chunk:
            every = np.concatenate(self.waiting)
            whole = len(every) - len(every) % self.chunk
            for k in range(0, whole, self.chunk):
                self._put(every[k : k + self.chunk])
            self.waiting, self.n = [every[whole:]], len(every) - whole

    def _put(self, ids: np.ndarray) -> None:
        parts = [self.packer.compress(p) for p in shuffled(ids, self.width, self.planes)]
        self.sizes.append([len(p) for p in parts])
        self.counts.append(len(ids))
        for p in parts:
            self.out.write(p)

    def close(self) -> None:
        if self.n:
            self._put(np.concatenate(self.waiting))
        head = json.dumps({"width": self.width, "planes": self.planes, "sizes": self.sizes, "counts": self.counts, "docs": len(self.docs)}).encode()
        null = bytes(d is None for d in self.docs)
        index = self.packer.compress(head + b"\n" + null + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes())
        self.out.write(index + len(index).to_bytes(8, "little") + _MAGIC)
        self.out.close()


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file in order: (doc id, ids). Holds one chunk and the document at hand."""
    import zstandard

    system, inner = _open(path)
    unpack = zstandard.ZstdDecompressor().decompress
    with system.open_input_file(inner) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        if f.read_at(8, 0) != _MAGIC or tail[8:] != _MAGIC:
            raise ValueError(f"{path} isn't a whole token file")
        n = int.from_bytes(tail[:8], "little")
        head, _, data = unpack(f.read_at(n, size - 16 - n)).partition(b"\n")
        head = json.loads(head)
        k = head["docs"]
        null, docs, lengths = data[:k], np.frombuffer(data, "<i8", k, k), np.frombuffer(data, "<i8", k, 9 * k)
        at, chunks = 8, iter(zip(head["sizes"], head["counts"]))
        have = np.empty(0, "<u4")
        for absent, doc, length in zip(null, docs.tolist(), lengths.tolist()):
            parts, missing = [], length
            while missing > len(have):
                parts.append(have)
                missing -= len(have)
                sizes, count = next(chunks)
                data, planes = f.read_at(sum(sizes), at), []
                at += sum(sizes)
                for s in sizes:
                    planes.append(unpack(data[:s]))
                    data = data[s:]
                have = unshuffled(planes, count, head["width"], head["planes"])
            parts.append(have[:missing])
            have = have[missing:]
            yield None if absent else doc, parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocab: str | None = None, end_id: int | None = END_ID, width: int = 2, planes: str = "byte", chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """Encodes every row's text and writes files in ascending id order (null first, repeated ids by text).

    Returns the manifest in order: path, docs, tokens, start (tokens in the files before). Ids that `width` bytes
    can't hold are an error. A null text counts as empty; of an empty text there is only the
    end id. An empty table gives an empty manifest. Columns other than the two are not read.
    """
    vocab = vocab or vocabulary()
    slim = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))

    @tidy
    def write(batches):
        import pyarrow as pa

        encode, writer, at = encoder(vocab), None, None
        last = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(ids), 256):
                for d, found in zip(ids[k : k + 256], encode(texts.slice(k, 256).to_pylist())):
                    if writer is None:
                        at = f"{path}/part-{number:06d}-{uuid.uuid4().hex}.tok"
                        writer = Writer(at, width, planes, chunk, level)
                    writer.add(d, found + last)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int64()), "path": [at], "docs": pa.array([len(writer.docs)], pa.int64()), "tokens": pa.array([sum(writer.lengths)], pa.int64())})

    placed = slim.repartitionByRange("d").sortWithinPartitions("d", "t")
    files = cut(placed.mapInArrow(write, "number long, path string, docs long, tokens long"), "token-manifest")
    rows, start = [], 0
    for r in sorted(files.collect()):  # one row a file
        rows.append((r.path, r.docs, r.tokens, start))
        start += r.tokens
    return docs.sparkSession.createDataFrame(rows, "path string, docs long, tokens long, start long")


def read_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """What the files hold: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers) of each document."""
    return _read(spark, manifest, "doc_id long, start long, n_tokens long, ids binary", lambda ids: ids.tobytes())


def _read(spark: SparkSession, manifest: DataFrame, schema: str, made) -> DataFrame:
    files = [(r.path, r.start) for r in manifest.collect()]
    last = schema.split()[-2]

    @tidy
    def read(batches):
        import pyarrow as pa

        kind = pa.int64() if schema.endswith("long") else pa.binary()
        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, start = files[k]
                rows, held = [], 0
                for doc, ids in read_file(path):
                    rows.append((doc, start, len(ids), made(ids)))
                    start += len(ids)
                    held += len(ids)
                    if held > 1 << 20:
                        yield _batch(pa, rows, last, kind)
                        rows, held = [], 0
                if rows:
                    yield _batch(pa, rows, last, kind)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, schema)


def _batch(pa, rows, last, kind):
    columns = list(zip(*rows))
    names, kinds = ["doc_id", "start", "n_tokens", last], [pa.int64()] * 3 + [kind]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def op7_token_files(spark, sf_dir):
    """All documents as token files, read back: each document's place, length and checksum."""
    manifest = write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "tokens"))
    return _read(spark, manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()))
