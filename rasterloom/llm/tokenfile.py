"""Token ids of documents in files of independent zstandard frames with a seek table.

A file is a row of zstandard frames, each holding the ids of some whole documents as
little-endian unsigned 32-bit integers under zstandard's own content checksum, then a
skippable frame with the table of documents and the seek table, which is readable by
others: per frame its compressed size, its size and its CRC-32 (little-endian 32-bit),
then the number of frames, a descriptor byte and the magic 0x8F92EAB1. The table of
documents precedes it in a skippable frame of its own: per document doc_id, the frame it
is in, its first id within the frame and its number of ids. A reader takes the two tables
from the end of the file, and decompresses only the frames that hold what it was asked for.

Texts are encoded with the tokenizers library. A chunk of text between single spaces or
line feeds that stand between other signs is encoded by itself and kept: the pattern that
splits text before the merges always splits there, so the ids are those of the whole text.
Kept chunks are looked up by a hash and compared byte by byte; one that only shares a hash
is encoded anew.

Defined results: a null text is empty and holds the end id alone; null doc_ids come first;
repeated rows are written each; an empty table makes no file and an empty result.
"""

from __future__ import annotations

import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.scratch import Scratch
from rasterloom.llm.words import LONG_SPAN, MASKS, eights, span_hashes, text_chunks

END = 2
#: Ids in a frame, about; a longer document has a frame of its own.
FRAME_IDS = 1 << 16
#: Chunks of text whose ids a worker keeps (about 50 bytes each); the first ones met, which hold the frequent ones.
KEPT = 1_000_000
_SKIP_DOCS, _SKIP_SEEK, _SEEK_MAGIC = 0x184D2A5C, 0x184D2A5E, 0x8F92EAB1
_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "<u4"), ("frame", "<u4"), ("first", "<u8"), ("n", "<u8")])


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The contents of a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


_LOW = np.arange(256) < 0x21
_LEADS = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))
_LEADS3 = np.isin(np.arange(256), (0xE1, 0xE2, 0xE3))


def cut_points(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places at which text can be cut without changing its ids: before a single space, around a single line feed."""
    n = len(data)
    low, out = _LOW[data], np.zeros(n + 1, bool)
    alone = (data == 0x20) | (data == 0x0A)
    alone[:1] = alone[-1:] = False
    texts = off[(off > 0) & (off < n)]
    alone[texts] = alone[texts - 1] = False
    alone[1:] &= ~low[:-1]
    alone[:-1] &= ~low[1:]
    # signs of two or three bytes that are white space begin with C2, E1, E2 or E3: no cut beside any such sign
    alone[:-1] &= ~_LEADS[data[1:]]
    alone[2:] &= data[:-2] != 0xC2
    alone[3:] &= ~_LEADS3[data[:-3]]
    out[:n] = alone
    feeds = np.flatnonzero(alone & (data == 0x0A))
    out[feeds + 1] = True
    out[off] = True
    return np.flatnonzero(out[:n])


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and for every place its value's rank."""
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], order[new], inverse


class Encoder:
    """Ids of texts; keeps the ids of the chunks of text it has met."""

    def __init__(self, vocab: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocab)
        self.tokenizer.encode_special_tokens = True
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted hashes
        self.row = np.empty(0, np.int64)  # of each, its row below
        self.first, self.length, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self.at, self.size, self.bytes = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(8, np.uint8)  # eight more than are used

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and how many each has.

        Pieces without white space but for a space in front go through the tokenizer as
        one text of lines: a line feed between them is a token of its own.
        """
        plain = np.fromiter((p.lstrip(" ").split() == [p[p[0] == " " :]] for p in pieces), bool, len(pieces))
        lines = [p for p, x in zip(pieces, plain, strict=True) if x]
        found = self.tokenizer.encode_batch_fast(["\n".join(lines)] + [p for p, x in zip(pieces, plain, strict=True) if not x], add_special_tokens=False)
        flat = np.array(found[0].ids, np.uint32)
        stops = np.flatnonzero(flat == self.feed)
        if len(stops) != max(len(lines) - 1, 0):
            raise RuntimeError("the tokenizer joined lines")
        length = np.empty(len(pieces), np.int64)
        length[plain] = np.diff(np.concatenate([[-1], stops, [len(flat)]]))[: len(lines)] - 1
        rest = [np.array(e.ids, np.uint32) for e in found[1:]]
        length[~plain] = [len(x) for x in rest]
        first = np.cumsum(length) - length
        out = np.empty(int(length.sum()), np.uint32)
        of_plain = np.repeat(plain, length)
        out[of_plain] = flat[flat != self.feed]
        if rest:
            out[~of_plain] = np.concatenate(rest)
        return out, first

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        flat, first = self._ids([p.decode("utf-8", "replace") for p in pieces])
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.at, self.size = np.concatenate([self.at, len(self.bytes) - 8 + np.cumsum(size) - size]), np.concatenate([self.size, size])
        self.bytes = np.concatenate([self.bytes[:-8], np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)])
        length = np.diff(np.append(first, len(flat)))
        self.row = np.concatenate([self.row, len(self.first) + np.arange(len(pieces))])
        self.first, self.length, self.ids = np.concatenate([self.first, first + len(self.ids)]), np.concatenate([self.length, length]), np.concatenate([self.ids, flat])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known)
        self.known, self.row = known[order], self.row[order]

    def _forget(self, kept: int) -> None:
        """Keep the first pieces that were met, which include the frequent ones."""
        old = self.row < kept
        self.known, self.row = self.known[old], self.row[old]
        self.first, self.length, self.at, self.size = self.first[:kept], self.length[:kept], self.at[:kept], self.size[:kept]
        self.bytes = self.bytes[: int(self.at[-1] + self.size[-1]) + 8].copy() if kept else np.zeros(8, np.uint8)
        self.ids = self.ids[: int(self.first[-1] + self.length[-1])].copy() if kept else self.ids[:0]

    def _unlike(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which chunks have other bytes than their kept row, eight bytes at a time."""
        size, at = ends - starts, self.at[row]
        unlike = self.size[row] != size
        own, kept = eights(np.concatenate([data, np.zeros(8, np.uint8)])), eights(self.bytes)
        rest, k = np.flatnonzero(~unlike & (size <= LONG_SPAN)), 0
        while len(rest):
            differ = ((own[starts[rest] + k] ^ kept[at[rest] + k]) & MASKS[np.minimum(size[rest] - k, 8)]) != 0
            unlike[rest[differ]] = True
            k += 8
            rest = rest[~differ & (size[rest] > k)]
        for i in np.flatnonzero(~unlike & (size > LONG_SPAN)):
            unlike[i] = not np.array_equal(data[starts[i] : ends[i]], self.bytes[at[i] : at[i] + size[i]])
        return np.flatnonzero(unlike)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts without end ids, and each text's first."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        starts = cut_points(data, off)
        ends = np.append(starts[1:], len(data))
        uniq, at, inverse = distinct(span_hashes(data, starts, ends, fold=False))
        place = np.minimum(np.searchsorted(self.known, uniq), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[place] != uniq) if len(self.known) else np.arange(len(uniq))
        if len(new):
            text = data.tobytes()
            self._learn(uniq[new], [text[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        row = self.row[np.searchsorted(self.known, uniq)][inverse]
        length, first, ids = self.length[row], self.first[row], self.ids
        for k in self._unlike(data, starts, ends, row):
            own = np.array(self.tokenizer.encode(data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            length[k], first[k], ids = len(own), len(ids), np.concatenate([ids, own])
        upto = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=upto[1:])
        out = ids[np.repeat(first - upto[:-1], length) + np.arange(upto[-1])]
        if len(self.first) > KEPT:
            self._forget(KEPT)
        return out, upto[np.searchsorted(starts, off)]


def worker_encoder(vocab: str) -> Encoder:
    """The encoder of this worker process: a later task in the same process finds the chunks that earlier ones met."""
    state = sys.modules.setdefault("_token_encoder", types.ModuleType("_token_encoder"))
    if getattr(state, "vocab", None) != hash(vocab):
        state.encoder, state.vocab = Encoder(vocab), hash(vocab)
    return state.encoder


def pack(doc_ids: list[int | None], ids: list[np.ndarray], frame_ids: int = FRAME_IDS) -> bytes:
    """A whole file."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    frames, table, seek, waiting, held = [], np.zeros(len(ids), _DOC), [], [], 0

    def close() -> None:
        nonlocal waiting, held
        raw = b"".join(waiting)
        frames.append(z.compress(raw))
        seek.append((len(frames[-1]), len(raw), zlib.crc32(raw)))
        waiting, held = [], 0

    for i, (d, x) in enumerate(zip(doc_ids, ids, strict=True)):
        if held and held + len(x) > frame_ids:
            close()
        table[i] = (d or 0, d is not None, len(frames), held, len(x))
        waiting.append(np.asarray(x, "<u4").tobytes())
        held += len(x)
    if waiting:
        close()
    docs = table.tobytes()
    out = [*frames, struct.pack("<II", _SKIP_DOCS, len(docs) + 8), docs, struct.pack("<Q", len(table))]
    body = b"".join(struct.pack("<III", *x) for x in seek) + struct.pack("<IBI", len(seek), 0x80, _SEEK_MAGIC)
    return b"".join([*out, struct.pack("<II", _SKIP_SEEK, len(body)), body])


class Reader:
    """Reads a file's documents; decompresses a frame only when a document in it is asked for, and checks it."""

    def __init__(self, data: bytes):
        n, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != _SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        at = len(data) - 9 - 12 * n
        self.seek = np.frombuffer(data, "<u4", 3 * n, at).reshape(n, 3)
        at -= 8
        (docs,) = struct.unpack_from("<Q", data, at - 8)
        self.docs = np.frombuffer(data, _DOC, docs, at - 8 - docs * _DOC.itemsize)
        self.starts = np.concatenate([[0], np.cumsum(self.seek[:, 0].astype(np.int64))])
        self.data, self.opened, self._frame = data, 0, (-1, None)

    def __len__(self) -> int:
        return len(self.docs)

    def frame(self, k: int) -> np.ndarray:
        import zstandard

        if self._frame[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self.data[self.starts[k] : self.starts[k + 1]])
            if len(raw) != self.seek[k, 1] or zlib.crc32(raw) != self.seek[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self._frame = (k, np.frombuffer(raw, "<u4"))
            self.opened += 1
        return self._frame[1]

    def doc(self, i: int) -> tuple[int | None, np.ndarray]:
        x = self.docs[i]
        return (int(x["doc_id"]) if x["has_id"] else None), self.frame(int(x["frame"]))[int(x["first"]) : int(x["first"] + x["n"])]

    def find(self, doc_id: int) -> np.ndarray | None:
        i = np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["has_id"] == 1))
        return self.doc(int(i[0]))[1] if len(i) else None


#: Documents and ids that a file holds at most, about.
FILE_IDS = 1 << 21
_WRITTEN = "part int, seq int, file string, docs long, ids long"


def write(spark: SparkSession, docs: DataFrame, folder: str, vocab: str, end: int = END) -> DataFrame:
    """Write the files under folder in ascending doc_id order; a row per file: part, seq, file, docs, ids.

    A file's name holds a random part, so an attempt that is run again writes its own
    files, and the returned table, once it is saved, names the files that count.
    """
    shared = spark.sparkContext.broadcast(vocab)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyarrow import fs

        part, seq, encoder = TaskContext.get().partitionId(), 0, worker_encoder(shared.value)
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held
            at, path = fs.FileSystem.from_uri(f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.zst")
            at.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with at.open_output_stream(path, compression=None) as f:
                f.write(pack(names, ids))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [path.rsplit("/", 1)[1]], "docs": [len(names)], "ids": [held]})
            names.clear(), ids.clear()
            seq, held = seq + 1, 0
            return row

        for b in batches:
            for i, j, data, off in text_chunks(b.column("text")):
                flat, first = encoder.encode(data, off)
                for k, d in enumerate(b.column("doc_id").slice(i, j - i).to_pylist()):
                    ids.append(np.append(flat[first[k] : first[k + 1]], np.uint32(end)))
                    names.append(d)
                    held += len(ids[-1])
                if held >= FILE_IDS:
                    yield close()
        if names:
            yield close()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return rows.mapInArrow(encode, _WRITTEN)


def read_back(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per document of the files in the table: doc_id, start, n_tokens, ids_crc32, from the files alone.

    Only (file, first id) pairs, a row per file, meet in one window.
    """
    from pyspark.sql import Window

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, first in zip(b.column("content"), b.column("first").to_pylist(), strict=True):
                r = Reader(data.as_py())
                names, counts, crcs = [], np.empty(len(r), np.int64), np.empty(len(r), np.int64)
                for i in range(len(r)):
                    d, x = r.doc(i)
                    names.append(d)
                    counts[i], crcs[i] = len(x), zlib.crc32(x.tobytes())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64()), "start": first + np.cumsum(counts) - counts, "n_tokens": counts, "ids_crc32": crcs})

    return raw.join(F.broadcast(starts) if files.count() <= 100_000 else starts, "file").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_report(spark: SparkSession, docs: DataFrame, vocab: str) -> DataFrame:
    """Write all documents and read the files back."""
    scratch = Scratch(spark, "tokens")
    folder = scratch.folder("files")
    files = scratch.save(write(spark, docs, folder, vocab), "written")
    if not files.count():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_back(spark, folder, files)
