"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over eight bytes cuts texts where their content says so, hence copies and shared passages are cut alike
wherever they stand. Chunks are counted by digest over all documents. A chunk that stands more than once is encoded
once, in a table of shared chunks, and its ids are joined to every document that holds it; a chunk that stands once is
encoded where it is read. A cut may fall inside a word, so every join of chunks is repaired: the text around it is
encoded again between two places where any segmentation has a boundary (a visible ASCII character, then a space and a
visible ASCII character), and the window grows over whole chunks until both of its ends agree with token ends of the
chunks.

Which chunks are shared is told to the readers by a bitmap of fixed size. A false hit costs a row in the table of
shared chunks and nothing else. Documents without a shared chunk are encoded where they are read and never shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialise

#: Pattern that splits text before merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Mean distance of cuts in bytes, and bits of the map of shared chunks (both powers of two).
CHUNK = 1024
MAP_BITS = 1 << 26
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAFE = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: bytes, mean: int = CHUNK) -> list[int]:
    """Places inside ``data`` where a chunk ends; made of the eight bytes before them, never inside a character."""
    if len(data) < 16:
        return []
    padded = np.frombuffer(data + bytes(16 - len(data) % 8), np.uint8)
    grams = np.lib.stride_tricks.as_strided(padded.view("<u8"), (len(data) - 7,), (1,), writeable=False)
    hits = np.flatnonzero((grams * _MIX) >> np.uint64(64 - (mean.bit_length() - 1)) == 0) + 8
    out = []
    for c in hits.tolist():
        while c < len(data) and data[c] & 0xC0 == 0x80:
            c += 1
        if c < len(data) and (not out or c > out[-1]):
            out.append(c)
    return out


class Encoder:
    """The vocabulary of ``path``; :meth:`encode` and :meth:`decode` whole texts."""

    def __init__(self, path: str, mean: int = CHUNK):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of_char = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(of_char[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token.encode() not in self.special}
        self.table = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for token, i in [*ranks.items(), *self.special.items()]:
            self.table[i] = token
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self._ordinary = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._split = re.compile(b"(" + b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self.mean, self.encoded = mean, 0
        self.kind = "<u2" if len(self.table) <= 1 << 16 else "<u4"

    def _plain(self, data: bytes) -> list[int]:
        self.encoded += len(data)
        if self._split is None or not any(s in data for s in self.special):
            return self._ordinary(data.decode())
        ids: list[int] = []
        for part in self._split.split(data):
            ids += [self.special[part]] if part in self.special else self._ordinary(part.decode())
        return ids

    def chunk(self, data: bytes) -> np.ndarray:
        """Ids of one chunk on its own."""
        return np.array(self._plain(data), np.uint32)

    def encode(self, data: bytes, known: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """Ids of a whole UTF-8 text; ``known`` has the ids of some of its chunks by number."""
        at, known = cuts(data, self.mean), known or {}
        if not at:
            return known[0] if 0 in known else self.chunk(data) if data else np.empty(0, np.uint32)
        edges = [0, *at, len(data)]
        out: list[np.ndarray] = []
        ids, ends = self._with_ends(data, 0, edges[1], known.get(0))
        for k in range(1, len(edges) - 1):
            cut, stop = edges[k], edges[k + 1]
            right, right_ends = self._with_ends(data, cut, stop, known.get(k))
            left = self._last_safe(data, int(ends[0]) if len(ends) else cut, cut, ends)
            place = self._first_safe(data, cut, stop, right_ends)
            if left is None or place is None:  # no agreement inside: one window over what is pending and this chunk
                start = int(ends[0] - self.lengths[ids[0]]) if len(ids) else cut
                ids = self.chunk(data[start:stop])
                ends = start + np.cumsum(self.lengths[ids])
                continue
            i, j = int(np.searchsorted(ends, left, "right")), int(np.searchsorted(right_ends, place, "right"))
            out += [ids[:i], self.chunk(data[left:place])]
            ids, ends = right[j:], right_ends[j:]
        out.append(ids)
        return np.concatenate(out)

    def _with_ends(self, data: bytes, start: int, stop: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        ids = self.chunk(data[start:stop]) if known is None else known
        return ids, start + np.cumsum(self.lengths[ids])

    @staticmethod
    def _last_safe(data: bytes, low: int, cut: int, ends: np.ndarray) -> int | None:
        """The last place before ``cut`` that is safe and ends a token of the left chunk."""
        at = data.rfind(b" ", low, cut - 1)
        while at > 0:
            if _SAFE.match(data, at):
                k = int(np.searchsorted(ends, at))
                if k < len(ends) and ends[k] == at:
                    return at
            at = data.rfind(b" ", low, at)
        return None

    @staticmethod
    def _first_safe(data: bytes, cut: int, stop: int, ends: np.ndarray) -> int | None:
        """The first safe place after ``cut`` that ends a token of the right chunk."""
        found = _SAFE.search(data, cut + 1, stop)
        while found:
            k = int(np.searchsorted(ends, found.start()))
            if k < len(ends) and ends[k] == found.start():
                return found.start()
            found = _SAFE.search(data, found.end(), stop)
        return None

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.table
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def chunks(data: bytes, mean: int = CHUNK) -> list[tuple[int, int, bytes]]:
    """(first and second half of the digest, bytes) of the chunks of a text."""
    edges = [0, *cuts(data, mean), len(data)]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = data[a:b]
        digest = xxhash.xxh3_128_digest(part)
        out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), part))
    return out


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, hs, ks, c1, c2 = [], [], [], [], []
        for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            for k, (x, y, _) in enumerate(chunks(t) if t else ()):
                ids.append(i)
                hs.append(h)
                ks.append(k)
                c1.append(x)
                c2.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(ks, pa.int32()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64())], names=["doc_id", "h", "k", "c1", "c2"])


_ROW_BITS = 1 << 13


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for bits in b.column(1).to_pylist():
            row = np.zeros(_ROW_BITS, bool)
            row[bits] = True
            out.append(np.packbits(row, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["at", "bits"])


def shared_map(shared: DataFrame) -> bytes:
    """Bitmap of MAP_BITS bits with those of the digests in ``shared`` set; at most that size comes to the driver."""
    place = F.pmod("c1", F.lit(MAP_BITS))
    rows = shared.select(F.floor(place / _ROW_BITS).alias("at"), F.pmod(place, F.lit(_ROW_BITS)).cast("int").alias("bit"))
    rows = rows.groupBy("at").agg(F.collect_set("bit").alias("bits")).mapInArrow(_packed, "at long, bits binary")
    out = np.zeros(MAP_BITS // 8, np.uint8).reshape(-1, _ROW_BITS // 8)
    for r in rows.collect():
        out[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _hit(bits: bytes, c1: int) -> bool:
    at = c1 % MAP_BITS
    return bool(bits[at >> 3] >> (at & 7) & 1)


def _each(docs: DataFrame, path: str, id_col: str, text_col: str, finish, names: list[str], kinds: list, shape: str) -> DataFrame:
    """Rows ``finish(encoder, ids)`` of every document, shared chunks encoded once."""
    t = keyed(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), "text")
    table = materialise(t.mapInArrow(_chunk_rows, "doc_id long, h long, k int, c1 long, c2 long"), "chunks")
    shared = table.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2")
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(shared_map(shared))

    def texts(batches):
        for b in batches:
            found = {(x, y): part for d in b.column(2).cast(pa.binary()).to_pylist() if d for x, y, part in chunks(d) if _hit(bits.value, x)}
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.binary())], names=["c1", "c2", "part"])

    def once(batches):
        enc = encoder(path)
        for b in batches:
            ids = [enc.chunk(part).astype(enc.kind).tobytes() for part in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["c1", "c2", "ids"])

    def rows(enc, ids, done):
        cols = list(zip(*done, strict=True)) if done else [()] * (len(names) - 1)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=names)

    def alone(batches):
        enc = encoder(path)
        for b in batches:
            data = b.column(2).cast(pa.binary()).to_pylist()
            own = [i for i, d in enumerate(data) if not d or not any(_hit(bits.value, x) for x, _, _ in chunks(d))]
            yield rows(enc, b.column(0).take(pa.array(own, pa.int64())), [finish(enc, enc.encode(data[i] or b"")) for i in own])

    def holders(batches):
        for b in batches:
            data = b.column(2).cast(pa.binary()).to_pylist()
            yield b.take(pa.array([i for i, d in enumerate(data) if d and any(_hit(bits.value, x) for x, _, _ in chunks(d))], pa.int64()))

    def joined(batches):
        enc = encoder(path)
        for b in batches:
            done = []
            for d, given in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                known = {g["k"]: np.frombuffer(g["ids"], enc.kind).astype(np.uint32) for g in given or ()}
                done.append(finish(enc, enc.encode(d, known)))
            yield rows(enc, b.column(0), done)

    parts = t.mapInArrow(texts, "c1 long, c2 long, part binary").groupBy("c1", "c2").agg(F.first("part").alias("part"))
    coded = materialise(parts.mapInArrow(once, "c1 long, c2 long, ids binary"), "shared-chunks")
    given = table.join(coded, ["c1", "c2"]).groupBy(F.col("doc_id").alias("kd"), F.col("h").alias("kh")).agg(F.collect_list(F.struct("k", "ids")).alias("given"))
    held = t.mapInArrow(holders, "doc_id long, h long, text string")
    held = held.join(given, F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("h") == F.col("kh")), "left").select("doc_id", "text", "given")
    return t.mapInArrow(alone, shape).union(held.mapInArrow(joined, shape))


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, ids array<int>) for each row; a null text is encoded as an empty one, with no ids."""
    return _each(docs, vocabulary or default_vocabulary(), id_col, text_col, lambda enc, ids: (ids.astype(np.int32),), ["doc_id", "ids"], [pa.list_(pa.int32())], "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id long, text string) of rows (doc_id, ids); null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = [enc.decode(np.array(i or [], np.int64)).decode() for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, ids_sha256 string, decoded_sha256 string): each text encoded and decoded.

    ``ids_sha256`` is of the ids as little-endian unsigned 32-bit integers. Null texts count as empty; repeated rows
    are kept; texts of any length are encoded whole; extra columns are ignored; an empty table gives no rows.
    """

    def digests(enc: Encoder, ids: np.ndarray) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()

    names, kinds = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]
    return _each(docs, vocabulary or default_vocabulary(), id_col, text_col, digests, names, kinds, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
