"""Document fingerprints as threshold-scaled sketches.

A sketch retains every hash of a five-word shingle below a fixed fraction of the hash range, so its size follows the
document and sketches of any two documents, however unequal, sample the same shingles: containment is read off the
shared hashes, and the sketch of a union is the union of sketches. The fraction is one half, so that a text of 20 words
keeps eight hashes or so, and all of those stand in the sketch of any text that contains it. A text none of whose
shingles (a few at most) lies below the threshold keeps them all, marked as such: it is compared with its equals, and is
no evidence against others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, shuffle_partitions

WORDS = 5
#: One in so many hashes is retained (a power of two).
SCALE = 2
_LAST = (1 << 63) - 1
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the shingles. Words are split at ASCII white space, A-Z lowered; fewer words are one shingle."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(t) for t in tokens], np.uint64)
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = h * _P + w[i : len(w) - k + 1 + i]
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def sketch(text: str | None, words: int = WORDS, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct retained hashes, 32 bits each: the first that the threshold leaves open. No words: none."""
    h = hashes(text, words) >> np.uint64(32)
    low = h[h < np.uint64((1 << 32) // scale)]
    return np.unique(low if len(low) else h).astype(np.uint32)


def _low(s: np.ndarray, scale: int) -> np.ndarray:
    return s[: np.searchsorted(s, (1 << 32) // scale)]


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated share of the smaller document's shingles that the other holds; two empty sketches are alike, an empty
    one and another are not. Where one has hashes above the threshold only, 1.0 if the sketches are equal, else 0.0."""
    la, lb = _low(a, scale), _low(b, scale)
    if not len(la) or not len(lb):
        return float(np.array_equal(a, b))
    return len(np.intersect1d(la, lb, assume_unique=True)) / min(len(la), len(lb))


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Sketch of two documents taken together (shingles that would span both aside)."""
    both = np.union1d(a, b)
    low = _low(both, scale)
    return low if len(low) else both


def to_text(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """(doc_id, fingerprint string): the sketch of each row's whole text as hex; '' for a null or blank text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_text(sketch(t, words, scale)) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _bucket(at: list[int], o: F.Column) -> F.Column:
    """Number of the sorted bounds ``at`` that are not above ``o``, by groups of bounds and then inside one group."""
    if not at:
        return F.lit(0)
    size = max(1, int(len(at) ** 0.5))
    groups = [at[i : i + size] for i in range(0, len(at), size)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    heads, all_ = longs([g[0] for g in groups[1:]] or [_LAST]), F.array(*[longs(g) for g in groups])
    before = F.size(F.filter(heads, lambda b: (b <= o) & F.lit(len(groups) > 1)))
    return (before * size + F.size(F.filter(F.element_at(all_, before + 1), lambda b: b <= o))).cast("int")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, turn, o, doc_id, text) such that, in the order of a partition, a document's next is the next row.

    Ids are cut into ranges by their quantiles; the first document of each range is also dealt, as turn 1, to the
    end of the range before it (of the first range: to the last). One shuffle of the texts, no range held whole.
    """
    spark = docs.sparkSession
    t = keyed(docs, id_col, text_col).withColumn("o", F.coalesce("doc_id", F.lit(_LAST)))
    n = shuffle_partitions(spark)
    at = sorted({int(x) for x in t.select("o").stat.approxQuantile("o", [i / (4 * n) for i in range(1, 4 * n)], 1 / (16 * n))})
    t = t.withColumn("bucket", _bucket(at, F.col("o")))
    firsts = sorted((r["bucket"], r["o"]) for r in t.groupBy("bucket").agg(F.min("o").alias("o")).collect())
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    entries = [x for b, o in firsts for x in (F.lit(b), F.struct(F.lit(o).cast("long").alias("o"), F.lit(before[b]).alias("to")))]
    first = F.element_at(F.create_map(*entries), F.col("bucket")) if entries else F.lit(None).cast("struct<o:bigint,to:int>")
    own = F.struct(F.col("bucket"), F.lit(0).alias("turn"))
    lent = F.struct(first["to"].alias("bucket"), F.lit(1).alias("turn"))
    t = t.withColumn("e", F.explode(F.when(first["o"] == F.col("o"), F.array(own, lent)).otherwise(F.array(own))))
    t = t.select("e.bucket", "e.turn", "o", "doc_id", "text")
    return t.repartition(n, "bucket").sortWithinPartitions("bucket", "turn", "o", F.xxhash64("text"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    (doc_id, n_chars long, edited_sha256, fingerprint, edited_fingerprint string, near_edited, near_next double).
    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document,
    in ascending doc_id (null last; rows of one id by hash of their text; after the last comes the first). Likeness
    is the estimated containment of the smaller in the larger (1.0 of equal texts, of two without words too). A null text counts as empty; of a single row the
    next is itself; an empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out: list[tuple] = []
            for bucket, turn, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                text = text or ""
                if last is not None and last[0] == bucket and last[1] == 1:
                    continue
                here = sketch(text, words, scale)
                if last is not None and last[0] == bucket:
                    _, _, its_id, its, fp = last
                    k = len(its) // 2
                    edited = its[: len(its) - k] + text[:k]
                    efp = sketch(edited, words, scale)
                    out.append((its_id, len(its), hashlib.sha256(edited.encode()).hexdigest(), to_text(fp), to_text(efp), containment(fp, efp, scale), containment(fp, here, scale)))
                last = (bucket, turn, doc_id, text, here)
            if out:
                cols = [list(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return with_next(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
