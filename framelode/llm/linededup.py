"""Line dedup by a deletion-neighbourhood join.

A line is removed if an earlier line (by doc_id, hash of the text, place in it; judged on the input) is equal after
normalising, or within one edit of whole words (a word replaced, inserted or left out) when both have at least
``min_words`` words, so that they stay at least 0.8 alike. Blank lines always stay.

Equal lines are reduced to one row with its earliest place before anything is shuffled on. For edits, every line would
emit all variants with one word deleted; two cheaper keys decide which lines need to. One edit leaves either the first
half of a line or its last half alone, so a line that shares neither half with another line has no neighbour at this
bound and emits nothing (this loses no pair). The others emit their deletion variants as hashed keys:

* two lines that give the same variant by deleting the same place differ in that word only;
* a line that equals another's variant differs by the word deleted there.

Within a variant only the earliest place counts, so a variant costs one minimum, not its pairs. Each removal is then
verified: the line and its earliest witness are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed, materialise, small_batches

MIN_WORDS = 5
_PLACE = "struct<doc_id:bigint,h:bigint,line:int>"
#: Lines to look up in their documents up to which their places (under 100 bytes each) are broadcast.
FEW_LINES = 200_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normalise(line: str) -> list[str]:
    return line.casefold().split()


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether at most one word is replaced, inserted or left out between ``a`` and ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def halves(words: list[str]) -> list[int]:
    """Hashes of the first and last words of a line at which it must meet any line within one edit."""
    out = []
    for k in {len(words) // 2, (len(words) - 1) // 2} - {0}:
        for side, part in ((b"<", words[:k]), (b">", words[-k:])):
            out.append(xxhash.xxh3_64_intdigest(side + str(k).encode() + b" " + " ".join(part).encode()) - (1 << 63))
    return out


def _lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs, nos, digests, keys = [], [], [], [], []
            for k, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for no, line in enumerate(t.split("\n") if t else ()):
                    if words := normalise(line):
                        ids.append(k)
                        hs.append(h)
                        nos.append(no)
                        digests.append(xxhash.xxh3_128_digest(" ".join(words).encode()))
                        keys.append(halves(words) if len(words) >= min_words else None)
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(nos, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "line", "d1", "d2", "halves"])

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d1, d2, v1, v2, spot): spot -1 is the line as it is, others the place of the word left out."""
    for b in batches:
        d1, d2, v1, v2, spots = [], [], [], [], []
        for x, y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            w = np.array([xxhash.xxh3_64_intdigest(t) for t in text.split(" ")], np.uint64)
            n = len(w)
            # polynomial hashes of all the words and of all but one, for two bases
            for base, out in ((_P, v1), (_Q, v2)):
                power = np.cumprod(np.full(n, base))
                ahead = np.concatenate([[np.uint64(0)], np.cumsum(w * power)])
                # left out at i: words before i keep their powers, later ones take the power before theirs
                shifted = np.concatenate([[np.uint64(0)], np.cumsum(w[1:] * power[:-1])])
                out.append(np.concatenate([ahead[-1:], ahead[:-1] + (shifted[-1] - shifted)]).view(np.int64))
            d1.append(np.full(n + 1, x))
            d2.append(np.full(n + 1, y))
            spots.append(np.arange(-1, n, dtype=np.int32))
        if d1:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (d1, d2, v1, v2, spots)], names=["d1", "d2", "v1", "v2", "spot"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [within_one(x.split(" "), y.split(" ")) for x, y in zip(b.column("text").to_pylist(), b.column("its").to_pylist(), strict=True)]
        yield b.filter(pa.array(ok, pa.bool_())).select(["d1", "d2", "witness"])


def _near(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(d1, d2, witness place): lines with an earlier line within one edit, and the earliest of those; a written table."""
    keys = lines.where("halves IS NOT NULL").select("d1", F.explode("halves").alias("half"))
    # aggregates are written before they are joined to the rows they are of, so that Spark can split a hot key
    shared = materialise(keys.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), "shared-halves")
    alike = keys.join(shared, "half").select("d1").distinct()
    chosen = materialise(lines.join(alike, "d1", "left_semi").select("d1", "d2", "first"), "alike")
    discard(shared)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1, d2, out = [], [], []
            for t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = t.split("\n")
                for x in want:
                    d1.append(x["d1"])
                    d2.append(x["d2"])
                    out.append(" ".join(normalise(own[x["line"]])))
            yield pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(out, pa.string())], names=["d1", "d2", "text"])

    where = chosen.groupBy(F.col("first.doc_id").alias("k"), F.col("first.h").alias("kh")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "d1", "d2")).alias("want"))
    if chosen.count() <= FEW_LINES:
        where = F.broadcast(where)
    found = docs.join(where, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh"))).select("text", "want").mapInArrow(texts, "d1 long, d2 long, text string")
    # rows that repeat id and text give a line more than once
    told = materialise(found.dropDuplicates(["d1", "d2"]), "alike-text")
    every = materialise(told.mapInArrow(_variants, "d1 long, d2 long, v1 long, v2 long, spot int"), "every-variant")
    meeting = materialise(every.groupBy("v1").agg(F.count("*").alias("n")).where("n > 1").select("v1"), "meeting")
    v = materialise(every.join(meeting, "v1").join(chosen, ["d1", "d2"]), "line-variants")
    discard(every, meeting)
    low = materialise(v.groupBy("v1", "v2", "spot").agg(F.min(F.struct("first", "d1", "d2")).alias("low")), "lowest")
    whole, less = low.where("spot = -1").select("v1", "v2", F.col("low").alias("w")), low.where("spot >= 0").groupBy("v1", "v2").agg(F.min("low").alias("l"))
    meet = whole.join(less, ["v1", "v2"])
    same = v.where("spot >= 0").join(low, ["v1", "v2", "spot"])
    as_whole = v.where("spot = -1").join(meet.select("v1", "v2", F.col("l").alias("low")), ["v1", "v2"])
    as_less = v.where("spot >= 0").join(meet.select("v1", "v2", F.col("w").alias("low")), ["v1", "v2"])
    cols = ["d1", "d2", "first", "low"]
    pairs = same.select(cols).union(as_whole.select(cols)).union(as_less.select(cols)).where("low.first < first")
    pairs = pairs.groupBy("d1", "d2").agg(F.min("low").alias("low")).select("d1", "d2", F.col("low.d1").alias("w1"), F.col("low.d2").alias("w2"), F.col("low.first").alias("witness"))
    checked = pairs.join(told, ["d1", "d2"]).join(told.select(F.col("d1").alias("w1"), F.col("d2").alias("w2"), F.col("text").alias("its")), ["w1", "w2"])
    near = materialise(checked.select("d1", "d2", "text", "its", "witness").mapInArrow(_verified, f"d1 long, d2 long, witness {_PLACE}"), "near")
    discard(chosen, told, v, low)
    return near


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, line int, first_doc_id long, first_line int, near boolean), a row for each line to remove.

    ``line`` counts from 0; ``first_*`` is the earliest equal line, or for the earliest of equal lines (``near``) its
    earliest neighbour. ``h`` is xxhash64 of the text and tells rows of one id apart; rows that repeat both are one
    document. Rows without an id rank before all others. Null and blank texts have no lines to remove.
    """
    return _repeated(docs, id_col, text_col, min_words)[0]


def _repeated(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result of :func:`repeated_lines` and the written tables that it reads."""
    docs = keyed(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = materialise(docs.select("doc_id", "h", "text").mapInArrow(_lines(min_words), "doc_id long, h long, line int, d1 long, d2 long, halves array<bigint>"), "all-lines")
    place = F.struct("doc_id", "h", "line")
    lines = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(F.xxhash64(place)).alias("x"), F.min(F.xxhash64(place)).alias("y"), F.first("halves").alias("halves"))
    lines = materialise(lines.select("d1", "d2", "first", (F.col("x") != F.col("y")).alias("many"), "halves"), "lines")
    near = _near(lines, docs)
    marks = materialise(lines.where("many").select("d1", "d2", "first").join(near, ["d1", "d2"], "full"), "marks")
    discard(lines, near)
    again = found.select("d1", "d2", place.alias("place")).join(marks, ["d1", "d2"])
    again = again.where("first IS NULL OR witness IS NOT NULL OR NOT (place <=> first)")
    is_near = F.col("first").isNull() | F.col("place").eqNullSafe(F.col("first"))
    to = F.when(is_near, F.col("witness")).otherwise(F.col("first"))
    again = again.select("place.doc_id", "place.h", "place.line", to["doc_id"].alias("first_doc_id"), to["line"].alias("first_line"), is_near.alias("near"))
    return again, [found, marks]


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, all columns, without the lines to remove.

    A document that loses its last line that isn't blank goes; one that had none from the start, or a null text,
    stays as it is. ``n_chars``, if there is such a column, is counted anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, gone in zip(b.column("its_text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                if gone and t is not None:
                    away = set(gone)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in away)
                    t = t if t.strip() else None
                out.append(t)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "gone")), pa.array(out, pa.string())], names=["row", "gone", "its_text"])

    small_batches(docs.sparkSession)
    again, read = _repeated(docs, id_col, text_col, min_words)
    gone = materialise(again.groupBy("doc_id", "h").agg(F.collect_set("line").alias("gone")), "gone")
    discard(*read)
    gone = gone.select(F.col("doc_id").alias("k"), F.col("h").alias("kh"), "gone")
    rest = [c for c in docs.columns if c != text_col]
    t = docs.select(F.struct(F.lit(True).alias("_"), *rest).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("its_text")).withColumn("h", F.xxhash64("its_text"))
    t = t.join(gone, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh")), "left").select("row", "gone", "its_text")
    t = t.mapInArrow(run, t.schema).where("its_text IS NOT NULL OR gone IS NULL")
    cols = [F.col("its_text").alias(c) if c == text_col else F.length("its_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return t.select(cols)


#: The same result as SQL, for tables with one row an id.
ORACLE = r"""
WITH l AS (SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS line, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
n AS (SELECT doc_id, line, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS x FROM l WHERE trim(regexp_replace(x, '\s+', ' ', 'g')) <> ''),
f AS (SELECT x, min({'d': doc_id, 'l': line}) AS first FROM n GROUP BY x),
t AS (SELECT x, first, string_split(x, ' ') AS w FROM f WHERE len(string_split(x, ' ')) >= 5),
v AS (
  SELECT x, first, -1 AS spot, x AS v FROM t
  UNION ALL SELECT x, first, i AS spot, array_to_string(list_concat(w[1 : i], w[i + 2 :]), ' ') FROM (SELECT *, unnest(range(0, len(w))) AS i FROM t)),
m AS (SELECT v, spot, min(first) AS low FROM v GROUP BY v, spot),
whole AS (SELECT v, low FROM m WHERE spot = -1), less AS (SELECT v, min(low) AS low FROM m WHERE spot >= 0 GROUP BY v),
p AS (
  SELECT v.x, v.first, m.low FROM v JOIN m ON v.v = m.v AND v.spot = m.spot WHERE v.spot >= 0
  UNION ALL SELECT v.x, v.first, less.low FROM v JOIN less ON v.v = less.v WHERE v.spot = -1
  UNION ALL SELECT v.x, v.first, whole.low FROM v JOIN whole ON v.v = whole.v WHERE v.spot >= 0),
near AS (SELECT x, min(low) AS witness FROM p WHERE low < first GROUP BY x)
SELECT n.doc_id, n.line, CASE WHEN f.first = {'d': n.doc_id, 'l': n.line} THEN near.witness.d ELSE f.first.d END AS first_doc_id,
  CASE WHEN f.first = {'d': n.doc_id, 'l': n.line} THEN near.witness.l ELSE f.first.l END AS first_line, f.first = {'d': n.doc_id, 'l': n.line} AS near
FROM n JOIN f ON f.x = n.x LEFT JOIN near ON near.x = n.x WHERE near.witness IS NOT NULL OR f.first <> {'d': n.doc_id, 'l': n.line}
"""
