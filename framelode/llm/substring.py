"""Substring dedup by hashing normalised lines and paragraphs.

A unit is a line or a paragraph (what stands between blank lines). Units are normalised (case folded, white space runs
one space), digests are grouped over all documents, the earliest occurrence by (doc_id, hash of the text, place) stays,
and every other is cut out of its document. Cuts keep their offsets in the original text; a cut inside another is part of
it. Units of fewer than ``min_words`` words (two letters of a script without spaces count as one) are too common to tell
a copy and always stay; each unit is judged as a whole, so a line of many short sentences is long.

Only digests and places are shuffled to find repeats; groups are reduced to one row before the shuffle. The units and the
repeated digests are written first, so the join back has two plain shuffles, which Spark splits where a digest is hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialise

MIN_WORDS = 8
KINDS = ("line", "paragraph")
_BETWEEN = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n")}
#: Letters of scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def units(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int]]:
    """(start, end) code points of the units of a text that hold anything but white space, trimmed, in order; a
    paragraph of one line is one unit."""
    out = set()
    for kind in kinds:
        at = 0
        for stop, after in [*(m.span() for m in _BETWEEN[kind].finditer(text)), (len(text), 0)]:
            s = text[at:stop]
            if t := s.strip():
                start = at + len(s) - len(s.lstrip())
                out.add((start, start + len(t)))
            at = after
    return sorted(out)


def normalise(unit: str) -> list[str]:
    return unit.casefold().split()


def long_enough(words: list[str], min_words: int) -> bool:
    return len(words) + sum(map(len, map(_UNSPACED.findall, words))) // 2 >= min_words


def outer(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in no other, in order; spans nest or stand apart."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or end > out[-1][1]:
            out.append((start, end))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans and the white space that follows each."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        while end < len(text) and text[end].isspace():
            end += 1
        at = end
    return "".join([*out, text[at:]])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, start, end, first_doc_id): every unit to cut; ``h`` is xxhash64 of the text, to tell rows of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs, starts, ends, digests = [], [], [], [], []
            for k, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for start, end in units(t or "", kinds):
                    words = normalise(t[start:end])
                    if long_enough(words, min_words):
                        ids.append(k)
                        hs.append(h)
                        starts.append(start)
                        ends.append(end)
                        digests.append(xxhash.xxh3_128_digest(" ".join(words).encode()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "h", "start", "end", "digest"])

    t = keyed(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = materialise(t.mapInArrow(run, "doc_id long, h long, start int, end int, digest binary"), "units")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "start")
    firsts = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest", "first")
    firsts = materialise(firsts, "repeated-units")
    again = found.join(firsts, "digest").where(~place.eqNullSafe(F.col("first")))
    return again.select("doc_id", "h", "start", "end", F.col("first.doc_id").alias("first_doc_id"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_units long, n_removed long, removed array<struct<start,end>>, kept string) for each row.

    ``removed`` holds the cuts that lie in no other.
    A null text has no units and stays null. Rows that repeat both id and text count as one document, so that
    neither loses to the other. Rows without an id rank after all others. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n.append(len(units(t or "", kinds)))
                gone = outer([(s["start"], s["end"]) for s in spans or []])
                removed.append([{"start": start, "end": end} for start, end in gone] or None)
                kept.append(None if t is None else cut(t, gone))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, b.schema.field(2).type), pa.array(kept, pa.string())], names=["doc_id", "n_units", "removed", "kept"])

    gone = repeated_spans(docs, id_col, text_col, kinds, min_words)
    gone = materialise(gone.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed")), "cuts")
    gone = gone.select(F.col("doc_id").alias("k"), F.col("h").alias("kh"), "removed")
    t = keyed(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    t = t.join(gone, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh")), "left").select("doc_id", "text", "removed")
    out = t.mapInArrow(run, "doc_id long, n_units long, removed array<struct<start:int,end:int>>, kept string")
    return out.withColumn("n_removed", F.coalesce(F.size("removed"), F.lit(0)).cast("long"))


#: The same result as SQL, for tables with one row an id.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(s) AS x, 1 AS sep, unnest(range(0, len(s))) AS k, 'line' AS kind FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
p AS (
  SELECT doc_id, unnest(s) AS x, unnest(list_concat([0], list_transform(r, lambda y: length(y)))) AS sep, unnest(range(0, len(s))) AS k, 'paragraph' AS kind
  FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS s, regexp_extract_all(text, '\n[ \t\r]*\n') AS r FROM documents)),
o AS (
  SELECT doc_id, x, sum(length(x) + sep) OVER (PARTITION BY doc_id, kind ORDER BY k) - length(x) - CASE WHEN kind = 'line' THEN 1 ELSE 0 END AS off
  FROM (SELECT * FROM l UNION ALL SELECT * FROM p)),
u AS (
  SELECT DISTINCT doc_id, CAST(off + length(x) - length(regexp_replace(x, '^\s+', '')) AS BIGINT) AS a, CAST(off + length(regexp_replace(x, '\s+$', '')) AS BIGINT) AS z,
         trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS norm
  FROM o WHERE regexp_matches(x, '\S')),
long AS (
  SELECT * FROM u WHERE len(string_split(norm, ' '))
    + len(regexp_extract_all(norm, '[\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}]')) // 2 >= 8),
again AS (SELECT doc_id, a, z FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, a) AS place FROM long) WHERE place > 1),
gone AS (SELECT * FROM again g WHERE NOT EXISTS (SELECT 1 FROM again o WHERE o.doc_id = g.doc_id AND o.a <= g.a AND o.z >= g.z AND o.z - o.a > g.z - g.a)),
e AS (SELECT g.doc_id, g.a, g.z, g.z + length(regexp_extract(d.text[g.z + 1 : length(d.text)], '^\s*')) AS z2, d.text FROM gone g JOIN documents d ON d.doc_id = g.doc_id),
cutp AS (
  SELECT doc_id, text, coalesce(lag(z2) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start, a AS stop FROM e
  UNION ALL SELECT doc_id, text, max(z2), length(text) FROM e GROUP BY doc_id, text),
kept AS (SELECT doc_id, sha256(string_agg(text[start + 1 : stop], '' ORDER BY start, stop)) AS kept_sha256 FROM cutp GROUP BY doc_id),
spans AS (SELECT doc_id, count(*) AS n_removed, string_agg(a || '-' || z, ',' ORDER BY a) AS removed FROM gone GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_units FROM (SELECT DISTINCT doc_id, a, z FROM u) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_units, 0) AS n_units, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.removed, '') AS removed, coalesce(k.kept_sha256, sha256(coalesce(d.text, ''))) AS kept_sha256
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN spans s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
