"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only.

Every source gets a target of words. A document's expected number of copies is proportional to its size, at most three,
at the one rate at which a source's expected words are its target. Its whole copies are certain. The fraction left, p, is
sampled: documents are ranked by their random odds u / (1 - u) divided by their inclusion odds p / (1 - p), and the
lowest ranks of a source are taken, up to the words that its whole copies leave of the target (the size of the sample is
fixed in words, which is what targets are stated in): the last is taken if that brings the source nearer.

No source is ordered in one task: the rank is cut in 4096 x 4096 digits, sums by digit find the digit in which a
source reaches its target, and only the documents of that digit are ordered. Sources are numbered by ranges, and their
rates found from sums by distinct size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, shuffle_partitions

WEIGHTS = (5, 2, 1)
MOST = 3
#: Sources up to which their tables (a row of under 100 bytes each) are broadcast; beyond it they are joined by sorting.
FEW_SOURCES = 200_000
_SPACE = r"\x20\x09-\x0D"


def word_count(text) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    marks = F.regexp_replace(text, f"[^{_SPACE}]++[{_SPACE}]*+", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, f"^[{_SPACE}]+", "")), F.lit(0)).cast("long")


def _bits(doc_id, text) -> F.Column:
    """48 random bits made from id and text."""
    seed = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, 12), 16, 10).cast("long")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return t.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        _bits(F.col("doc_id"), F.col("text")).alias("bits"),
        F.monotonically_increasing_id().alias("rid"),
    )


def _numbered(by_source: DataFrame) -> DataFrame:
    """``by_source`` with ``place``, the number of sources before each in code point order, null last."""
    parts = shuffle_partitions(by_source.sparkSession)
    ranged = materialise(by_source.repartitionByRange(parts, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    return ranged.withColumn("inside", inside).join(F.broadcast(counts), "part").withColumn("place", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) by source from rows (source, size).

    A target is least(most * size, level * weight); the level is total / weights at first, and while sources are above
    their caps they get the cap and what is left is shared by the weights of the others.
    """
    by_source = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = materialise(by_source.select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * most).alias("cap")), "weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("w") if full >= 0 else F.lit(False)
        r = s.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("capped"), F.sum(F.when(over, 0).otherwise(F.col("w"))).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        if r["n"] == full or not r["w"]:
            break
        full, level = r["n"], float(total - r["capped"]) / float(r["w"])
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def rates(sizes: DataFrame, s: DataFrame, most: int = MOST) -> DataFrame:
    """(sid, rate): expected copies a word, such that least(most, rate * size) copies of each make the target's words;
    null where all documents get ``most``. The rows that are ordered are a source's distinct sizes."""
    by_size = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    by_size = by_size.join(s.select(F.col("source").alias("of"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).where(F.col("target") < F.col("source_size") * most)
    words = F.col("size").cast("double") * F.col("n")
    longer = F.coalesce(F.sum(words).over(Window.partitionBy("sid").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    squares = F.sum(words * F.col("size")).over(Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    by_size = by_size.withColumn("rate", (F.col("target") - most * longer) / squares)
    # the longest documents that the rate leaves under the cap
    return by_size.where(F.col("rate") * F.col("size") <= most).groupBy("sid").agg(F.max(F.struct("size", "rate"))["rate"].alias("rate"))


def _boundary(rows: DataFrame, digit: str) -> DataFrame:
    """By source, the digit in which the running sum of sizes passes what is left of the target."""
    sums = rows.groupBy("sid", digit).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    after = F.col("base") + F.sum("words").over(Window.partitionBy("sid").orderBy(digit))
    sums = sums.withColumn("after", after).where("after > rest AND after - words <= rest")
    return sums.groupBy("sid").agg(F.min(F.struct(digit, (F.col("after") - F.col("words")).alias("base"))).alias("b")).select("sid", F.col(f"b.{digit}").alias(f"{digit}_at"), F.col("b.base").alias(f"{digit}_base"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, bits, rid, size, source_size, target, expected, whole, copies), a row for each row of ``docs``.

    ``size`` is the words of the text, 0 for null or blank; documents of no words add none, and get no copies unless
    their whole source gets ``most``. Sources in code point order, null last, weigh ``weights`` in turn. Random numbers
    are made from doc_id and text, so reruns agree; repeated rows are separate documents, told apart by ``rid``. An
    empty table gives no rows; other columns are ignored.
    """
    sizes = materialise(_sizes(docs, id_col, text_col, source_col), "sizes")
    s = materialise(targets(sizes, weights, most).withColumn("sid", F.xxhash64(F.col("source"), F.col("source").isNull())), "targets")
    small = F.broadcast if s.count() <= FEW_SOURCES else lambda df: df
    s = materialise(s.join(small(rates(sizes, s, most)), "sid", "left"), "rates")
    t = sizes.join(small(s.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    t = t.withColumn("expected", F.least(F.lit(float(most)), F.coalesce(F.col("rate") * F.col("size"), F.when(F.col("target") < F.col("source_size") * most, 0.0).otherwise(float(most)))))
    t = t.withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    certain = t.groupBy("sid").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    t = t.join(small(certain), "sid").withColumn("rest", F.col("target") - F.col("certain"))
    u = (F.col("bits") + 0.5) / float(1 << 48)
    t = t.withColumn("odds", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    # odds / (1 + odds) orders as the odds do, and has digits
    t = t.withColumn("rank", F.floor(F.col("odds") / (1 + F.col("odds")) * float(1 << 48)))
    t = t.withColumn("d1", F.expr("CAST(least(shiftright(rank, 36), 4095) AS INT)")).withColumn("d2", F.expr("CAST(shiftright(rank, 24) & 4095 AS INT)")).withColumn("base", F.lit(0).cast("long"))
    # written, as are the boundaries: as one plan, the joins to this point would be planned again for each of its uses, in the driver
    t = materialise(t.drop("rate", "certain", "odds"), "ranked")
    discard(sizes)
    b1 = materialise(_boundary(t.where("p > 0"), "d1"), "first-digits")
    t = t.join(small(b1), "sid", "left")
    inside = t.where("p > 0 AND d1 = d1_at").withColumn("base", F.col("d1_base"))
    b2 = materialise(_boundary(inside, "d2"), "second-digits")
    t = t.join(small(b2), "sid", "left")
    clear = t.where("NOT (p > 0 AND d1 <=> d1_at AND d2 <=> d2_at)").withColumn("extra", F.expr("p > 0 AND (d1_at IS NULL OR d1 < d1_at OR (d1 = d1_at AND (d2_at IS NULL OR d2 < d2_at)))"))
    order = Window.partitionBy("sid").orderBy("rank", "bits", "doc_id", "rid")
    near = t.where("p > 0 AND d1 <=> d1_at AND d2 <=> d2_at").withColumn("extra", 2 * (F.col("d2_base") + F.sum("size").over(order) - F.col("size")) + F.col("size") <= 2 * F.col("rest"))
    keep = ["doc_id", "source", "bits", "rid", "size", "source_size", "target", "expected", "whole"]
    picked = clear.select(*keep, "extra").union(near.select(*keep, "extra"))
    return picked.select(*keep, (F.col("whole") + F.col("extra").cast("long")).alias("copies"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it; rows taken zero times are gone.

    Rows that repeat doc_id, text and source share their copies: one of them stands for all.
    """
    copies = mix(docs, id_col, text_col, source_col, weights, most)
    copies = copies.groupBy("doc_id", "bits", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    copies = materialise(copies, "copies").select(F.col("doc_id").alias("k"), F.col("bits").alias("b"), F.col("source").alias("s"), "copies", "rows")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _bits(F.col(id_col).cast("long"), text).alias("bits"), F.col(source_col).cast("string").alias("source"), F.struct("*").alias("row"))
    rows = rows.join(copies, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("bits") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
    once = rows.where("rows = 1").select("row", "copies")
    more = rows.where("rows > 1").groupBy("doc_id", "bits", "source").agg(F.first("row").alias("row"), F.first("copies").alias("copies")).select("row", "copies")
    return once.union(more).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


ORACLE = """
WITH t AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(md5(text), ''))), 1, 12) AS BIGINT) AS bits
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM t GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s0),
s2 AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / w AS full_at FROM s1),
s3 AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS DOUBLE) AS level
  FROM s2 WINDOW up AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT level FROM s3 WHERE level <= full_at ORDER BY full_at, source NULLS LAST LIMIT 1) AS found FROM s3),
s5 AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), found * w) AS target FROM s4),
z0 AS (SELECT t.source, t.size, s5.target, CAST(count(*) AS DOUBLE) AS n FROM t JOIN s5 ON t.source IS NOT DISTINCT FROM s5.source WHERE t.size > 0 AND s5.target < s5.source_size * 3 GROUP BY t.source, t.size, s5.target),
z1 AS (
  SELECT source, size, (target - 3 * coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(size * n * size) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING) AS rate
  FROM z0),
z2 AS (SELECT source, max_by(rate, size) AS rate FROM z1 WHERE rate * size <= 3 GROUP BY source),
s6 AS (SELECT s5.*, z2.rate FROM s5 LEFT JOIN z2 ON z2.source IS NOT DISTINCT FROM s5.source),
r AS (
  SELECT t.doc_id, t.size, t.bits, s6.source, source_size, target, ((bits + 0.5) / 281474976710656.0) AS u,
         least(3.0, coalesce(rate * size, CASE WHEN target < source_size * 3 THEN 0.0 ELSE 3.0 END)) AS expected
  FROM t JOIN s6 ON t.source IS NOT DISTINCT FROM s6.source),
p AS (SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS p FROM r),
o AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds, target - sum(whole * size) OVER (PARTITION BY source) AS rest
  FROM p),
c AS (
  SELECT *, p > 0 AND 2 * (sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY floor(odds / (1 + odds) * 281474976710656.0), bits, doc_id NULLS FIRST) - size) + size <= 2 * rest AS extra
  FROM o)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
