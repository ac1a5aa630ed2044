"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most three bits agree
in one of the segments but for at most one bit, so they share a *one-wildcard variant* of it: the segment with one
bit blanked. Every distinct fingerprint emits its 64 variants, variants meet by equality, and members are verified.

A variant that more than ``dense`` distinct fingerprints share is not compared pair by pair. Its members are linked
through *balls* instead: x and y differ in at most three bits exactly when some value lies within one bit of x and
within two bits of y. All fingerprints within two bits of a value are linked to the smallest one within one bit of
it; such links are true by construction, and their number is linear in the members.

:func:`similar` finds texts that are less alike, by five-word shingles. Majority bits can't: texts alike by 0.8 differ in
15 % of them, so a segment long enough to tell texts apart seldom differs by one bit, and 288 variants a text would still
miss 26 % of such pairs. Its signature therefore holds least hashes instead of bits: two texts alike by 0.8 differ in 20 %
of the values. The index is the same: eight segments of eight values, each value blanked in turn, equality joins; pairs are
verified by their exact shingle sets. A pair at 0.8 shares a variant with a chance of 0.996, at 0.85 and above of 0.9998.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keyed, materialise, shuffle_partitions
from .components import connected_components

SEED = 42
WORDS = 3
BITS = 3
#: Distinct fingerprints in one variant up to which all its pairs are compared, and up to which all its links are given
#: rather than a forest of them.
DENSE = 1024
SMALL = 64
_BLOCK = 1 << 15
#: Of :func:`similar`: words of a shingle, similarity, segments of a signature, values of each, and members of a variant up
#: to which all are compared with each other (beyond, with its most central one, then by rare shingles).
SIMILAR_WORDS = 5
SIMILARITY = 0.8
SEGMENTS = 8
VALUES = 8
CROWD = 32


def simhash(text: bytes | None, words: int = WORDS) -> int:
    """Fingerprint of one UTF-8 text as a signed 64-bit integer; zero for a null text or one without words."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    if len(tokens) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(tokens[i:] for i in range(words)), strict=False)]
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = np.array(hashes[at : at + _BLOCK], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([simhash(t) for t in texts], pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long), a row for each row of ``docs``."""
    return keyed(docs, id_col, text_col).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _forest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links than members with the components of all pairs within ``BITS``: each member is compared with all that
    aren't reached yet."""
    us, vs, left = [], [], x
    while len(left):
        ahead, left = [left[0]], left[1:]
        while ahead and len(left):
            v = ahead.pop()
            near = np.bitwise_count(left ^ v) <= BITS
            if near.any():
                us.append(np.full(np.count_nonzero(near), v))
                vs.append(left[near])
                ahead.extend(left[near])
                left = left[~near]
    return (np.concatenate(us), np.concatenate(vs)) if us else (x[:0], x[:0])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        us, vs = [], []
        for group in b.column(0).to_pylist():
            x = np.array(group, np.int64)
            if len(x) > SMALL:
                u, v = _forest(x)
                us.append(u)
                vs.append(v)
                continue
            i, j = np.triu_indices(len(x), 1)
            near = np.bitwise_count(x[i] ^ x[j]) <= BITS
            us.append(x[i[near]])
            vs.append(x[j[near]])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def _balls() -> tuple[np.ndarray, np.ndarray]:
    one = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate([[np.uint64(0)], one, one[i] | one[j]])
    return flips, np.concatenate([[True], np.ones(64, bool), np.zeros(len(i), bool)])


def _ball_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips, inner = _balls()
    for b in batches:
        x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for v in x:
            yield pa.RecordBatch.from_arrays([pa.array((flips ^ v).view(np.int64)), pa.array(np.full(len(flips), v).view(np.int64)), pa.array(inner)], names=["ball", "fp", "inner"])


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (u, v) whose connected components are those of all pairs of ``distinct.fp`` within three bits."""
    # few bytes that become 64 rows each: spread before, as adaptive coalescing only sees the bytes (by another hash, as
    # Spark drops a repartition by the key that rows are grouped by already)
    spread = distinct.select("fp").repartition(shuffle_partitions(distinct.sparkSession), F.xxhash64("fp"))
    variants = spread.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select(
        "fp", F.expr("shiftleft(CAST(p AS BIGINT), 32) | (shiftrightunsigned(fp, 32 * (p div 32)) & 4294967295L & ~shiftleft(1L, CAST(p % 32 AS INT)))").alias("variant")
    )
    # written first, so that the join has two plain shuffles, which Spark splits where a variant is hot
    shared = materialise(variants.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1"), "shared-variants")
    members = materialise(variants.join(shared.hint("merge"), "variant"), "variants")
    discard(shared)
    pairs = members.where(F.col("n") <= dense).groupBy("variant").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_pairs, "u long, v long").distinct()
    crowd = materialise(members.where(F.col("n") > dense).select("fp").distinct(), "crowd")
    if crowd.isEmpty():
        return pairs
    balls = materialise(crowd.mapInArrow(_ball_rows, "ball long, fp long, inner boolean"), "balls")
    hubs = balls.groupBy("ball").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("n > 1 AND hub IS NOT NULL").select("ball", "hub")
    starred = balls.join(materialise(hubs, "hubs").hint("merge"), "ball").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()
    return pairs.union(starred)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """(doc_id long, fingerprint string, component_id long), one row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered; shingles are three words joined by a space,
    repeats included; fewer words give one shingle of all of them; a null, empty or blank text has fingerprint zero
    and is linked like any other. A bit is set if it is set in over half of the XXH64 (seed 42) hashes. Rows link
    at three differing bits or fewer; ``component_id`` is the smallest doc_id reachable (nulls aside; null if the
    component has none). Repeated rows are kept; extra columns are ignored; an empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = _labelled(distinct.withColumnRenamed("fp", "node"), links(distinct.select("fp"), dense))
    return rows.join(labels.hint("merge"), F.col("fp") == F.col("node")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component_id) of rows (node, first): the smallest ``first`` of the component, nulls aside."""
    roots = connected_components(found)
    placed = materialise(nodes.join(roots.withColumnRenamed("node", "its").hint("merge"), F.col("node") == F.col("its"), "left").select("node", "first", F.coalesce("root", "node").alias("root")), "placed")
    lowest = materialise(placed.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    return materialise(placed.join(lowest.hint("merge"), "root").select("node", "component_id"), "labels")


def shingle_set(text: bytes | None, words: int = SIMILAR_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending: fewer words give one shingle of all, none give none."""
    tokens = text.lower().split() if text else []
    k = min(words, len(tokens))
    grams = {b" ".join(g) for g in zip(*(tokens[i:] for i in range(k)), strict=False)} if k else ()
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64))


_N = SEGMENTS * VALUES
_ODD = np.random.default_rng(SEED).integers(0, 1 << 62, (2, _N), np.uint64) * np.uint64(2) + np.uint64(1)


def variant_keys(shingles: np.ndarray) -> np.ndarray:
    """The signature's one-wildcard variants: for each value, a key of the other values of its segment."""
    least = np.full(_N, np.iinfo(np.uint32).max, np.uint32)
    a, b = (_ODD >> np.uint64(31)).astype(np.uint32)[:, :, None]
    for at in range(0, len(shingles), 1024):
        x = (shingles[at : at + 1024] >> np.uint64(16)).astype(np.uint32)
        h = (x[None] ^ b) * (a | np.uint32(1))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(least, h.min(axis=1), out=least)
    mixed = (least.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[1]
    rest = (mixed.reshape(SEGMENTS, VALUES).sum(axis=1, keepdims=True) - mixed.reshape(SEGMENTS, VALUES)).reshape(-1)
    return ((rest ^ (rest >> np.uint64(31))) * _ODD[0] + _ODD[1]).view(np.int64)


_SHINGLED = "doc_id long, node long, shingles array<int>, variants array<bigint>"


def _shingled_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # few rows a batch: a row of a long text is as large as the text
        for at in range(0, b.num_rows, 100):
            part = b.slice(at, 100)
            sets = [shingle_set(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
            nodes = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
            # without words there is nothing to be alike in part
            keys = [variant_keys(s) if len(s) else np.empty(0, np.int64) for s in sets]
            short = [np.unique(s.astype(np.uint32)).view(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(short, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "node", "shingles", "variants"],
            )


def _sizes_allow(m: str, n: str, similarity: float) -> Column:
    return F.least(m, n) >= similarity * F.greatest(m, n)


def _verified(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of nodes whose shingle sets have this Jaccard similarity, by digests of 32 bits; a written table."""
    pairs = materialise(pairs, "candidates")
    wanted = materialise(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "wanted")
    sets = rows.groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = materialise(sets.join(wanted.hint("merge"), "node"), "sets")
    told = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")).hint("merge"), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")).hint("merge"), "v")
    both = F.size(F.array_intersect("x", "y"))
    out = materialise(told.where(both >= similarity * (F.size("x") + F.size("y") - both)).select("u", "v"), "alike")
    discard(pairs, wanted, sets)
    return out


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(doc_id long, component_id long), a row for each row of ``docs``: groups of texts linked by a Jaccard similarity of
    their sets of five-word shingles of ``similarity`` or more, found by variants and verified.

    In a variant of over ``crowd`` distinct texts all are compared with the most central one (that shares most variants with
    others). Texts of variants that then still hold several groups are joined by their rarest shingles instead: of two texts
    alike by 0.8 the rarer fifths have a shingle in common, while texts that merely share a passage differ there.

    Nulls, texts without words, repeated rows, extra columns and empty tables are treated as by :func:`near_duplicates`.
    """
    rows = materialise(keyed(docs, id_col, text_col).mapInArrow(_shingled_batches, _SHINGLED), "shingled")
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("variants").alias("variants"), F.min(F.size("shingles")).alias("size")), "nodes")
    spread = nodes.select("node", "size", "variants").repartition(shuffle_partitions(docs.sparkSession), F.xxhash64("node"))
    variants = spread.select("node", "size", F.explode("variants").alias("variant"))
    shared = materialise(variants.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1"), "shared-variants")
    members = materialise(variants.join(shared.hint("merge"), "variant"), "variants")
    few = members.where(F.col("n") <= crowd)
    pairs = few.select("variant", F.col("node").alias("u"), F.col("size").alias("m")).join(few.select("variant", F.col("node").alias("v"), "size").hint("merge"), "variant")
    found = _verified(pairs.where("u < v").where(_sizes_allow("m", "size", similarity)).select("u", "v").distinct(), rows, similarity)
    if not (crowded := members.where(F.col("n") > crowd)).isEmpty():
        found = _crowd_links(crowded, found, rows, similarity)
    labels = _labelled(nodes.select("node", "first"), found)
    out = materialise(rows.select("doc_id", "node").join(labels.hint("merge"), "node").select("doc_id", "component_id"), "similar")
    discard(rows, nodes, shared, members, found)
    return out


def _crowd_links(crowded: DataFrame, found: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """``found`` and all links between members of crowded variants (variant, node, size, n), but for texts in one group."""
    weights = materialise(crowded.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    members = materialise(crowded.join(weights.hint("merge"), "node"), "crowded")
    hubs = materialise(members.groupBy("variant").agg(F.max(F.struct("weight", "node", "size")).alias("hub")), "hubs")
    pairs = members.join(hubs.hint("merge"), "variant").where("node <> hub.node").where(_sizes_allow("size", "hub.size", similarity))
    links = _verified(pairs.select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v")).distinct(), rows, similarity)
    star = materialise(found.union(links), "alike")
    discard(found, links, weights, hubs)
    roots = materialise(connected_components(star), "roots")
    placed = materialise(members.join(roots.hint("merge"), "node", "left").select("variant", "node", "size", F.coalesce("root", "node").alias("root")), "placed")
    several = materialise(placed.groupBy("variant").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("variant"), "several")
    left = materialise(placed.join(several.hint("merge"), "variant").select("node", "size", "root").distinct(), "left")
    rare = _rarest(left, rows, similarity)
    # of the smaller text a shorter prefix will do, and what follows the first shingle in common must be enough
    small = rare.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * (2 * similarity / (1 + similarity)) - 1e-9) + 1)
    small = small.select("shingle", F.col("node").alias("u"), F.col("size").alias("m"), F.col("root").alias("r"), F.col("rank").alias("i"))
    enough = 1 + F.least(F.col("m") - F.col("i"), F.col("size") - F.col("rank")) >= similarity / (1 + similarity) * (F.col("m") + F.col("size")) - 1e-9
    ordered = F.struct("m", "u") < F.struct("size", "node")
    pairs = small.hint("merge").join(rare.withColumnRenamed("shingle", "its"), (F.col("shingle") == F.col("its")) & ordered & (F.col("r") != F.col("root")) & _sizes_allow("m", "size", similarity) & enough)
    links = _verified(pairs.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct(), rows, similarity)
    out = materialise(star.union(links), "alike")
    discard(members, star, roots, placed, several, left, rare, links)
    return out


def _rarest(nodes: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """(shingle, node, size, root, rank) of ``nodes`` (node, size, root): the rarest shingles of each, one more than a text alike by
    ``similarity`` may lack, where another node has the shingle as well."""
    sets = rows.groupBy("node").agg(F.first("shingles").alias("shingles")).join(nodes.hint("merge"), "node")
    each = materialise(sets.select("node", "size", "root", F.explode("shingles").alias("shingle")), "shingles")
    counts = materialise(each.groupBy("shingle").agg(F.count("*").alias("n")), "counts")
    ranked = each.join(counts.hint("merge"), "shingle").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("n", F.xxhash64("shingle"), "shingle")))
    rare = materialise(ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).where("n > 1").select("shingle", "node", "size", "root", "rank"), "rare")
    discard(each, counts)
    return rare


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """``docs``, all columns, with one document of each group (by default of :func:`similar`): the one with the smallest id.

    Repeated rows with that id all stay. Rows without an id stay where some group has no id at all.
    """
    groups = similar(docs, id_col, text_col) if groups is None else groups
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    packed = docs.select(F.col(id_col).cast("long").alias("key"), F.struct("*").alias("row"))
    return packed.join(kept, packed.key.eqNullSafe(kept.kept), "left_semi").select("row.*")
