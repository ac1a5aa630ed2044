"""Approximate nearest neighbours by one NN-descent graph over all vectors and greedy search along its links.

The graph links each distinct vector to its nearest. It starts from neighbours in several random orders (vectors sorted
by the signs of random projections and compared within short runs) and is improved by Spark joins: in a round every
vector's neighbours, in both directions, meet, all pairs of them with a new link are scored, and each keeps its best.
Lists are sampled, new links first, so a round moves a bounded number of vectors per vector, whatever the table holds.
Vectors are compared by inner product; for the graph each gets one more component that levels all norms, so that the
largest inner product is the nearest neighbour. What is moved is a code of one byte a component.

Queries are rows of the table, so a search starts from the query's own links, and from the vectors of the largest norms.
Each step expands the best nodes not yet expanded: it joins them to their links, the links not yet seen to their codes,
and scores those. Work for a query does not grow with the table but by its links and steps. The best in view are scored
again, in double precision, on the original vectors.

Equal vectors are one node that stands for all its rows; rows come back, smallest id first, in the answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, shuffle_partitions

EVERY = 20
NEAREST = 20
#: Links of a vector, members of a list that meet in a round, most rounds, share of new links at which they end.
LINKS = 48
MEMBERS = 64
ROUNDS = 5
SETTLED = 0.03
#: Random orders that the graph starts from, vectors of a run in them, links that a run gives each.
ORDERS = 4
RUN = 128
EACH = 16
_SIGNS = 30
#: Nodes that a step expands, and the best in sight that it chooses from: a search ends when all of those are expanded, or
#: after STEPS. Nodes kept in view, and vectors of the largest norms that all searches look at.
EXPAND = 12
WIDTH = 32
STEPS = 8
VIEW = 48
TOPS = 64
_BLOCK = 256


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, k1, k2, embedding): rows with an id and a finite vector that isn't zero; ``k1``, ``k2`` tell vectors apart."""
    real = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "array<float>" if real == "float" else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))
    # zero has two signs and one hash
    v = v.withColumn("plain", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(kind[6:-1])).otherwise(x)))
    return v.select("vec_id", F.xxhash64("plain").alias("k1"), F.xxhash64(F.lit(7), "plain").alias("k2"), "embedding")


# ---- codes ---------------------------------------------------------------------------------------------------------


def encode(vectors: np.ndarray, most: float) -> np.ndarray:
    """Rows of bytes: scale and levelling component as float32, then a signed byte for each component."""
    v = vectors.astype(np.float64)
    scale = np.abs(v).max(axis=1, keepdims=True) / 127
    extra = np.sqrt(np.maximum(0, most * most - (v * v).sum(axis=1, keepdims=True)))
    head = np.concatenate([scale, extra], axis=1).astype(np.float32)
    return np.concatenate([head.view(np.uint8).reshape(len(v), 8), np.rint(v / scale).astype(np.int8).view(np.uint8)], axis=1)


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors float32, levelling components) of rows made by :func:`encode`."""
    head = np.ascontiguousarray(codes[:, :8]).view(np.float32)
    return codes[:, 8:].view(np.int8) * head[:, :1], head[:, 1]


def _rows(column: pa.Array) -> np.ndarray:
    """A binary column whose values are of one length, as rows of bytes."""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of rows of one length of vector (column ``dim``)."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            yield d, b if (dims == d).all() else b.filter(pa.array(dims == d))


def _coded(most: float, orders: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b in _by_dim(batches):
            v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            keys = []
            for t in range(orders):
                sides = v @ np.random.default_rng((t, d)).normal(size=(d, _SIGNS)) > 0
                keys.append(sides @ (1 << np.arange(_SIGNS, dtype=np.int64)))
            flat = pa.array(np.stack(keys, axis=1).ravel())
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * np.int32(orders)), flat)
            cols = {c: b.column(c) for c in b.schema.names} | {"code": _binary(encode(v, most)), "keys": keys}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def nodes(v: DataFrame, most_ids: int = NEAREST + 1, orders: int = ORDERS) -> DataFrame:
    """(nid, dim, k1, k2, ids, embedding, norm, code, keys): a row for each distinct vector; ``ids`` its smallest ids."""
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    ids = v.select("k1", "k2", "vec_id").distinct().withColumn("n", place).where(F.col("n") <= most_ids)
    ids = ids.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = v.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding")).join(ids, ["k1", "k2"])
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    one = materialise(one.select(F.monotonically_increasing_id().alias("nid"), F.size("embedding").alias("dim"), "k1", "k2", "ids", "embedding", norm.alias("norm")), "vectors")
    most = one.agg(F.max("norm")).first()[0] or 0.0
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.schema.fields)
    out = materialise(one.mapInArrow(_coded(most, orders), f"{shape}, code binary, keys array<bigint>"), "nodes")
    discard(one)
    return out


# ---- graph ---------------------------------------------------------------------------------------------------------

_OFFER = "u long, c long, score float"


def _offers(u: np.ndarray, c: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(c, pa.int64()), pa.array(score, pa.float32())], names=["u", "c", "score"])


def _runs(run_length: int, each: int):
    """Links between the rows of every run of sorted rows (turn, dim, nid, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _by_dim(batches):
            turn, nid = b.column("turn").to_numpy(), b.column("nid").to_numpy()
            v, extra = decode(_rows(b.column("code")))
            for t in np.unique(turn).tolist():
                of = np.flatnonzero(turn == t)
                for at in range(0, len(of), run_length):
                    g = of[at : at + run_length]
                    k = min(each, len(g) - 1)
                    if k < 1:
                        continue
                    s = v[g] @ v[g].T + np.outer(extra[g], extra[g])
                    np.fill_diagonal(s, -np.inf)
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    yield _offers(np.repeat(nid[g], k), nid[g][top].ravel(), np.take_along_axis(s, top, 1).ravel())

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offers (u, c, score) between the members of each list, where one of both is new and c beats u's worst link."""
    for d, whole in _by_dim(batches):
        for at in range(0, len(whole), _BLOCK):
            lists = whole.column("members").slice(at, _BLOCK)
            x, new, worst, code = lists.flatten().flatten()
            sizes = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((~new.to_numpy(zero_copy_only=False), x.to_numpy(), row))
            ids, own = x.to_numpy()[order], row[order]
            # a link in both directions stands twice; the new one first
            keep = np.concatenate([[True], (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])]) if len(ids) else np.zeros(0, bool)
            order, ids, own = order[keep], ids[keep], own[keep]
            sizes = np.bincount(own, minlength=len(sizes))
            spot = np.arange(len(ids)) - (np.cumsum(sizes) - sizes)[own]
            shape = (len(sizes), int(sizes.max(initial=0)))
            v, extra = decode(_rows(code)[order]) if len(order) else (np.zeros((0, d), np.float32), np.zeros(0, np.float32))
            at_v, at_e, at_id = np.zeros((*shape, d), np.float32), np.zeros(shape, np.float32), np.full(shape, -1, np.int64)
            at_new, at_worst = np.zeros(shape, bool), np.full(shape, np.inf, np.float32)
            at_v[own, spot], at_e[own, spot], at_id[own, spot] = v, extra, ids
            at_new[own, spot], at_worst[own, spot] = new.to_numpy(zero_copy_only=False)[order], worst.to_numpy()[order]
            s = np.matmul(at_v, at_v.transpose(0, 2, 1)) + at_e[:, :, None] * at_e[:, None, :]
            good = (s > at_worst[:, :, None]) & (at_new[:, :, None] | at_new[:, None, :]) & (at_id >= 0)[:, None, :]
            good[:, np.arange(shape[1]), np.arange(shape[1])] = False
            i, j, k = np.nonzero(good)
            yield _offers(at_id[i, j], at_id[i, k], s[i, j, k])


def _kept(graph: DataFrame | None, offers: DataFrame, links: int) -> DataFrame:
    """(u, c, score, new): the best ``links`` of each u among its links and what it was offered."""
    all_ = offers.select("u", "c", "score", F.lit(True).alias("new"))
    if graph is not None:
        all_ = graph.select("u", "c", "score", F.lit(False).alias("new")).union(all_)
    all_ = all_.groupBy("u", "c").agg(F.max("score").alias("score"), F.min("new").alias("new"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("score"), "c"))
    return all_.withColumn("n", place).where(F.col("n") <= links).drop("n")


def neighbour_graph(points: DataFrame, links: int = LINKS, members: int = MEMBERS, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(u, c, score, new): NN-descent over ``points`` of :func:`nodes`; a row for each link from u to c."""
    n = points.count()
    orders = points.select(F.posexplode("keys").alias("turn", "key"), "dim", "nid", "code")
    parts = max(1, min(shuffle_partitions(points.sparkSession), n * ORDERS // (8 * RUN)))
    runs = orders.repartitionByRange(parts, "turn", "dim", "key", "nid").sortWithinPartitions("turn", "dim", "key", "nid")
    offers = materialise(runs.select("turn", "dim", "nid", "code").mapInArrow(_runs(RUN, EACH), _OFFER), "offers")
    graph = materialise(_kept(None, offers, links), "graph")
    for turn in range(rounds):
        worst = graph.groupBy("u").agg(F.min("score").alias("worst"), F.count("*").alias("n")).select("u", F.when(F.col("n") >= links, F.col("worst")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
        state = materialise(points.select("nid", "dim", "code").join(worst, F.col("nid") == F.col("u"), "left").select("nid", "dim", "code", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst")), "state")
        both = graph.select(F.col("u").alias("v"), F.col("c").alias("x"), "new").union(graph.select(F.col("c").alias("v"), F.col("u").alias("x"), "new"))
        place = F.dense_rank().over(Window.partitionBy("v").orderBy(F.desc("new"), F.xxhash64(F.lit(turn), "v", "x"), "x"))
        lists = both.withColumn("n", place).where(F.col("n") <= members).withColumn("any", F.max("new").over(Window.partitionBy("v"))).where("any").select("v", "x", "new")
        met = lists.join(state, F.col("x") == F.col("nid")).groupBy("v").agg(F.first("dim").alias("dim"), F.collect_list(F.struct("x", "new", "worst", "code")).alias("members"))
        discard(offers)
        offers = materialise(met.select("dim", "members").mapInArrow(_meet, _OFFER), "offers")
        better = materialise(_kept(graph, offers, links), "graph")
        discard(graph, state)
        graph = better
        if graph.where("new").count() < settled * n * links:
            break
    discard(offers)
    return graph


def around(graph: DataFrame, links: int = LINKS) -> DataFrame:
    """(nid, around array<bigint>): the nearest ``links`` of those that a node links to and of those that link to it."""
    both = graph.select(F.col("u").alias("v"), F.col("c").alias("x"), "score").union(graph.select(F.col("c").alias("v"), F.col("u").alias("x"), "score"))
    place = F.dense_rank().over(Window.partitionBy("v").orderBy(F.desc("score"), "x"))
    both = both.withColumn("n", place).where(F.col("n") <= links)
    return both.groupBy(F.col("v").alias("nid")).agg(F.collect_set("x").alias("around"))


# ---- search --------------------------------------------------------------------------------------------------------

_POOL = "q long, dim int, query array<double>, seen array<bigint>, view array<struct<c:bigint,score:float,open:boolean>>"


def _scored(view: int, tops: list[tuple[int, bytes]] | None):
    """Pools with the nodes of ``got`` scored and seen; at the start also the nodes ``tops``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, b in _by_dim(batches):
            cols = {c: b.column(c) for c in b.schema.names}
            head = [(n, c) for n, c in tops or () if len(c) == d + 8]
            head_ids = np.array([n for n, _ in head], np.int64)
            head_v = decode(np.frombuffer(b"".join(c for _, c in head), np.uint8).reshape(len(head), -1))[0] if head else np.zeros((0, d), np.float32)
            seen, views = [], []
            own = cols["q"].to_numpy()
            queries = cols["query"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float32)
            for i in range(len(b)):
                ids, v = np.zeros(0, np.int64), np.zeros((0, d), np.float32)
                got = cols["got"][i].values
                if got is not None and len(got):
                    c, code = got.flatten()
                    ids, v = c.to_numpy(), decode(_rows(code))[0]
                if len(head_ids):
                    more = ~np.isin(head_ids, np.append(ids, own[i]))
                    ids, v = np.concatenate([ids, head_ids[more]]), np.concatenate([v, head_v[more]])
                score = v @ queries[i]
                before = cols["view"][i].as_py() or []
                seen.append(np.concatenate([np.array(cols["seen"][i].as_py() or [], np.int64), ids]))
                every = before + [{"c": a, "score": s, "open": True} for a, s in zip(ids.tolist(), score.tolist(), strict=True)]
                views.append(sorted(every, key=lambda x: (-x["score"], x["c"]))[:view])
            cols["seen"], cols["view"] = pa.array(seen, pa.list_(pa.int64())), pa.array(views, pa.list_(pa.struct([("c", pa.int64()), ("score", pa.float32()), ("open", pa.bool_())])))
            names = [c for c in cols if c != "got"]
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return run


def search(points: DataFrame, near: DataFrame, queries: DataFrame, expand: int = EXPAND, width: int = WIDTH, steps: int = STEPS, view: int = VIEW, tops: int = TOPS) -> DataFrame:
    """(q, dim, query, seen, view): greedy search for the nodes ``queries`` (q, dim, query) from their own links.

    ``seen`` has every node that was scored for q, q itself aside; ``view`` the best of them by their codes.
    """
    codes = points.select("nid", "code")
    first = [(r["nid"], bytes(r["code"])) for r in points.select("nid", "code", "norm").orderBy(F.desc("norm"), "nid").limit(tops).collect()]
    chosen = f"slice(transform(filter(slice(view, 1, {width}), x -> x.open), x -> x.c), 1, {expand})"
    nothing = F.expr("CAST(array() AS array<struct<c:bigint,score:float,open:boolean>>)")
    pool = queries.select("q", "dim", "query", F.expr("CAST(array() AS array<bigint>)").alias("seen"), nothing.alias("view"))
    for step in range(steps + 1):
        via = F.array("q") if step == 0 else F.expr(chosen)
        hop = pool.select("q", F.explode(via).alias("via")).join(near, F.col("via") == F.col("nid")).groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("offered"))
        fresh = pool.select("q", "seen").join(hop, "q").select("q", F.explode(F.array_except("offered", F.concat("seen", F.array("q")))).alias("c"))
        fresh = materialise(fresh, "fresh")
        got = fresh.join(codes, F.col("c") == F.col("nid")).groupBy("q").agg(F.collect_list(F.struct("c", "code")).alias("got"))
        spent = F.expr("transform(view, x -> named_struct('c', x.c, 'score', x.score, 'open', x.open AND NOT array_contains(chosen, x.c)))")
        rows = pool.withColumn("chosen", F.expr(chosen)).withColumn("view", spent).drop("chosen").join(got, "q", "left")
        done = materialise(rows.mapInArrow(_scored(view, first if step == 0 else None), _POOL), "pool")
        discard(fresh, pool)
        pool = done
        if pool.where(F.size(F.expr(chosen)) > 0).isEmpty():
            break
    return pool


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", links: int = LINKS, members: int = MEMBERS, rounds: int = ROUNDS, expand: int = EXPAND, width: int = WIDTH, steps: int = STEPS, view: int = VIEW) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): for each row whose id is divisible by ``every`` the ``k``
    rows of the largest inner product found among all others, best first, ties to the smaller id.

    Rows with a null id, or a vector that is null, empty, zero or holds null or non-finite components, take no part;
    rows that repeat id and vector are one; vectors of another length never match. With fewer candidates all that
    were found come back; an empty table gives no rows. Extra columns are ignored.
    """
    v = materialise(valid(vectors, id_col, vector_col), "valid")
    points = nodes(v, k + 1)
    graph = neighbour_graph(points, max(links, k + 1), max(members, k + 1), rounds)
    near = materialise(around(graph, links), "around")
    asked = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    asked = materialise(asked.join(points.select("k1", "k2", "nid"), ["k1", "k2"]).select("query_id", F.col("nid").alias("q")), "asked")
    queries = materialise(points.join(asked.select("q").distinct(), F.col("nid") == F.col("q"), "left_semi").select(F.col("nid").alias("q"), "dim", F.col("embedding").cast("array<double>").alias("query")), "queries")
    found = search(points, near, queries, expand, max(width, k + 1), steps, max(view, 2 * k + 8))
    pairs = found.select("q", F.explode(F.concat(F.array("q"), F.transform("view", lambda x: x["c"]))).alias("c"))
    rows = pairs.join(points.select(F.col("nid").alias("c"), "ids", "embedding"), "c").join(queries.select("q", "query"), "q")
    score = F.aggregate(F.zip_with("embedding", "query", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    rows = rows.select("q", score.alias("score"), F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    top = rows.withColumn("n", place).where(F.col("n") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("top"))
    top = materialise(top, "answers")
    discard(v, points, graph, near, queries, found)
    out = asked.join(top, "q").select("query_id", F.posexplode(F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
