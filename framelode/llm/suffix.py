"""Suffix-array dedup: bytes covered by a string of 200 bytes that starts more than once.

Suffix arrays are built for shards of bounded size, and a shard must hold all the strings that could be equal. Every
window of 200 bytes is therefore filed under its *anchor*: the 32-byte gram inside it with the smallest hash (the
leftmost of equals). Equal windows have equal anchors at equal places, so they meet in one shard; windows filed under
an anchor that stands in one place only are unique and go no further. Neighbouring windows share their anchor, so what
is filed is the *context* of an anchor: the windows from the first to the last that chose it.

Copies of a context are counted before the shuffle and stand in the shard once. Where an anchor has one context, its
windows repeat just as the context does; where it has several, their text goes into the shard's suffix array:
suffixes are classified, leftmost-smaller (LMS) substrings are sorted by induction and named, the string of names is
sorted the same way, recursively, and a second induction gives the array. Over bytes both inductions run bucket by bucket
over whole numpy slices, over the large alphabets of names place by place. Common prefixes are found in text order (the
permuted array): compared only where the byte before differs from that of the neighbour, one less than the prefix before
elsewhere. They part the array into strings that are equal for the length asked for.

An anchor with more than ``DENSE`` contexts is subdivided: windows are filed under a band of the anchor's place in them
and the bytes that all windows of that band have around the anchor, first in wide bands, then in narrower ones. In the
last a window is filed under all of its bytes, so no shard holds many contexts of one key, however often it stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialise

LENGTH = 200
GRAM = 32
#: Contexts of one key up to which they are put into one suffix array; widths of bands by which keys with more are
#: subdivided, the last with one window; bytes of text at which a shard's array is built.
DENSE = 256
BANDS = (24, 4, 1)
SHARD = 4 << 20
_BATCH = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


# ---- suffix arrays -------------------------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type (smaller than the next one); the last is L-type, as an end is smaller than all."""
    n = len(t)
    s = np.zeros(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])
        up = t[differs] < t[differs + 1]
        nxt = np.searchsorted(differs, np.arange(n - 1))
        s[:-1] = np.append(up, False)[nxt]
    return s


def _deal(sa: np.ndarray, j: np.ndarray, chars: np.ndarray, at: np.ndarray, step: int) -> None:
    """Put suffixes ``j``, in order, at the open ends ``at`` of the buckets of their characters."""
    order = np.argsort(chars, kind="stable")
    js, cs = j[order], chars[order]
    counts = np.bincount(cs, minlength=len(at))
    firsts = np.cumsum(counts) - counts
    within = np.arange(len(js)) - firsts[cs]
    sa[at[cs] + step * within] = js
    at += step * counts


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix array induced from LMS suffixes in the order given."""
    n, k = len(t), len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int32)
    heads = starts.copy()
    by = np.argsort(t[lms], kind="stable")
    placed = lms[by]
    of = np.searchsorted(t[placed], np.arange(k + 1)) if len(lms) else np.zeros(k + 1, int)
    # left to right: L-type suffixes, the end of the text first
    sa[heads[t[n - 1]]] = n - 1
    heads[t[n - 1]] += 1
    for c in range(k):
        if not sizes[c]:
            continue
        lo = starts[c]
        while lo < heads[c]:
            hi = heads[c]
            j = sa[lo:hi] - 1
            j = j[j >= 0]
            j = j[~s[j]]
            lo = hi
            if len(j):
                _deal(sa, j, t[j], heads, 1)
        some = placed[of[c] : of[c + 1]]
        if len(some):
            j = some - 1
            _deal(sa, j, t[j], heads, 1)
    # right to left: S-type suffixes
    tails = ends - 1
    for c in range(k - 1, -1, -1):
        if not sizes[c]:
            continue
        hi = ends[c] - 1
        while hi > tails[c]:
            lo = tails[c]
            j = sa[lo + 1 : hi + 1][::-1] - 1
            j = j[j >= 0]
            j = j[s[j]]
            hi = lo
            if len(j):
                _deal(sa, j, t[j], tails, -1)
        block = sa[starts[c] : heads[c]][::-1] - 1
        j = block[block >= 0]
        j = j[s[j]]
        if len(j):
            _deal(sa, j, t[j], tails, -1)
    return sa


def _induce_names(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same over a large alphabet, place by place."""
    n, ends = len(t), np.cumsum(sizes)
    placed = lms[np.argsort(t[lms], kind="stable")]
    of = t[placed]
    counts = np.bincount(of, minlength=len(sizes))
    slots = np.full(n, -1, np.int64)
    slots[ends[of] - counts[of] + np.arange(len(of)) - (np.cumsum(counts) - counts)[of]] = placed
    heads, tails = (ends - sizes).tolist(), (ends - 1).tolist()
    sa, names, small = slots.tolist(), t.tolist(), s.tolist()
    sa[heads[names[-1]]] = n - 1
    heads[names[-1]] += 1
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not small[j]:
            at = heads[names[j]]
            sa[at] = j
            heads[names[j]] = at + 1
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and small[j]:
            at = tails[names[j]]
            sa[at] = j
            tails[names[j]] = at - 1
    return np.array(sa, np.int32)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string of integers from 0 (bytes, or names of the level above) by induced sorting."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    k = int(t.max()) + 1
    sizes = np.bincount(t, minlength=k)
    induce = _induce if k <= 256 else _induce_names
    s = _types(t)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        first = induce(t, s, lms, sizes)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = first[is_lms[first]]
        # names: equal neighbours in this order are equal substrings, each up to and with the next LMS place
        nxt = np.full(n, n - 1, np.int32)
        nxt[lms[:-1]] = lms[1:]
        a, b = order[:-1], order[1:]
        la, lb = nxt[a] - a, nxt[b] - b
        same = (la == lb) & (b != lms[-1]) & (a != lms[-1])
        live, off = np.flatnonzero(same), 0
        while len(live):
            ok = t[np.minimum(a[live] + off, n - 1)] == t[np.minimum(b[live] + off, n - 1)]
            same[live[~ok]] = False
            live = live[ok & (la[live] > off)]
            off += 1
        name = np.concatenate([[0], np.cumsum(~same)])
        if name[-1] + 1 < len(lms):
            whole = np.zeros(n, np.int64)
            whole[order] = name
            reduced = whole[lms]
            lms = lms[suffix_array(reduced)]
        else:
            lms = order
    return induce(t, s, lms, sizes)


def _words(t: np.ndarray) -> np.ndarray:
    """Eight bytes from every place (unaligned view); ``t`` must have eight to spare."""
    return np.lib.stride_tricks.as_strided(t.view(np.uint8)[: len(t) // 8 * 8].view("<u8"), (len(t) - 8,), (1,), writeable=False)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By place in the text: length of the prefix that a suffix shares with the one before it in ``sa``; 0 for the first.

    Where both have the same byte before them it is one less than that of the place before, so that only the others are
    compared, eight bytes at a time.
    """
    n = len(t)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    reducible = (before > 0) & (place > 0)
    reducible[reducible] = t[place[reducible] - 1] == t[before[reducible] - 1]
    padded = np.concatenate([t, np.zeros(24, np.uint8)])
    words = _words(padded)
    a = np.flatnonzero(~reducible & (before >= 0))
    b, off = before[a], 0
    room = n - np.maximum(a, b)
    live = np.arange(len(a))
    length = np.zeros(len(a), np.int64)
    while len(live):
        differ = words[a[live] + off] ^ words[b[live] + off]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
        length[live] = off + same
        off += 8
        live = live[(same == 8) & (room[live] > off)]
    out[a] = np.minimum(length, room)
    known = np.maximum.accumulate(np.where(reducible, 0, place))
    return np.maximum(0, out[known] - (place - known))


def repeated_windows(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the places ``starts`` (marked True in a mask over ``text``) begin a string of ``length`` bytes that
    another of them begins too."""
    sa = suffix_array(text)
    group = np.cumsum(permuted_prefixes(text, sa)[sa] < length)
    marked = starts[sa]
    several = np.bincount(group[marked], minlength=int(group[-1]) + 1 if len(group) else 0) > 1
    hit = np.zeros(len(text), bool)
    hit[sa] = marked & several[group]
    return hit


# ---- anchors -------------------------------------------------------------------------------------------------------


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _gram_hashes(buf: bytes, gram: int) -> np.ndarray:
    n = len(buf)
    words = _words(np.frombuffer(buf + bytes(8 + 8 - n % 8), np.uint8))
    m = n - gram + 1
    h = words[:m] * _C[0]
    for i in range(1, gram // 8):
        h += words[8 * i : 8 * i + m] * _C[i]
    h ^= h >> np.uint64(32)
    h *= _C[4]
    return h ^ (h >> np.uint64(29))


def contexts(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor runs of several texts of under 2**24 bytes together: (text number, first window, last window, anchor hash,
    context hash)."""
    lens = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lens) - lens
    buf = b"".join(texts)
    n, w = len(buf), length - gram + 1
    windows = np.maximum(0, lens - length + 1)
    if not windows.any():
        e = np.empty(0, np.int64)
        return e, e, e, e, e
    h = _gram_hashes(buf, gram)
    best = _sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), w)
    total = int(windows.sum())
    owner = np.repeat(np.arange(len(texts)), windows)
    p = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + begins[owner]
    a = (best[p] & _LOW).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    lo, hi, own = p[cut], p[np.append(cut[1:], total) - 1], owner[cut]
    digest = xxhash.xxh3_64_intdigest
    view = memoryview(buf)
    ch = np.array([digest(view[x:y]) for x, y in zip(lo.tolist(), (hi + length).tolist(), strict=True)], np.uint64).view(np.int64)
    return own, lo - begins[own], hi - begins[own], h[a[cut]].view(np.int64), ch


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    size = 4 * _BATCH
    for at in range(0, max(1, len(text) - length + 1), size):
        yield at, text[at : at + size + length - 1]


def _context_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs = b.column(0), b.column(1)
            texts = b.column(2).cast(pa.binary()).to_pylist()
            group: list[tuple[int, int, bytes]] = []
            held = 0
            for i, t in enumerate([*texts, None]):
                for at, piece in _pieces(t, length) if t and len(t) >= length else ():
                    group.append((i, at, piece))
                    held += len(piece)
                if group and (held >= _BATCH or i == len(texts)):
                    own, lo, hi, ah, ch = contexts([g[2] for g in group], length, gram)
                    rows, offs = np.array([g[0] for g in group])[own], np.array([g[1] for g in group])[own]
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([ids.take(take), hs.take(take), pa.array(lo + offs), pa.array(hi + offs), pa.array(ah), pa.array(ch)], names=["doc_id", "h", "lo", "hi", "ah", "ch"])
                    group, held = [], 0

    return run


def _cut_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ah, ch, out = [], [], []
            for t, want in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x in want:
                    ah.append(x["ah"])
                    ch.append(x["ch"])
                    out.append(t[x["lo"] : x["hi"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(ah, pa.int64()), pa.array(ch, pa.int64()), pa.array(out, pa.binary())], names=["ah", "ch", "context"])

    return run


def _runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"f": int(f), "t": int(t) - 1} for f, t in zip(edge[::2], edge[1::2], strict=True)]


_RUNS = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())]))


def shared_sides(rows: list[tuple[int, int, bytes]], length: int, gram: int) -> list[tuple[int, int, bytes]]:
    """The rows (ah, ch, context) that may share a window with another row of their anchor; no others do.

    A window has more than half of what it holds besides the anchor on one side of it at least. So contexts that share one
    agree in the anchor and half of the rest before it, or in the anchor and half of the rest (and a byte) after it.
    """
    text = b"".join(r[2] for r in rows)
    lens = np.array([len(r[2]) for r in rows])
    begins = np.cumsum(lens) - lens
    # the anchor is the first gram with its hash; a hash from across a border can't come before it
    own = np.repeat(np.arange(len(rows)), lens)[: len(text) - gram + 1]
    hits = np.flatnonzero(_gram_hashes(text, gram).view(np.int64) == np.array([r[0] for r in rows])[own])
    found, first = np.unique(own[hits], return_index=True)
    assert len(found) == len(rows)
    before = (length - gram) // 2
    after = length - gram - before + 1
    digest = xxhash.xxh3_64_intdigest
    keys: list[tuple] = []
    seen: dict[tuple, int] = {}
    for (ah, _, t), at in zip(rows, (hits[first] - begins).tolist(), strict=True):
        left = (ah, 0, digest(t[at - before : at + gram])) if at >= before else None
        right = (ah, 1, digest(t[at : at + gram + after])) if at + gram + after <= len(t) else None
        keys.append((left, right))
        for k in (left, right):
            if k:
                seen[k] = seen.get(k, 0) + 1
    return [r for r, pair in zip(rows, keys, strict=True) if any(k and seen[k] > 1 for k in pair)]


def _shards(length: int, gram: int | None = None):
    """Rows (ah, ch, context) sorted by ah -> (ah, ch, runs of repeated windows); an array per SHARD bytes of whole anchors.

    With ``gram``, ah is the hash of an anchor of that length, and contexts that can't share a window stay out of the array.
    """

    def solve(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        ends = np.cumsum([len(r[2]) for r in rows])
        starts = np.zeros(len(text), bool)
        for e, r in zip(ends, rows, strict=True):
            starts[e - len(r[2]) : e - length + 1] = True
        hit = repeated_windows(text, starts, length)
        runs = [_runs(hit[e - len(r[2]) : e]) for e, r in zip(ends, rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(runs, _RUNS)], names=["ah", "ch", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[tuple[int, int, bytes]] = []
        rows: list[tuple[int, int, bytes]] = []
        arrived = held = 0
        last = None

        def sift() -> int:
            some = shared_sides(fresh, length, gram) if gram else fresh
            rows.extend(some)
            return sum(len(r[2]) for r in some)

        for b in batches:
            for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if arrived >= SHARD and r[0] != last:
                    held += sift()
                    fresh, arrived = [], 0
                    if held >= SHARD:
                        yield solve(rows)
                        rows, held = [], 0
                fresh.append(r)
                arrived += len(r[2])
                last = r[0]
        if fresh:
            sift()
        if rows:
            yield solve(rows)

    return run


def _split(width: int, length: int, gram: int):
    """Rows (ah, ch, f, at, context): windows f, f + 1, ... of a context, with their anchor at ``at`` (null: still to be
    found) -> a row for each band of ``width`` places of the anchor in them, with the band's key and the piece's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for ah, ch, f, at, t in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if at is None:
                    at = int(np.argmin(_gram_hashes(t[:length], gram) & ~_LOW))
                n = len(t) - length + 1
                for band in range(max(0, at - n + 1) // width, at // width + 1):
                    low, high = max(0, at - band * width - width + 1), min(n - 1, at - band * width)
                    # what every window of the band holds, from its last start to its first end
                    core = t[at - band * width : at - band * width - width + 1 + length]
                    key = xxhash.xxh3_64_intdigest(core + band.to_bytes(2, "little"), ah & 0xFFFF) - (1 << 63)
                    piece = t[low : high + length]
                    for c, value in zip(out, (ah, ch, f + low, at - low, key, xxhash.xxh3_64_intdigest(piece) - (1 << 63), piece), strict=True):
                        c.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["ah", "ch", "f", "at", "key", "ph", "context"])

    return run


_RUN = "ah long, ch long, runs array<struct<f:int,t:int>>"


def _subdivided(crowd: DataFrame, length: int, gram: int) -> DataFrame:
    """(ah, ch, f, t): runs of repeated windows of the contexts of hot anchors."""
    rows = crowd.select("ah", "ch", F.lit(0).alias("f"), F.lit(None).cast("int").alias("at"), "context")
    found = None
    for width in BANDS:
        pieces = materialise(rows.mapInArrow(_split(width, length, gram), "ah long, ch long, f int, at int, key long, ph long, context binary"), "pieces")
        kinds = materialise(pieces.groupBy("key", "ph").agg(F.count("*").alias("n"), F.first("context").alias("context"), F.first("at").alias("at")), "piece-kinds")
        many = materialise(kinds.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "piece-keys")
        thin = kinds.join(many.where(F.col("m") <= DENSE), "key").select("key", "ph", "context").repartition("key").sortWithinPartitions("key")
        runs = thin.mapInArrow(_shards(length), _RUN).select(F.col("ah").alias("key"), F.col("ch").alias("ph"), F.explode("runs").alias("r")).select("key", "ph", F.col("r.f").alias("lo"), F.col("r.t").alias("hi"))
        whole = kinds.where("n > 1").select("key", "ph", F.lit(0).alias("lo"), (F.octet_length("context") - length).alias("hi"))
        again = pieces.select("ah", "ch", "f", "key", "ph").join(materialise(runs.union(whole), "piece-runs"), ["key", "ph"])
        again = again.select("ah", "ch", (F.col("f") + F.col("lo")).cast("int").alias("f"), (F.col("f") + F.col("hi")).cast("int").alias("t"))
        found = again if found is None else found.union(again)
        hot = many.where(F.col("m") > DENSE)
        if hot.isEmpty():
            break
        rows = pieces.join(hot, "key").select("ah", "ch", "f", "at", "context")
    return found


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, lo, hi): ranges of places of a document at which repeated strings of ``length`` bytes start.

    ``docs`` has doc_id, h (xxhash64 of the text) and text.
    """
    rows = materialise(docs.select("doc_id", "h", "text").mapInArrow(_context_rows(length, gram), "doc_id long, h long, lo long, hi long, ah long, ch long"), "contexts")
    # written first, so that the join that follows has two plain shuffles, which Spark can split where an anchor is hot
    shared = rows.groupBy("ah").agg(F.count("*").alias("n"), F.min("ch").alias("a"), F.max("ch").alias("z")).where("n > 1").select("ah", (F.col("a") == F.col("z")).alias("one"))
    shared = materialise(shared, "shared-anchors")
    found = materialise(rows.join(shared, "ah"), "shared-contexts")
    alone = found.where("one").select("doc_id", "h", "lo", "hi")
    mixed = found.where("NOT one")
    kinds = materialise(mixed.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "lo", "hi")).alias("at")), "kinds")
    where = kinds.groupBy(F.col("at.doc_id").alias("k"), F.col("at.h").alias("kh")).agg(F.collect_list(F.struct("at.lo", "at.hi", "ah", "ch")).alias("want"))
    text = docs.join(where, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh"))).select("text", "want").mapInArrow(_cut_contexts(length), "ah long, ch long, context binary")
    # rows that repeat id and text give a context more than once
    text = materialise(text.dropDuplicates(["ah", "ch"]), "context-text")
    dense = materialise(kinds.groupBy("ah").agg(F.count("*").alias("m")).where(F.col("m") > DENSE).select("ah"), "dense")
    thin = text.join(dense, "ah", "left_anti").repartition("ah").sortWithinPartitions("ah")
    runs = thin.mapInArrow(_shards(length, gram), _RUN).select("ah", "ch", F.explode("runs").alias("r")).select("ah", "ch", "r.f", "r.t")
    if not dense.isEmpty():
        runs = runs.union(_subdivided(text.join(dense, "ah", "left_semi"), length, gram))
    runs = runs.union(kinds.where("n > 1").select("ah", "ch", F.lit(0).alias("f"), (F.col("at.hi") - F.col("at.lo")).cast("int").alias("t")))
    runs = materialise(runs, "runs")
    some = mixed.join(runs, ["ah", "ch"]).select("doc_id", "h", (F.col("lo") + F.col("f")).alias("lo"), (F.col("lo") + F.col("t")).alias("hi"))
    return alone.union(some)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes long, spans array<struct<start,end>>, kept binary), a row for each row of ``docs``.

    Spans are the maximal runs of removed bytes, [start, end) in the UTF-8 text. A null text counts as empty. Copies,
    repeated rows included, remove each other. Texts shorter than ``length`` lose nothing. Extra columns are ignored;
    an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, spans, kept = [], [], []
            for t, ranges in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = t or b""
                runs: list[dict] = []
                for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                    if runs and lo <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], hi + length)
                    else:
                        runs.append({"start": lo, "end": hi + length})
                edges = [0, *(x for r in runs for x in (r["start"], r["end"])), len(t)]
                n.append(len(t))
                spans.append(runs)
                kept.append(b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    t = keyed(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = repeated_ranges(t, length).groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    found = materialise(found, "ranges").select(F.col("doc_id").alias("k"), F.col("h").alias("kh"), "ranges")
    t = t.join(found, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh")), "left").select("doc_id", "text", "ranges")
    return t.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


#: The same result as SQL, for tables with one row an id.
ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, p, b[p + 1 : p + 200] AS s FROM (SELECT doc_id, b, unnest(range(0, n - 199)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS c FROM w) WHERE c > 1),
g AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS brk FROM r),
i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM g),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY doc_id, k),
edges AS (
  SELECT doc_id, a AS stop, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM spans
  UNION ALL SELECT d.doc_id, d.n, coalesce(max(z), 0) FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.n),
kept AS (SELECT e.doc_id, sha256(unhex(string_agg(hex(d.b[e.start + 1 : e.stop]), '' ORDER BY e.start))) AS kept_sha256 FROM edges e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(sum(s.z - s.a), 0) AS BIGINT) AS n_removed, count(s.a) AS n_spans, k.kept_sha256
FROM d JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.n, k.kept_sha256
"""
