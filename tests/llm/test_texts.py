"""Line dedup, substring dedup, suffix arrays, sketches, mixing and BPE against brute force."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from framelode.llm import bpe, linededup, mixing, sketch, substring, suffix
from framelode.llm.queries import ORACLES


def ranked(spark, docs):
    """Distinct (doc_id, h, text) in the order that ranks documents: ids, none first, then hash."""
    from pyspark.sql import functions as F

    got = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").distinct().collect()
    return sorted(((r.doc_id, r.h, r.text) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_lines(spark, docs):
    order = [(i, no, linededup.normalise(line)) for i, r in enumerate(ranked(spark, docs)) for no, line in enumerate((r[2] or "").split("\n"))]
    order = [x for x in order if x[2]]
    rank = ranked(spark, docs)
    first = {}
    for i, no, w in order:
        first.setdefault(" ".join(w), (i, no))
    want = {}
    for i, no, w in order:
        key = " ".join(w)
        if first[key] != (i, no):
            want[(i, no)] = (first[key], False)
            continue
        near = [p for k, p in first.items() if p < (i, no) and len(w) >= 5 and len(k.split(" ")) >= 5 and linededup.within_one(w, k.split(" "))]
        if near:
            want[(i, no)] = (min(near), True)
    where = {(r[0], r[1]): i for i, r in enumerate(rank)}
    got = {(where[(r.doc_id, r.h)], r.line): ((r.first_doc_id, r.first_line), r.near) for r in linededup.repeated_lines(docs).distinct().collect()}
    assert got == {k: ((rank[p[0]][0], p[1]), near) for k, (p, near) in want.items()}
    assert any(near for _, near in want.values())


def test_one_edit():
    w = "a b c d e f".split()
    assert linededup.within_one(w, w) and linededup.within_one(w, w[1:]) and linededup.within_one(w[:-1], w)
    assert linededup.within_one(w, ["a", "x", *w[2:]]) and not linededup.within_one(w, ["b", "a", *w[2:]])
    assert not linededup.within_one(w, w[2:]) and linededup.within_one([], ["a"])


def test_removed_lines_and_columns(docs, rows):
    out = linededup.remove_lines(docs)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got[7 * 3] == 1 and got[8 * 3] == 1 and got[9 * 3] == 1  # null and blank texts stay
    assert 3 in got and all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None and r.doc_id > 3}
    assert texts[18 * 3] == "Same short line." and 19 * 3 not in texts


def removed(texts, length=200):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        out.append((len(t), sum(m), bytes(x for x, y in zip(t, m, strict=True) if not y)))
    return out


@pytest.mark.parametrize("dense", [256, 1, 2])
def test_repeated_bytes(docs, rows, monkeypatch, dense):
    monkeypatch.setattr(suffix, "DENSE", dense)
    got = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in suffix.remove_repeats(docs).collect()), key=str)
    want = removed([(r[1] or "").encode() for r in rows])
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=str)


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 30, 256):
        for n in (0, 1, 2, 3, 9, 64, 300):
            t = rng.integers(0, k, n).astype(np.uint8)
            b = t.tobytes()
            assert suffix.suffix_array(t).tolist() == sorted(range(n), key=lambda i: b[i:])
    for k, n in ((300, 50), (300, 2000), (5000, 3000), (2, 3000)):
        t = np.unique(rng.integers(0, k, n), return_inverse=True)[1]
        t[n // 2 :] = t[: n - n // 2]
        assert suffix.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_arrays_with_many_names():
    """A text whose names of the first level are far more than 256, so that the recursion goes over names."""
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 7)).astype(np.uint8)) for _ in range(3000)]
    b = b" ".join(words[i] for i in rng.integers(0, 3000, 6000))
    b += b[100:9000] + b"\x00\xff" + b[5000:7000]
    t = np.frombuffer(b, np.uint8)
    sa = suffix.suffix_array(t)
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    common = suffix.permuted_prefixes(t, sa)
    for i, j in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        n = int(common[j])
        assert b[i : i + n] == b[j : j + n] and (max(i, j) + n == len(b) or b[i + n] != b[j + n])


def test_long_text_is_cut_in_pieces(spark):
    """Texts of over four million bytes: repeats are found across the places where they are cut."""
    rng = np.random.default_rng(2)
    long = rng.integers(97, 123, (4 << 20) + 60_000).astype(np.uint8).tobytes()
    cut = (4 << 20) - 150
    one = long[: cut - 500] + long[:500] + long[cut:]
    two = b"-" * 7 + long[cut - 100 : cut + 400] + b"+"
    df = spark.createDataFrame([(1, one.decode()), (2, two.decode())], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix.remove_repeats(df).collect()}
    assert got == {1: [(0, 500), (cut - 500, cut + 400)], 2: [(107, 507)]}


def test_contexts_that_share_no_window_stay_out_of_the_array(spark, monkeypatch):
    """Strings of 200 bytes in two texts are found wherever their anchor stands; contexts with only 115 in common don't go into the array."""
    rng = np.random.default_rng(6)
    some = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    arrays = []
    real = suffix.repeated_windows
    monkeypatch.setattr(suffix, "repeated_windows", lambda text, starts, length: arrays.append(len(text)) or real(text, starts, length))

    def runs(shared):
        a, b = some(299) + b"A" + shared + b"B" + some(299), some(309) + b"C" + shared + b"D" + some(289)
        own, lo, hi, ah, ch = suffix.contexts([a, b])
        places = defaultdict(list)
        for o, x, y, k, c in zip(*(v.tolist() for v in (own, lo, hi, ah, ch)), strict=True):
            if (ah == k).sum() > 1:
                places[k, c].append((o, x, y))
        kinds = sorted((k, c, [a, b][w[0][0]][w[0][1] : w[0][2] + 200]) for (k, c), w in places.items())
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in kinds], pa.int64()), pa.array([r[1] for r in kinds], pa.int64()), pa.array([r[2] for r in kinds], pa.binary())], names=["ah", "ch", "context"])
        out = [r for part in suffix._shards(200, 32)(iter([batch])) for r in part.to_pylist()]
        found = {(o, x + w) for r in out for o, x, _ in places[r["ah"], r["ch"]] for y in r["runs"] for w in range(y["f"], y["t"] + 1)}
        # contexts that come twice as a whole are counted, not searched
        return sorted(found | {(o, w) for copies in places.values() if len(copies) > 1 for o, x, y in copies for w in range(x, y + 1)})

    for _ in range(40):
        n = int(rng.integers(200, 206))
        assert runs(some(n)) == [(0, 300 + i) for i in range(n - 199)] + [(1, 310 + i) for i in range(n - 199)]
    arrays.clear()
    for _ in range(40):
        assert runs(some(115)) == []
    assert not arrays


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def overlap(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / min(len(a), len(b)) if a and b else float(a == b)


def test_sketches(docs, rows):
    """Against sets of word tuples: near_* follow the true containment, and are exact where all or nothing is shared."""
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in sketch.compare_edited(docs).collect()), key=str)
    ids = sorted({r[0] for r in rows if r[0] is not None})
    assert len(got) == len(rows)
    one = {r[0]: r[1] or "" for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    errors, equal = [], defaultdict(set)
    for a, b in zip(ids, ids[1:], strict=False):
        if a in one and b in one:
            t, n = one[a], len(one[a]) // 2
            edited = t[: len(t) - n] + one[b][:n]
            r = next(g for g in got if g[0] == a)
            assert r[1:3] == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            equal[t].add(r[3])
            equal[edited].add(r[4])
            for near, other in ((r[5], edited), (r[6], one[b])):
                want = overlap(t, other)
                if want in (0.0, 1.0) and min(len(shingles(t)), len(shingles(other))) != 1:
                    assert near == want
                errors.append(abs(near - want))
    assert all(len(v) == 1 for v in equal.values()) and np.mean(errors) < 0.08
    assert np.array_equal(sketch.from_text(sketch.to_text(sketch.sketch("a b c d e f g"))), sketch.sketch("a b c d e f g"))


def test_short_texts_in_long_ones():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(0, 5000, 200_000)]
    found = []
    for i in range(0, 100_000, 200):
        short, long = " ".join(words[i : i + 20]), " ".join(words[max(0, i - 200) : i + 220])
        found.append(sketch.containment(sketch.sketch(short), sketch.sketch(long)))
        other = " ".join(words[i + 100_000 - 400 : i + 100_000])
        assert sketch.containment(sketch.sketch(short), sketch.sketch(other)) == 0.0
    assert min(found) == 1.0 and len(found) == 500
    half = [" ".join([*words[i : i + 60], *words[i + 1000 : i + 1060]]) for i in range(0, 20_000, 100)]
    long = [" ".join(words[max(0, i - 500) : i + 100]) for i in range(0, 20_000, 100)]
    error = [sketch.containment(sketch.sketch(h), sketch.sketch(t)) - overlap(h, t) for h, t in zip(half, long, strict=True)]
    assert abs(np.mean(error)) < 0.02 and np.mean(np.abs(error)) < 0.08
    a, b = sketch.sketch(" ".join(words[:300])), sketch.sketch(" ".join(words[1000:1400]))
    assert sketch.containment(sketch.merge(a, b), a) == sketch.containment(b, sketch.merge(a, b)) == 1.0
    assert sketch.containment(sketch.sketch(None), sketch.sketch(" ")) == 1.0 and sketch.containment(a, sketch.sketch("")) == 0.0


def test_buckets(spark):
    from pyspark.sql import functions as F

    for at in ([], [5], [1, 2], [-3, 0, 9, 10, 40], list(range(0, 300, 7))):
        got = spark.range(-5, 60).select("id", sketch._bucket(at, F.col("id")).alias("b")).collect()
        assert all(r.b == sum(x <= r.id for x in at) for r in got)


def test_single_document(spark):
    r = sketch.compare_edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0


def test_mix(spark, docs, rows, tmp_path):
    from pyspark.sql import functions as F

    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    c = duckdb.connect()
    path = str(tmp_path / "d.parquet")
    docs.select("doc_id", "text", "source").coalesce(1).write.parquet(path)
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = c.sql(ORACLES["op3_source_mixing"]).project("doc_id, size, source_size, target, taken").fetchall()
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert all(t <= 3 * s for _, s, _, _, t in want) and len(want) == len(rows)
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r[4] for r in want)


def test_inclusion_follows_the_odds(spark):
    """Frequencies over many documents of a size are their expected copies; the sum of a source is its target's."""
    from pyspark.sql import functions as F

    rows = [(i, " ".join(["w"] * (10, 20, 40, 80, 400)[i % 5]) + f" {i}", "abc"[i % 3]) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("seen", F.col("expected") - F.col("whole")).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.source, r.size].append(r)
    for rs in groups.values():
        p, mean = rs[0].expected, np.mean([r.copies for r in rs])
        assert len({r.expected for r in rs}) == 1 and abs(mean - p) < 4 * (rs[0].seen * (1 - rs[0].seen) / len(rs)) ** 0.5 + 0.01
        assert all(r.whole <= r.copies <= r.whole + 1 <= 4 and r.copies <= 3 for r in rs)
    for source in "abc":
        rs = [r for r in got if r.source == source]
        sizes = sorted({(r.size, r.expected) for r in rs})
        loose = [(s, e) for s, e in sizes if e < 3]
        assert all(e / s == pytest.approx(loose[0][1] / loose[0][0]) for s, e in loose)  # odds follow the size
        assert abs(sum(r.size * r.copies for r in rs) - rs[0].target) <= 201
    # where documents differ in their odds, the rank isn't that of the random numbers
    part = [r for r in got if r.source == "c" and 0 < r.seen < 1]
    by_bits = sorted(part, key=lambda r: r.bits)
    assert len({r.copies - r.whole for r in by_bits[: sum(r.copies - r.whole for r in part)]}) == 2


def test_targets_share_excess_by_weight(spark):
    t = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(t).collect()}
    assert got["a"] == 30 and got["b"] == 300 and got[None] == 15 and got["c"] == 770
    assert sum(got.values()) == 1115


def test_bpe(docs, rows):
    tok = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert text == (r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=str) == sorted(want, key=str)
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs)).collect()), key=str)
    assert back == sorted(((r[0], r[1] or "") for r in rows), key=str)


def test_bpe_joins_at_any_cut():
    import random

    tok, rng = Tokenizer.from_file(bpe.default_vocabulary()), random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "é", "日", "1", "'s", "'", "<|endoftext|>", "\t", " ", ".", "Z", "👍", "\r\n", " the"]
    for mean in (8, 64):
        enc = bpe.Encoder(bpe.default_vocabulary(), mean=mean)
        for _ in range(150):
            t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
            assert enc.encode(t.encode()).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_shared_chunks_are_known():
    enc = bpe.Encoder(bpe.default_vocabulary(), mean=64)
    t = " ".join(f"word{i}" for i in range(4000)).encode()
    u = b"something before " + t
    table = {(x, y): enc.chunk(part) for x, y, part in bpe.chunks(t, 64)}
    whole = enc.encode(u)
    known = {k: table[(x, y)] for k, (x, y, _) in enumerate(bpe.chunks(u, 64)) if (x, y) in table}
    before = enc.encoded
    assert np.array_equal(enc.encode(u, known), whole)
    assert enc.encoded - before < 0.45 * len(u) and len(known) > 0.9 * len(bpe.chunks(u, 64))


def test_shared_map(spark):
    values = [5, -7, (1 << 40) + 9, -(1 << 60), bpe.MAP_BITS - 1]
    bits = bpe.shared_map(spark.createDataFrame([(v, 0) for v in values], "c1 long, c2 long"))
    assert len(bits) == bpe.MAP_BITS // 8 and all(bpe._hit(bits, v) for v in values) and sum(map(int.bit_count, bits)) == 5


def test_empty_tables(empty):
    for got in (linededup.repeated_lines(empty), linededup.remove_lines(empty), substring.remove_repeats(empty), suffix.remove_repeats(empty), sketch.compare_edited(empty), mixing.mix(empty), mixing.mixture(empty), bpe.round_trip(empty)):
        assert got.count() == 0
