import numpy as np
import pytest
import xxhash

from framelode.llm import components, simhash


def slow(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps):
    """Smallest index reachable over pairs within three bits."""
    n = len(fps)
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for i in range(n):
            for j in range(n):
                if bin(fps[i] ^ fps[j]).count("1") <= 3:
                    root[i] = min(root[i], root[j])
        if before == root:
            return root
    return root


def test_fingerprints_and_components(docs, rows):
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    fps = [slow(r[1]) for r in rows]
    root = brute(fps)
    low = {}
    for r, k in zip(rows, root, strict=True):
        if r[0] is not None:
            low[k] = min(low.get(k, r[0]), r[0])
    want = sorted(((r[0], f"{f:016x}", low.get(k)) for r, f, k in zip(rows, fps, root, strict=True)), key=str)
    assert got == want


def test_dense_variants_give_the_same_links(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre}
    for _ in range(150):
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    for _ in range(40):
        fps.add(int(rng.integers(0, 1 << 62)))
    fps = [int(np.array(f, np.uint64).view(np.int64)) if f >= 1 << 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute([f & (1 << 64) - 1 for f in fps])
    for dense in (4, 10_000):
        got = {r.node: r.root for r in components.connected_components(simhash.links(df, dense)).collect()}
        roots = [got.get(f, f) for f in fps]
        assert len(set(roots)) == len(set(want))
        assert all((roots[i] == roots[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 499), (7, 7), (None, 3), (500, 499)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(201)} | {499: 499, 500: 499}


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.similar(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_similar_texts(spark):
    """Groups against exact similarities of all pairs: pairs of 0.8 or more are together, and no others join them."""
    rng = np.random.default_rng(6)
    word = lambda: f"w{rng.integers(0, 4000)}"
    texts = []
    for _ in range(30):
        base = [word() for _ in range(int(rng.integers(80, 400)))]
        texts.append(base)
        for changes in (0, 1, 2, 4, 40):
            t = list(base)
            for i in rng.integers(0, len(t), changes * len(t) // 100):
                t[i] = word()
            texts.append(t)
    texts = [" ".join(t) for t in texts]
    for crowd in (32, 2):
        got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crowd=crowd).collect()}
        sets, seen = [shingles(t) for t in texts], 0
        for i in range(len(texts)):
            assert got[i] <= i and i // 6 == got[i] // 6
            for j in range(i):
                alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if alike >= 0.8:
                    seen += 1
                    assert got[i] == got[j]
            if got[i] != i:
                assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(texts)) if j != i) >= 0.8
        assert seen > 40
    assert len(simhash.shingle_set(None)) == len(simhash.shingle_set(b" \t")) == 0


def test_share_of_pairs_found():
    """Of pairs alike by 0.8, 0.996 should share a variant; of those alike by 0.3, 0.02."""
    rng = np.random.default_rng(2)

    def share(common, own, n=1500):
        hits = 0
        for _ in range(n):
            x = np.unique(rng.integers(0, 1 << 63, common + 2 * own, np.uint64))
            hits += bool(set(simhash.variant_keys(x[: common + own]).tolist()) & set(simhash.variant_keys(np.delete(x, slice(common, common + own))).tolist()))
        return hits / n

    assert share(160, 20) > 0.985 and share(60, 70) < 0.06


def test_crowd_around_one_text(spark):
    """Copies that are each 0.8 alike to one text and less to each other, more than a variant's members are compared."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(300)]
    texts = [" ".join(base)]
    for k in range(90):
        t = list(base)
        for i in rng.choice(60, 6, replace=False) * 5:
            t[i] = f"n{k}-{i}"
        texts.append(" ".join(t))
    texts += [" ".join(f"x{k}-{i}" for i in range(100)) for k in range(20)]
    sets = [shingles(t) for t in texts]
    assert all(len(sets[0] & s) / len(sets[0] | s) >= 0.8 for s in sets[:91])
    assert sum(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 for i in range(1, 91) for j in range(1, i)) < 100
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crowd=8).collect()}
    assert [got[i] for i in range(111)] == [0] * 91 + list(range(91, 111))


def test_similar_odd_rows(docs, rows):
    got = simhash.similar(docs).collect()
    assert len(got) == len(rows)
    blank = {r[0] for r in rows if r[0] is not None and not (r[1] or "").strip()}
    assert {r.component_id for r in got if r.doc_id in blank} == {min(blank)}


def test_keep_one_keeps_all_columns(docs):
    for groups in (simhash.similar(docs), simhash.near_duplicates(docs)):
        kept = simhash.keep_one(docs, groups=groups)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {r.component_id for r in groups.collect()}


def test_long_text_blocks():
    rng = np.random.default_rng(7)
    text = " ".join(f"w{i}" for i in rng.integers(0, 30_000, 900_000))
    assert len(text) > 4 << 20
    assert np.array(simhash.simhash(text.encode())).astype(np.int64).view(np.uint64) == slow(text)
    assert np.array(simhash.simhash(b"one two three four")).astype(np.int64).view(np.uint64) == slow("one two three four")


def test_crowds_give_a_forest_with_the_components_of_all_pairs():
    rng = np.random.default_rng(9)
    x = np.unique(np.concatenate([c ^ np.left_shift(np.int64(1), rng.integers(0, 60, 150)) ^ np.left_shift(np.int64(1), rng.integers(0, 60, 150)) for c in rng.integers(0, 1 << 62, 4)]))
    u, v = simhash._forest(x)
    roots = {n: n for n in x.tolist()}

    def root(n):
        while roots[n] != n:
            n = roots[n]
        return n

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        assert (a ^ b).bit_count() <= 3 and root(a) != root(b)
        roots[max(root(a), root(b))] = min(root(a), root(b))
    i, j = np.triu_indices(len(x), 1)
    near = np.bitwise_count(x[i] ^ x[j]) <= 3
    assert all(root(a) == root(b) for a, b in zip(x[i[near]].tolist(), x[j[near]].tolist(), strict=True))
    assert len(u) < len(x) < near.sum()


def test_few_links_and_rounds_give_the_same_components(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b)) for a, b in rng.integers(-500, 500, (600, 2))] + [(10_000 + k, 10_001 + k) for k in range(60)]
    df = spark.createDataFrame(rows, "u long, v long").repartition(7)
    one, rounds = (sorted(map(tuple, components.connected_components(df, few).collect())) for few in (10_000, 0))
    assert one == rounds and one[-1] == (10_060, 10_000)
