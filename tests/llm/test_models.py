"""Language ID, HTML extraction, nearest neighbours and the pipeline."""

import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from framelode.llm import ann, html_main, langid

DIR = "/root/testdata/sf0.001"


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model = langid.init(["a", "b", "c"], hidden=3)
    p = {k: v.astype(np.float64) for k, v in model["p"].items()}
    x, kinds = rng.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1])

    def loss():
        z = langid._logits(p, x)[0]
        z = z - z.max(axis=2, keepdims=True)
        return -(z - np.log(np.exp(z).sum(axis=2, keepdims=True)))[:, np.arange(4), kinds].mean()

    logits, f, b = langid._logits(p, x)
    d = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
    d[:, np.arange(4), kinds] -= 1
    d /= x.size
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    langid._backward(p, "f", x, f, d @ p["fV"].T, grad)
    langid._backward(p, "b", x[::-1], b, (d @ p["bV"].T)[::-1], grad)
    for k in ("fUz", "fUr", "fUn", "bUn", "bUz"):
        at = (1, 2)
        keep = p[k][at]
        step = 1e-3
        p[k][at] = keep + step
        up = loss()
        p[k][at] = keep - step
        down = loss()
        p[k][at] = keep
        assert grad[k][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-5)


def test_fast_labels_are_the_network_s():
    model = langid.init(["a", "b"], hidden=4)
    net = langid.Labeller(model)
    texts = ["héllo wörld " * 30, "x", "abc" * 64, ""]
    got = net.documents([t.encode() for t in texts])
    for t, probs in zip(texts, got, strict=True):
        total = np.zeros(2)
        for at in range(0, len(t.encode()), langid.WINDOW):
            z = langid._logits(model["p"], np.frombuffer(t.encode()[at : at + langid.WINDOW], np.uint8)[:, None])[0]
            e = np.exp(z - z.max(axis=2, keepdims=True))
            total += (e / e.sum(axis=2, keepdims=True)).sum(axis=(0, 1))
        assert probs == pytest.approx(total / max(1, len(t.encode())), abs=1e-4)


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_language_id_of_odd_rows(docs, rows, empty):
    model = langid.fit(docs)
    got = langid.predict(docs, model)
    assert got.count() == len(rows)
    und = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    assert und == {7 * 3, 8 * 3, 9 * 3, 12 * 3, None}
    assert langid.keep_known(docs, model, 0.0).columns == docs.columns
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a></li></ul></nav><header>Site header words</header><!-- note --><div class="cookie-notice">We use cookies here</div>
<article><h1>Head&amp;line</h1><p>First   <b>para<br>graph</b> with&nbsp;words.</p><div class="ad">Buy this now</div><p>Second one, <a href="/x">linked</a> text.<form><input> Sign up</form>
<p>Third{0}</p></article><aside>Side words</aside><div id="comments"><p>A reader says so</p></div><footer>&copy; foot</footer></body></html>"""


def weights(pages):
    inside, outside = Counter(), Counter()
    for p in pages:
        x, y = html_main.counts(p)
        inside.update(x)
        outside.update(y)
    return html_main.weights_of(inside, outside)


def test_main_text():
    w = weights([PAGE.format(i) for i in range(5)])
    assert w[""] > 0 and all(v < 0 for k, v in w.items() if k)
    assert html_main.main_text(PAGE.format(""), w) == "Head&line\nFirst para graph with words.\nSecond one, linked text.\nThird"
    bare = "<html><body><div><a>one</a> <a>two</a></div><div><p>" + "word " * 60 + "</p><p>" + "more " * 40 + "</p></div></body></html>"
    assert html_main.main_text(bare, w).endswith("\n" + "more " * 39 + "more")
    for odd in ("", "<p>", "<!-- open", "<script>x", "<a " * 2000, "plain &lt;text&gt;", "<nav>a<article>b c d</article>", "<p a='" * 300, "</p></div></nav>" * 50):
        html_main.main_text(odd, w)
    assert html_main.main_text("plain &lt;text&gt;", w) == "plain <text>" and html_main.main_text(None, w) == ""
    assert html_main.main_text("<nav>menu words<article>b c d</article>", w) == "b c d"


BODY = "<p>" + "some words of the story that go on for a while " * 6 + "</p>"
STORY = " ".join(["some words of the story that go on for a while"] * 6)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body><article><svg class="i"/>{BODY}<p>After it.</p></article></body>', f"{STORY}\nAfter it."),
        (f'<body><div class="wrap has-sidebar"><article>{BODY}</article></div></body>', STORY),
        (f'<body><div class="layout no-sidebar"><article>{BODY}</article><div class="sidebar">Side.</div></div></body>', STORY),
        (f'<body><article>{BODY}<section class="related-work"><p>Earlier work.</p></section><p class="social-history">Years.</p></article></body>', f"{STORY}\nEarlier work.\nYears."),
        (f"<body><article>{BODY}<p data-x=don't>It's here.</p><p title=\"a > b\">End.</p></article></body>", f"{STORY}\nIt's here.\nEnd."),
        (f'<body><div class="sidebar"><p>Side</p><main>{BODY}</main></div></body>', f"{STORY}"),
        (f'<body><article>{BODY}</article><section id="comments"><article><p>{"I think so too " * 9}</p></article></section></body>', STORY),
        (f'<body><div id="cookie-notice">{"We use cookies " * 20}</div><div><p>{STORY}</p></div><div class="comment-list"><p>{"So do I " * 20}</p></div></body>', STORY),
        (f'<body><ul class="menu"><li><a>One</a></li><li><a>Two</a></li></ul><div>{BODY}<ul><li>An item.</li><li>Another one.</li></ul>{BODY}</div><footer>Foot</footer></body>', f"{STORY}\nAn item.\nAnother one.\n{STORY}"),
        (f'<body><article><header><h1>Title</h1></header>{BODY}<aside>Aside.</aside><p role="note">Noted.</p><div hidden>No.</div></article></body>', f"Title\n{STORY}\nNoted."),
    ],
)
def test_odd_pages(page, text):
    for w in (weights([PAGE.format(i) for i in range(5)]), weights([])):
        got = html_main.main_text(page, w)
        # beside a mark stands text that no mark covers; it is not content
        assert got == text


def test_region_is_the_best_sum():
    rng = np.random.default_rng(0)
    w = {"": 0.7, "p": -0.4, "*": -2.0, "#": -1.0}
    for _ in range(50):
        found = [("p", "", False, False) if rng.random() < 0.5 else ("x", "", False, False) if rng.random() < 0.5 else ("", "w " * int(rng.integers(1, 5)), False, False) for _ in range(15)]
        score = [w[""] * len(t.split()) if not n else w.get(n, w["*"]) for n, t, _, _ in found]
        best = max([0.0, *(sum(score[i:j]) for i in range(15) for j in range(i + 1, 16))])
        a, b = html_main.region(found, w)
        assert sum(score[a:b]) == pytest.approx(best)


class Dom(HTMLParser):
    """Text of the article of a page, by a parser of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.end(tag)

    def handle_endtag(self, tag):
        self.end(tag)
        self.depth -= tag == "article"

    def end(self, tag):
        if tag in ("article", "p", "h1", "div"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-2, "u", "")], "page_id long, url string, html string")
    got = html_main.extract(pages.select("page_id", "url", "html").union(odd)).collect()
    assert len(got) == pages.count() + 3 and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    for r in pages.collect():
        dom = Dom()
        dom.feed(r.html)
        dom.close()
        assert texts[r.page_id] == "\n".join(t for x in dom.blocks if (t := " ".join(x.split())))
    assert html_main.extract(pages.limit(0)).count() == 0


def test_weights_are_summed_over_all_pages(spark):
    pages = [PAGE.format(" x" * i) for i in range(7)] + ["<p>no mark</p>", None, ""]
    df = spark.createDataFrame([(p,) for p in pages], "html string").repartition(4)
    assert html_main.fit(df) == pytest.approx(weights([p or "" for p in pages]))
    assert html_main.fit(df.limit(0)) == weights([])


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    n = 1500
    v = rng.normal(size=(n, 16)).astype(np.float32) * rng.uniform(0.5, 2, (n, 1)).astype(np.float32)
    v[100:140] = v[100]
    rows = [(i, v[i].tolist(), "x") for i in range(n)] + [(5000, None, ""), (5020, [0.0] * 16, ""), (5040, [float("nan")] * 16, ""), (5060, [None] * 16, ""), (5080, [1.0, 2.0], ""), (None, v[0].tolist(), ""), (20, v[20].tolist(), "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    s = v.astype(np.float64) @ v.astype(np.float64).T
    hits = 0
    for q in range(0, n, 20):
        want = sorted((-s[q, i], i) for i in range(n) if i != q)[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        assert all(m[2] == pytest.approx(s[q, m[1]], abs=1e-12) and m[1] != q for m in mine)
        hits += len({m[1] for m in mine} & {i for _, i in want})
    assert hits / (20 * n / 20) > 0.95
    assert set(got) == set(range(0, n, 20))
    assert ann.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(few).collect()) == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in c.STAGES:
        before = docs
        docs = c.materialise(stage(spark, docs, DIR), name)
        assert docs.count() > 0
        if name != "bpe":
            assert docs.columns == before.columns
    assert c.run(spark, DIR).exceptAll(docs).count() == 0
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
