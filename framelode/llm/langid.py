"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in windows, left to right and right to left, and labels every byte with
probabilities of the languages; a document's probabilities are the mean over all of its bytes. It is trained here, in
numpy, by backpropagation through time over windows of a bounded sample of labelled documents, every position with the
document's label as its target. Every byte of every text is read; language, source and id never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Sample that the network is fitted on: documents of each language that is there (first by hash), windows of a document
#: (evenly over the whole text).
DOCS_PER_LANG = 300
WINDOWS_PER_DOC = 12
WINDOW = 64
HIDDEN = 8
STEPS = 220
BATCH = 192
FOLDS = 5
#: Mean probability below which a document is taken to be in no language known.
MIN_SCORE = 0.35
_BLOCK = 2048
_GATES = ("z", "r", "n")


def init(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        for g in _GATES:
            p[f"{d}W{g}"] = rng.normal(0, 0.3, (256, hidden)).astype(np.float32)
            p[f"{d}U{g}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden)).astype(np.float32)
        p[f"{d}V"] = rng.normal(0, 0.3, (hidden, len(langs))).astype(np.float32)
    p["c"] = np.zeros(len(langs), np.float32)
    return {"langs": langs, "p": p}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(p: dict, d: str, x: np.ndarray) -> list[tuple]:
    """States of one direction for bytes ``x`` (time, batch); each step keeps what its gradient needs."""
    h = np.zeros((x.shape[1], p[f"{d}Uz"].shape[0]), np.float32)
    out = []
    for t in range(x.shape[0]):
        z = _sigmoid(p[f"{d}Wz"][x[t]] + h @ p[f"{d}Uz"])
        r = _sigmoid(p[f"{d}Wr"][x[t]] + h @ p[f"{d}Ur"])
        u = h @ p[f"{d}Un"]
        n = np.tanh(p[f"{d}Wn"][x[t]] + r * u)
        new = h + z * (n - h)
        out.append((h, z, r, u, n, new))
        h = new
    return out


def _backward(p: dict, d: str, x: np.ndarray, states: list[tuple], dh_out: np.ndarray, grad: dict) -> None:
    """Gradients through time of one direction, given those of its states (time, batch, hidden)."""
    dh = np.zeros_like(dh_out[0])
    for t in range(x.shape[0] - 1, -1, -1):
        h, z, r, u, n, _ = states[t]
        dh = dh + dh_out[t]
        dn = dh * z * (1 - n * n)
        dz = dh * (n - h) * z * (1 - z)
        dr = dn * u * r * (1 - r)
        du = dn * r
        dh = dh * (1 - z) + dz @ p[f"{d}Uz"].T + dr @ p[f"{d}Ur"].T + du @ p[f"{d}Un"].T
        for g, dg, du_g in (("z", dz, dz), ("r", dr, dr), ("n", dn, du)):
            np.add.at(grad[f"{d}W{g}"], x[t], dg)
            grad[f"{d}U{g}"] += h.T @ du_g


def _logits(p: dict, x: np.ndarray) -> tuple[np.ndarray, list, list]:
    f, b = _forward(p, "f", x), _forward(p, "b", x[::-1])
    hf, hb = np.stack([s[-1] for s in f]), np.stack([s[-1] for s in b])[::-1]
    return hf @ p["fV"] + hb @ p["bV"] + p["c"], f, b


def train(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> dict | None:
    """A model from windows and their languages, balanced over languages; None without any. Reruns agree."""
    langs = sorted(set(labels))
    if not langs:
        return None
    model = init(langs, hidden, seed)
    p, rng = model["p"], np.random.default_rng(seed)
    data = np.zeros((len(windows), WINDOW), np.uint8)
    for i, w in enumerate(windows):
        data[i] = np.resize(np.frombuffer(w, np.uint8), WINDOW)
    y = np.array([langs.index(v) for v in labels])
    of = [np.flatnonzero(y == k) for k in range(len(langs))]
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, steps + 1):
        kinds = rng.integers(0, len(langs), batch)
        rows = np.array([of[k][rng.integers(0, len(of[k]))] for k in kinds])
        x = data[rows].T
        logits, f, b = _logits(p, x)
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        d = e / e.sum(axis=2, keepdims=True)
        d[:, np.arange(batch), kinds] -= 1
        d /= x.size
        grad = {k: np.zeros_like(a) for k, a in p.items()}
        hf, hb = np.stack([s[-1] for s in f]), np.stack([s[-1] for s in b])[::-1]
        grad["fV"], grad["bV"], grad["c"] = np.einsum("tbh,tbc->hc", hf, d), np.einsum("tbh,tbc->hc", hb, d), d.sum(axis=(0, 1))
        _backward(p, "f", x, f, d @ p["fV"].T, grad)
        _backward(p, "b", x[::-1], b, (d @ p["bV"].T)[::-1], grad)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, a in p.items():
            m[k] += 0.1 * (grad[k] - m[k])
            v[k] += 0.01 * (grad[k] ** 2 - v[k])
            a -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


class Labeller:
    """Probabilities of every byte, pooled over documents; gates are halved once so that a tanh makes a sigmoid."""

    def __init__(self, model: dict):
        self.langs, self.p = model["langs"], {}
        for k, a in model["p"].items():
            self.p[k] = np.ascontiguousarray(a * (0.5 if k[1:] in ("Wz", "Wr", "Uz", "Ur") else 1), np.float32)

    def _direction(self, d: str, x: np.ndarray, logits: np.ndarray, order: range) -> None:
        p, n, k = self.p, x.shape[1], self.p["fUz"].shape[0]
        wz, wr, wn, uz, ur, un = (p[d + g] for g in ("Wz", "Wr", "Wn", "Uz", "Ur", "Un"))
        out = np.ascontiguousarray(p[d + "V"].T)
        h = np.zeros((n, k), np.float32)
        z, r, c, a = (np.empty((n, k), np.float32) for _ in range(4))
        for t in order:
            i = x[t]
            np.take(wz, i, axis=0, out=z, mode="clip")
            np.take(wr, i, axis=0, out=r, mode="clip")
            np.take(wn, i, axis=0, out=c, mode="clip")
            z += np.matmul(h, uz, out=a)
            np.tanh(z, out=z)
            r += np.matmul(h, ur, out=a)
            np.tanh(r, out=r)
            r += 1
            np.matmul(h, un, out=a)
            a *= r
            a *= 0.5
            c += a
            np.tanh(c, out=c)
            c -= h
            z += 1
            z *= 0.5
            c *= z
            h += c
            logits[:, t] += out @ h.T

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Sums over positions of the probabilities: bytes (time, windows) -> (languages, windows)."""
        logits = np.repeat(self.p["c"], x.size).reshape(-1, *x.shape)
        self._direction("f", x, logits, range(len(x)))
        self._direction("b", x, logits, range(len(x) - 1, -1, -1))
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.sum(axis=1)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(documents, languages): mean probabilities over all bytes; zeros for an empty text."""
        total = np.zeros((len(texts), len(self.langs)))
        full: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        rest: dict[int, list[tuple[int, bytes]]] = {}
        held = 0

        def flush() -> None:
            nonlocal held
            if full:
                rows, who = np.concatenate(full), np.concatenate(owner)
                for at in range(0, len(rows), _BLOCK):
                    self._add(total, np.ascontiguousarray(rows[at : at + _BLOCK].T), who[at : at + _BLOCK])
            full.clear()
            owner.clear()
            held = 0

        for k, t in enumerate(texts):
            n = len(t) // WINDOW
            for at in range(0, n, _BLOCK):
                part = np.frombuffer(t, np.uint8, min(_BLOCK, n - at) * WINDOW, at * WINDOW).reshape(-1, WINDOW)
                full.append(part)
                owner.append(np.full(len(part), k))
                held += len(part)
                if held >= 8 * _BLOCK:
                    flush()
            if len(t) % WINDOW:
                rest.setdefault(len(t) % WINDOW, []).append((k, t[n * WINDOW :]))
        flush()
        for length, some in rest.items():
            for at in range(0, len(some), _BLOCK):
                part = some[at : at + _BLOCK]
                self._add(total, np.ascontiguousarray(np.frombuffer(b"".join(w for _, w in part), np.uint8).reshape(-1, length).T), np.array([k for k, _ in part]))
        return total / np.maximum(1, [[len(t)] for t in texts])

    def _add(self, total: np.ndarray, x: np.ndarray, who: np.ndarray) -> None:
        for c, row in enumerate(self.windows(x)):
            total[:, c] += np.bincount(who, row, len(total))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[bytes], list[str]]:
    """Windows and languages of the bounded sample: labelled documents outside the held-out fold."""
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    t = t.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h"))
    chosen = t.select("doc_id", "h", "lang").distinct().withColumn("k", rank).where(F.col("k") <= DOCS_PER_LANG)
    chosen = chosen.select(F.col("doc_id").alias("i"), F.col("h").alias("j")).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, out = [], [], []
            for k, t, lang in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                if t:
                    for at in sorted({int(x) for x in np.linspace(0, max(0, len(t) - WINDOW), WINDOWS_PER_DOC)}):
                        ids.append(k)
                        langs.append(lang)
                        out.append(t[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["doc_id", "lang", "window"])

    # at most DOCS_PER_LANG rows a language, of 16 bytes; rows that repeat id and text give their windows once
    found = t.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))).select("doc_id", "text", "lang")
    found = found.mapInArrow(cut, "doc_id long, lang string, window binary").distinct()
    rows = sorted((r["doc_id"] or 0, r["lang"], bytes(r["window"])) for r in found.collect())
    return [r[2] for r in rows], [r[1] for r in rows]


def held_out(doc_id: F.Column) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by FOLDS; a null id is taken as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """A model of all languages of labelled documents outside the held-out fold, from a bounded sample of each.

    Rows with a null language or text teach nothing; without any others the model is None. Repeated rows count once.
    """
    return train(*sample(docs, id_col, text_col, lang_col))


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, held_out boolean, lang_pred string, score double), a row for each row of ``docs``; if ``whole``, also
    ``text`` and a struct ``row`` of all other columns, passed through.

    ``score`` is the mean probability of the language over the bytes of the whole text. A text that is null or has
    no letter is ``und`` with score 0; so is every text if nothing labelled was there to learn from. Repeated rows
    are kept, extra columns ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller(model) if model else None
        for b in batches:
            texts = b.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                for i, probs in zip(known, net.documents([texts[i].encode() for i in known]), strict=True):
                    k = int(probs.argmax())
                    langs[i], scores[i] = net.langs[k], float(min(1.0, max(0.0, probs[k])))
            out = {c: b.column(c) for c in b.schema.names if whole or c != "text"} | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    small_batches(docs.sparkSession)
    rest = [F.struct(F.lit(True).alias("_"), *(c for c in docs.columns if c != text_col)).alias("row")] if whole else []
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held_out"), *rest, F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema.fields if whole or f.name != "text")
    return t.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: dict | None, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents whose language is ``und`` or less probable than ``min_score``."""
    told = predict(docs, model, id_col, text_col, whole=True).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return told.select([F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
