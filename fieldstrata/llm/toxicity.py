"""Operator 9: toxicity by a bidirectional gated recurrent network with attention, in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, words

WINDOW, STRIDE, HIDDEN, DIM, ATTEND = 64, 32, 6, 8, 8
#: Longer words take several places in the windows.
LONGEST = 40
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 12
#: Bounds of the training sample: documents of either label, and characters of a document.
PER_CLASS, SAMPLE_CHARS, EPOCHS, RATE = 1_000, 20_000, 12, 0.01
_EDGE = re.compile(r"^[^\w]+|[^\w]+$|(?<=\w)[#*$%&!|.,;:]+$")
_PART = re.compile(r"[^\W_]+|[\W_]+")


def plain(word: str) -> str:
    """A word as the network sees it: lower case, without marks at its ends."""
    w = word.lower()
    return w if w.isalnum() else _EDGE.sub("", w) or w


def units(text: str | None) -> list[str]:
    """The words of a text; those over ``LONGEST`` in pieces, which together hold all of their characters.

    A long word is cut where letters or digits meet marks; what is still too long gives pieces that share two
    characters with the next, so every trigram is in one.
    """
    found = words(text)
    if all(len(w) <= LONGEST for w in found):
        return found
    out = []
    for w in found:
        for part in _PART.findall(w) if len(w) > LONGEST else [w]:
            out += [part[i : i + LONGEST] for i in range(0, len(part) - 2, LONGEST - 2)] if len(part) > LONGEST else [part]
    return out


def word_row(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_ROWS


def char_rows(word: str) -> list[int]:
    """Rows of the character trigrams of a word, with marks for its ends."""
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + 3].encode()) % CHAR_ROWS for i in range(len(w) - 2)] or [0]


def window_starts(n: int) -> range:
    """Starts of all overlapping windows of n words; one window for texts without words."""
    return range(0, max(n - STRIDE, 1), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _gru(x: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, batch, hidden) of a gated recurrent layer over projected inputs; masked steps stay at 0."""
    t, b, h3 = x.shape
    h = h3 // 3
    state, out, cache = np.zeros((b, h), np.float32), np.empty((t, b, h), np.float32), []
    for i in range(t):
        rec = state @ u
        gates = _sigmoid(x[i, :, : 2 * h] + rec[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        n = np.tanh(x[i, :, 2 * h :] + r * rec[:, 2 * h :])
        new = (n + z * (state - n)) * mask[i]
        if keep:
            cache.append((state, z, r, n, rec[:, 2 * h :]))
        out[i] = state = new
    return out, cache


def _gru_back(grad: np.ndarray, u: np.ndarray, mask: np.ndarray, cache: list) -> tuple[np.ndarray, np.ndarray]:
    t, b, h = grad.shape
    dx, du, carry = np.empty((t, b, 3 * h), np.float32), np.zeros_like(u), np.zeros((b, h), np.float32)
    for i in range(t - 1, -1, -1):
        state, z, r, n, rec_n = cache[i]
        d = (grad[i] + carry) * mask[i]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (state - n) * z * (1 - z)
        dr = dn * rec_n * r * (1 - r)
        dx[i] = np.concatenate([dz, dr, dn], axis=1)
        drec = np.concatenate([dz, dr, dn * r], axis=1)
        du += state.T @ drec
        carry = d * z + drec @ u.T
    return dx, du


class Network:
    """Embeddings of words and of their character trigrams, two gated layers, attention pooling, one output."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        init = lambda *s, k=0.3: (g.standard_normal(s) * k).astype(np.float32)
        self.p = {
            "word": init(WORD_ROWS, DIM, k=0.01), "char": init(CHAR_ROWS, DIM, k=0.05),
            "wf": init(2 * DIM, 3 * HIDDEN), "wb": init(2 * DIM, 3 * HIDDEN), "bf": init(3 * HIDDEN, k=0), "bb": init(3 * HIDDEN, k=0),
            "uf": init(HIDDEN, 3 * HIDDEN), "ub": init(HIDDEN, 3 * HIDDEN),
            "a": init(2 * HIDDEN, ATTEND), "ab": init(ATTEND, k=0), "v": init(ATTEND), "o": init(2 * HIDDEN), "ob": np.zeros(1, np.float32),
        }

    def embed(self, vocabulary: list[str]) -> np.ndarray:
        """Input vectors of words: the word's row, and the mean of its characters' rows."""
        chars = [char_rows(w) for w in vocabulary]
        lengths = np.array([len(c) for c in chars])
        flat = np.array([i for c in chars for i in c], np.int64)
        mean = np.add.reduceat(self.p["char"][flat], np.concatenate([[0], np.cumsum(lengths)[:-1]])) / lengths[:, None] if len(chars) else np.zeros((0, DIM), np.float32)
        return np.concatenate([self.p["word"][[word_row(w) for w in vocabulary]], mean.astype(np.float32)], axis=1) if vocabulary else np.zeros((0, 2 * DIM), np.float32)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]

    def run(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits of windows from projected inputs (time, batch, gates) and a (time, batch, 1) mask."""
        p = self.p
        hf, cf = _gru(xf, p["uf"], mask, keep)
        hb, cb = _gru(xb[::-1], p["ub"], mask[::-1], keep)
        h = np.concatenate([hf, hb[::-1]], axis=2)
        k = np.tanh(h @ p["a"] + p["ab"])
        e = np.where(mask[..., 0] > 0, k @ p["v"], np.float32(-30))
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        pooled = (w[..., None] * h).sum(axis=0)
        return pooled @ p["o"] + p["ob"][0], (cf, cb, h, k, w, pooled)

    def gradients(self, index: np.ndarray, mask: np.ndarray, x: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean log loss of windows; the last value is that of the input vectors."""
        p, g = self.p, {}
        pf, pb = self.project(x)
        logit, (cf, cb, h, k, w, pooled) = self.run(pf[index], pb[index], mask, True)
        d = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
        g["o"], g["ob"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["o"]
        dh = w[..., None] * dp
        dw = (h * dp).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tba,tb->a", k, de)
        dk = de[..., None] * p["v"] * (1 - k * k)
        g["a"], g["ab"] = np.einsum("tbh,tba->ha", h, dk), dk.sum(axis=(0, 1))
        dh = dh + dk @ p["a"].T
        dxf, g["uf"] = _gru_back(np.ascontiguousarray(dh[..., :HIDDEN]), p["uf"], mask, cf)
        dxb, g["ub"] = _gru_back(np.ascontiguousarray(dh[::-1, :, HIDDEN:]), p["ub"], mask[::-1], cb)
        dxb = dxb[::-1]
        g["bf"], g["bb"] = dxf.sum(axis=(0, 1)), dxb.sum(axis=(0, 1))
        flat, into = x[index].reshape(-1, x.shape[1]), index.reshape(-1)
        g["wf"], g["wb"] = flat.T @ dxf.reshape(-1, 3 * HIDDEN), flat.T @ dxb.reshape(-1, 3 * HIDDEN)
        dx = np.zeros_like(x)
        np.add.at(dx, into, dxf.reshape(-1, 3 * HIDDEN) @ p["wf"].T + dxb.reshape(-1, 3 * HIDDEN) @ p["wb"].T)
        return g, dx


def windows_of(n: int, ids: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) places into a flat row of word numbers, and which of them hold a word."""
    at = np.array(window_starts(n))[:, None] + np.arange(WINDOW)
    inside = at < n
    return np.where(inside, ids[np.minimum(at, max(n - 1, 0)) + offset] if n else 0, 0), inside


def train(rows: list[tuple[str | None, int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network fitted to (text, label) rows.

    A text is toxic if one of its windows is: it is judged by its highest window. In the first epochs a
    window is drawn for each text, later the highest is taken; labels weigh so that both count alike.
    """
    net, g = Network(seed), np.random.default_rng(seed)
    texts = [[plain(w) for w in units(t)] for t, _ in rows]
    labels = np.array([y for _, y in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        net.p["o"][:] = 0
        net.p["ob"][:] = 4.0 * (2 * labels.mean() - 1) if len(rows) else -4.0
        return net
    vocabulary = {"": 0}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t], np.int64) for t in texts]
    names = list(vocabulary)
    wrow = np.array([word_row(w) for w in names])
    crow = [np.array(char_rows(w)) for w in names]
    per = [windows_of(len(i), i, 0) for i in ids]
    owner = np.repeat(np.arange(len(per)), [len(w) for w, _ in per])
    index, inside = np.concatenate([w for w, _ in per]), np.concatenate([m for _, m in per])
    first = np.concatenate([[0], np.cumsum([len(w) for w, _ in per])])
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch < 4:
            chosen = first[:-1] + (g.random(len(rows)) * np.diff(first)).astype(np.int64)
        else:
            score = net.score_windows(net.project(net.embed(names)), index, inside)
            order = np.lexsort((score, owner))
            chosen = order[first[1:] - 1]
        deal = g.permutation(len(rows))
        for at in range(0, len(deal), 64):
            docs = deal[at : at + 64]
            win = chosen[docs]
            used, local = np.unique(index[win], return_inverse=True)
            local = local.reshape(len(win), WINDOW)
            lengths = np.array([len(crow[u]) for u in used])
            flat = np.concatenate([crow[u] for u in used])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            x = np.concatenate([net.p["word"][wrow[used]], np.add.reduceat(net.p["char"][flat], starts) / lengths[:, None]], axis=1).astype(np.float32)
            grads, dx = net.gradients(np.ascontiguousarray(local.T), inside[win].T[..., None].astype(np.float32), x, labels[docs])
            grads["word"], grads["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(grads["word"], wrow[used], dx[:, :DIM])
            np.add.at(grads["char"], flat, np.repeat(dx[:, DIM:] / lengths[:, None], lengths, axis=0))
            step += 1
            rate = RATE * (1 if epoch < epochs * 2 // 3 else 0.3)
            for k, v in grads.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= (rate * m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return net


def _score_windows(self: Network, projected: tuple[np.ndarray, np.ndarray], index: np.ndarray, inside: np.ndarray, size: int = 4096) -> np.ndarray:
    """Logits of windows, in slices of ``size``."""
    pf, pb = projected
    out = np.empty(len(index), np.float32)
    for at in range(0, len(index), size):
        i = np.ascontiguousarray(index[at : at + size].T)
        out[at : at + size] = self.run(pf[i], pb[i], inside[at : at + size].T[..., None].astype(np.float32))[0]
    return out


Network.score_windows = _score_windows


class Scorer:
    """Scores texts; projected inputs of words met before are remembered, up to a bound."""

    def __init__(self, net: Network, cap: int = 200_000):
        self.net, self.cap = net, cap
        self.clear()

    def clear(self) -> None:
        self.seen = {"": 0}
        self.tables = self.net.project(self.net.embed([""]))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text is toxic: that of its highest window."""
        if len(self.seen) > self.cap:
            self.clear()
        seen, before = self.seen, len(self.seen)
        split = [units(t) for t in texts]
        # raw words are numbered; words that look alike to the network share its vectors by value only
        flat = np.array([seen.setdefault(w, len(seen)) for ws in split for w in ws], np.int64)
        if len(seen) > before:
            new = list(seen)[before:]
            made = self.net.project(self.net.embed([plain(w) for w in new]))
            self.tables = tuple(np.concatenate([t, m]) for t, m in zip(self.tables, made, strict=True))
        lengths = [len(ws) for ws in split]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        per = [windows_of(n, flat, o) for n, o in zip(lengths, offsets[:-1].tolist(), strict=True)]
        counts = np.array([len(w) for w, _ in per])
        logits = self.net.score_windows(self.tables, np.concatenate([w for w, _ in per]), np.concatenate([m for _, m in per]))
        best = np.maximum.reduceat(logits, np.concatenate([[0], np.cumsum(counts)[:-1]]))
        return _sigmoid(best.astype(np.float64))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 1_000_000):
                    size += len(texts[end] or "")
                    end += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(scorer(texts[at:end]))], names=["doc_id", "score"])
                at = end

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> Network:
    """Trains on a bounded sample: of each label, the ``per_class`` rows with the smallest hash of doc_id
    whose texts have at most ``sample_chars`` characters and whose crc32(doc_id) mod 5 is not 0. An id with both
    labels is toxic; of an id with several texts the first in order counts."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("_id").cast("string")) % 5 != 0).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    long = docs.where(F.length("text") > sample_chars).select(F.col("doc_id").cast("long").alias("_id"))
    known = known.join(long, "_id", "left_anti")
    ids = [r for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class).collect()]
    spark = docs.sparkSession
    sample = spark.createDataFrame(ids, "_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text")
    rows = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).groupBy("_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()
    return train([(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: r["_id"])])


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text only.

    Null and empty texts have one window without words. Repeated rows get equal scores. Rows without a
    doc_id are scored and count as not held out. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(shared), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
