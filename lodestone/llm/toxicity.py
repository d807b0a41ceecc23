"""Toxicity of texts: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import code_points, columns, fresh, mix, runs, slices, span_hashes
from .langid import tables

#: Words of a window, and words from one window's start to the next's.
WINDOW, STRIDE = 64, 48
BUCKETS = 1 << 17
HIDDEN = 8
#: Windows that the network reads at once.
BATCH = 1024
#: Labelled rows of each class that a model is fitted on at most, and characters of such a text at most.
FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 1500, 3000, 50_000


def parts(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts: bucket and row of each word; bucket of each letter triple (word marks included), its word."""
    points, begin = code_points([(t or "").lower() for t in texts])
    inside = tables()[0][points]
    start, end = runs(inside)
    word = (span_hashes(points, start, end) & np.uint64(BUCKETS - 1)).astype(np.int64)
    marked = np.where(inside, points, 0).astype(np.uint64)
    # Letters since the mark before the word, so that no triple reaches over it.
    place = np.arange(len(points))
    place -= np.maximum.accumulate(np.where(inside, 0, place + 1)) if len(points) else 0
    place[1:] = np.where(inside[1:], place[1:], place[:-1] + 1)
    h = marked.copy()
    for k in (1, 2):
        h[k:] = h[k:] * np.uint64(0x100000001B3) + np.where(place[k:] >= k, marked[:-k], np.uint64(0))
        h[:k] *= np.uint64(0x100000001B3)
    gram = (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)
    # The triple that ends at a letter or at the mark after a word belongs to that word.
    size = end - start + 1
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first - start, size)
    return word, np.searchsorted(begin, start, "right") - 1, gram[np.minimum(at, len(gram) - 1)] if len(gram) else at, np.repeat(np.arange(len(start)), size)


def windows(row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows over the words of each row: row, first word, number of words. Rows without words have none."""
    counts = np.bincount(row, minlength=n_rows)
    many = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    which = np.repeat(np.arange(n_rows), many)
    shift = (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return which, (np.cumsum(counts) - counts)[which] + shift, np.minimum(WINDOW, counts[which] - shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Evidence:
    """In how many toxic and clean texts each word and letter triple occurs."""

    def __init__(self):
        self.word, self.gram, self.rows = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS)), np.zeros(2)

    def add(self, label: int, word: np.ndarray, gram: np.ndarray) -> None:
        self.word[label, np.unique(word)] += 1
        self.gram[label, np.unique(gram)] += 1
        self.rows[label] += 1

    def odds(self, counts: np.ndarray, bucket: np.ndarray, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of toxicity and number of texts; `without` a text of that label, which holds all these buckets."""
        clean, toxic = counts[0, bucket] - (without == 0), counts[1, bucket] - (without == 1)
        seen = clean + toxic
        value = np.log((toxic + 0.5) / (self.rows[1] + 1)) - np.log((clean + 0.5) / (self.rows[0] + 1))
        return np.clip(value, -4, 4) * seen / (seen + 4), seen

    def inputs(self, word: np.ndarray, gram: np.ndarray, of: np.ndarray, without: int | None = None) -> np.ndarray:
        """Numbers that the network reads for each word: from the word itself and from its letter triples."""
        if not len(word):
            return np.zeros((0, 5), np.float32)
        value, seen = self.odds(self.word, word, without)
        letters, _ = self.odds(self.gram, gram, without)
        first = np.searchsorted(of, np.arange(len(word)))
        mean = np.add.reduceat(letters, first) / np.bincount(of, minlength=len(word))
        return np.stack([value, np.log1p(seen) / 4, mean, np.maximum.reduceat(letters, first), np.minimum.reduceat(letters, first)], axis=1).astype(np.float32)


class Network:
    """The network: recurrences from both ends over a window, attention over its words, one logit."""

    def __init__(self, inputs: int = 5, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * s[0] ** -0.5).astype(np.float32)
        self.hidden = hidden
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", draw(inputs, 3 * hidden)), ("U", draw(hidden, 3 * hidden)), ("c", np.zeros(3 * hidden, np.float32)))}
        self.p |= {"v": draw(2 * hidden), "w": draw(2 * hidden), "b": np.full(1, -1, np.float32)}

    def recur(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction for x (words, windows, inputs); words that mask leaves out change no state."""
        k, out = self.hidden, np.zeros((*x.shape[:2], self.hidden), np.float32)
        a, u, h = x @ self.p["W" + d] + self.p["c" + d], self.p["U" + d], np.zeros((x.shape[1], self.hidden), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            g = h @ u
            s = sigmoid(a[t, :, : 2 * k] + g[:, : 2 * k])
            z, r = s[:, :k], s[:, k:]
            n = np.tanh(a[t, :, 2 * k :] + r * g[:, 2 * k :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * k :]))
            h = np.where(mask[t, :, None], new, h)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        kept = {"f": None, "b": None} if keep is None else {"f": [], "b": []}
        h = np.concatenate([self.recur(d, x, mask, kept[d]) for d in "fb"], axis=2)
        e = np.where(mask, h @ self.p["v"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep |= {"kept": kept, "h": h, "a": a, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean logistic loss, by back-propagation through attention and both recurrences."""
        s: dict = {}
        d = (sigmoid(self.logits(x, mask, s)) - y).astype(np.float32) / len(y)
        g = {"w": s["pooled"].T @ d, "b": d.sum(keepdims=True)}
        dc = d[:, None] * self.p["w"]
        da = (s["h"] * dc).sum(axis=2)
        de = s["a"] * (da - (s["a"] * da).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", de, s["h"])
        dh_all = s["a"][:, :, None] * dc + de[:, :, None] * self.p["v"]
        k = self.hidden
        for i, side in enumerate("fb"):
            u = self.p["U" + side]
            gw, gu, gc = (np.zeros_like(self.p[n + side]) for n in "WUc")
            dh = np.zeros((x.shape[1], k), np.float32)
            for t, h, z, r, n, un in reversed(s["kept"][side]):
                dh = dh + dh_all[t, :, i * k : (i + 1) * k]
                m = dh * mask[t, :, None]
                dn = m * (1 - z) * (1 - n * n)
                dz, dr = m * (h - n) * z * (1 - z), dn * un * r * (1 - r)
                ga, gg = np.concatenate([dz, dr, dn], axis=1), np.concatenate([dz, dr, dn * r], axis=1)
                gw += x[t].T @ ga
                gu += h.T @ gg
                gc += ga.sum(axis=0)
                dh = dh - m + m * z + gg @ u.T
            g |= {"W" + side: gw, "U" + side: gu, "c" + side: gc}
        return g


class Scorer:
    """A fitted model: evidence, network, and what is known when there are no words."""

    def __init__(self, evidence: Evidence, network: Network | None, shift: float, base: float):
        self.evidence, self.network, self.shift, self.base = evidence, network, shift, base

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probability of toxicity of each text: that of its most toxic window; the share of toxic rows without words."""
        out = np.full(len(texts), self.base)
        if self.network is None:
            return out
        word, row, gram, of = parts(texts)
        x = self.evidence.inputs(word, gram, of)
        which, first, size = windows(row, len(texts))
        best = np.full(len(texts), -np.inf)
        for i in range(0, len(which), BATCH):
            s = slice(i, i + BATCH)
            np.maximum.at(best, which[s], self.network.logits(*gather(x, first[s], size[s])))
        some = np.isfinite(best)
        out[some] = sigmoid(best[some] + self.shift)
        return out


def gather(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (words, windows, numbers) and mask of windows."""
    t = np.arange(int(size.max(initial=1)))[:, None]
    mask = t < size
    return x[np.where(mask, first + t, 0)], mask


def train(texts: Sequence[str], labels: Sequence[int], share: float, epochs: int = 10, seed: int = 1) -> Scorer:
    """Fit on texts and labels. A text is a bag of windows: its most toxic one bears its label, another clean one too.

    A text's own occurrences are left out of the evidence that its words have in training, and words of clean windows are
    made unknown at any rate, so that unknown words do not tell. share: the toxic share of all labelled rows, half the way
    to which the scores are moved.
    """
    labels = np.asarray(labels, int)
    # Texts are taken apart twice rather than kept apart: the parts are many times as large.
    evidence = Evidence()
    for y, t in zip(labels, texts):
        word, _, gram, _ = parts([t])
        evidence.add(y, word, gram)
    if len(set(labels.tolist())) < 2:
        return Scorer(evidence, None, 0.0, float(share))
    xs = []
    for y, t in zip(labels, texts):
        word, _, gram, of = parts([t])
        xs.append(evidence.inputs(word, gram, of, int(y)))
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    x = np.concatenate(xs)
    bag, first, size = windows(row, len(xs))
    del xs, row
    if not len(bag):
        return Scorer(evidence, None, 0.0, float(share))
    network, rng = Network(seed=seed), np.random.default_rng(seed)
    value = np.array([x[a : a + n, 0].max() for a, n in zip(first, size)])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            value = np.concatenate([network.logits(*gather(x, first[i : i + BATCH], size[i : i + BATCH])) for i in range(0, len(bag), BATCH)])
        top = np.lexsort((value, bag))
        top = top[np.concatenate((bag[top][1:] != bag[top][:-1], [True]))]
        other = rng.choice(np.flatnonzero(labels[bag] == 0), len(top) // 2)
        use = rng.permutation(np.concatenate([top, other]))
        for i in range(0, len(use), 128):
            b = use[i : i + 128]
            step += 1
            y = labels[bag[b]].astype(np.float32)
            read, mask = gather(x, first[b], size[b])
            read[rng.random(mask.shape) < np.where(y > 0, 0.05, rng.random(len(b)) ** 4)] = 0
            for k, g in network.gradients(read, mask, y).items():
                m = moments[k]
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                network.p[k] -= (0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    # The sample's odds, as the share of its bags, are moved half the way back to those of all labelled rows: in full,
    # a rare class would be missed where its words were seen in few texts.
    odds = lambda p: float(np.log(p / (1 - p)))
    return Scorer(evidence, network, 0.5 * (odds(np.clip(share, 1e-4, 1 - 1e-4)) - odds(labels.mean())), float(share))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """A model from a bounded sample of the labelled documents: of each class, rows of the least hash of their id.

    At most FIT_TOXIC and FIT_CLEAN labels are drawn; texts of more than FIT_CHARS characters are passed over. Of rows of
    one id the least text is taken, so that the same rows always give the same model. Labels
    other than 0 and 1 are none. Without rows of both classes every score is the share of toxic rows (0 if none).
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    count = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("k")).first()
    share = count.k / count.n if count.n else 0.0
    pick = lambda y, n: own.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = docs.sparkSession.createDataFrame([tuple(r) for y, n in ((1, FIT_TOXIC), (0, FIT_CLEAN)) for r in pick(y, n).collect()], own.schema)
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull() & (F.length(text) <= FIT_CHARS)).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).groupBy("_id").agg(F.min(text).alias("t"), F.max("_label").alias("_label"))
    got = sorted((r.t, r["_label"]) for r in rows.collect())  # at most one text a drawn label
    return train([t for t, _ in got], [y for _, y in got], share)


def scored(docs: DataFrame, scorer: Scorer, text_col: str = "text", out: str = "score", least: float | None = None, most: float | None = None) -> DataFrame:
    """docs with `out`, the probability of toxicity of each whole text; only rows from `least` up to below `most`.

    A column of docs named `out` is replaced. A score depends on the text alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    others = [f for f in docs.schema if f.name.lower() != out.lower()]
    schema = T.StructType([*others, T.StructField(out, T.DoubleType())])
    at = [f.name for f in others].index(text_col)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            score = np.concatenate([shared.value.score(texts[s]) for s in slices(texts)] or [np.zeros(0)])
            keep = (score >= (-np.inf if least is None else least)) & (score < (np.inf if most is None else most))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, out]).filter(pa.array(keep))

    return docs.select(*[F.col(f"`{f.name}`") for f in others]).mapInArrow(look, schema)


def keep_clean(docs: DataFrame, scorer: Scorer, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """docs without those that score `limit` or more; all columns stay."""
    return scored(docs, scorer, text_col, fresh(docs, "_toxicity"), most=limit).select(*columns(docs))
