"""Language of texts and of their spans: script ranges, then Viterbi over words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import code_points, durable, mix, runs, slices, span_hashes

#: Buckets of letter sequences; the model is this many rows of one number a language.
BUCKETS = 1 << 17
#: Labelled documents of each language that a model is fitted on at most.
FIT_ROWS = 4000
#: Characters of the texts that are taken through the best-path search together, about.
TOGETHER = 1_500_000
#: Of its own letters, what a language has more of in each script that it may be used in.
SCRIPT_SHARE = 0.001
#: Unicode ranges of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0x20000, 0x2FFFF)],
}


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its script (0: any other)."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.int8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = i
    return letter, script


class Words:
    """Words of texts (runs of letters, lower case), and the letter sequences in the different ones among them.

    `each` tells which of the different words a word is. Sequences are taken of each different word once.
    """

    def __init__(self, texts: Sequence[str | None]):
        low = [(t or "").lower() for t in texts]
        same = [len(a) == len(t or "") for a, t in zip(low, texts)]
        points, begin = code_points([a if s else "".join(c.lower()[:1] for c in t) for a, s, t in zip(low, same, texts)])
        letter, script = tables()
        self.start, self.end = runs(letter[points])
        self.begin, self.row = begin, np.searchsorted(begin, self.start, "right") - 1
        self.script = script[points[self.start]] if len(self.start) else np.zeros(0, np.int8)
        _, first, self.each = np.unique(span_hashes(points, self.start, self.end), return_index=True, return_inverse=True)
        # The different words one after the other, a mark before each and after each.
        self.first = first
        size = (self.end - self.start)[first]
        self.size = size + 1
        self.at = np.cumsum(self.size) - self.size
        self.place = np.arange(int(self.size.sum())) - np.repeat(self.at, self.size)
        source = np.minimum(self.place + np.repeat(self.start[first], self.size), max(len(points) - 1, 0))
        self.marked = np.where(self.place < np.repeat(size, self.size), points[source], 0).astype(np.uint64)

    def grams(self, n: int) -> np.ndarray:
        """Bucket of the n code points that end at each letter and at the mark behind each word; none reach before the word's
        own mark."""
        h = self.marked.copy()
        for k in range(1, n):
            h[k:] = h[k:] * np.uint64(0x100000001B3) + np.where(self.place[k:] >= k, self.marked[:-k], np.uint64(0))
            h[:k] *= np.uint64(0x100000001B3)
        return (mix(h + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Model:
    """Log-probabilities of letter sequences by language, and the languages seen in each script."""

    def __init__(self, langs: list[str], weights: np.ndarray, allowed: np.ndarray, switch: float):
        self.langs, self.weights, self.allowed, self.switch = langs, weights, allowed, switch

    def scores(self, words: Words) -> np.ndarray:
        """Score of each word in each language, from the word alone; languages not seen in its script are far below."""
        if not len(words.at):
            return np.zeros((0, len(self.langs)))
        total = self.weights[words.grams(SIZES[0])]
        for n in SIZES[1:]:
            total += self.weights[words.grams(n)]
        own = np.add.reduceat(total, words.at, axis=0).astype(np.float64)
        ok = self.allowed[words.script[words.first]]
        own = np.where(ok | ~ok.any(axis=1, keepdims=True), own, own.min(axis=1, initial=0.0)[:, None] - 50.0)
        return own[words.each]

    def paths(self, words: Words, n_rows: int) -> np.ndarray:
        """The language of each word on the best path of its text, switches being penalised.

        Texts are taken together, in order of length, one word of each at a time.
        """
        score = self.scores(words)
        counts = np.bincount(words.row, minlength=n_rows)
        first = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        first = first[order]
        best = np.zeros((n_rows, len(self.langs)))
        back = np.zeros(score.shape, np.int32)
        longest = int(counts[order[0]]) if n_rows else 0
        live = np.searchsorted(-counts[order], -np.arange(longest), "left")
        every = np.arange(len(self.langs), dtype=np.int32)
        for t in range(longest):
            m = live[t]
            v, at = best[:m], first[:m] + t
            top = v.argmax(axis=1)
            over = v[np.arange(m), top][:, None] - self.switch
            stay = v >= over
            back[at] = np.where(stay, every, top[:, None])
            best[:m] = np.where(stay, v, over) + score[at]
        out = np.zeros(len(score), np.int32)
        state = best.argmax(axis=1).astype(np.int32)
        for t in reversed(range(longest)):
            m = live[t]
            at = first[:m] + t
            out[at] = state[:m]
            state[:m] = back[at, state[:m]]
        return out


SIZES = (1, 2, 3, 4)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, switch: float = 12.0) -> Model:
    """A model from at most `rows` different labelled texts of each language, those of the least hash, each taken whole.

    Copies count once, so that no group of them fills the sample; a language is never short of texts because others have
    more. A language may be used in a script that holds over SCRIPT_SHARE of its own sampled letters, whatever other
    languages have there. The tasks count letter sequences; what reaches the driver is one number for each bucket and
    language.
    """
    own = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    own = own.withColumn("hash", F.xxhash64("text"))
    # Only the lowest ranges of hashes that reach `rows` texts are ordered, so that a frequent language is no large task.
    names = durable(own.select(F.col("hash").alias("_hash"), F.col("lang").alias("_lang"), F.shiftright("hash", 54).cast("int").alias("_range")).distinct())
    below = F.sum("count").over(Window.partitionBy("_lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    low = names.groupBy("_lang", "_range").count().withColumn("_below", F.coalesce(below, F.lit(0))).where(F.col("_below") < rows).select("_lang", "_range")
    order = Window.partitionBy("_lang").orderBy("_hash")
    least = names.join(F.broadcast(low), ["_lang", "_range"]).withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= rows).select("_hash", "_lang")
    met = own.join(F.broadcast(least), (F.col("hash") == F.col("_hash")) & (F.col("lang") == F.col("_lang")))  # `rows` rows a language
    chosen = met.groupBy("hash", "lang").agg(F.min("text").alias("text")).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                sums, letters = np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)
                texts = list(texts)
                for part in slices(texts):
                    words = Words(texts[part])
                    for n in SIZES:
                        many = np.repeat(np.bincount(words.each, minlength=len(words.at)), words.size)
                        sums += np.bincount(words.grams(n), weights=many, minlength=BUCKETS).astype(np.int64)
                    letters += np.bincount(words.script, weights=words.end - words.start, minlength=len(letters)).astype(np.int64)
                seen = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": lang, "bucket": np.concatenate([seen, -1 - np.arange(len(letters))]), "n": np.concatenate([sums[seen], letters])})

    counted = chosen.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique().tolist())
    table, letters = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPTS) + 1, len(langs)))
    for i, lang in enumerate(langs):
        own_ = counted[counted["lang"] == lang]
        b, n = own_["bucket"].to_numpy(), own_["n"].to_numpy()
        table[b[b >= 0], i] = n[b >= 0]
        letters[-1 - b[b < 0], i] = n[b < 0]
    weights = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * BUCKETS)) if langs else table
    weights = (weights - weights.mean(axis=1, keepdims=True)) / 2 if langs else weights
    share = letters / np.maximum(letters.sum(axis=0, keepdims=True), 1)
    return Model(langs, weights.astype(np.float32), share > SCRIPT_SHARE, switch)


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Columns id, lang, score, spans (from, to, lang in code points), and those of `extra`, for every row of docs.

    lang is the language whose spans hold the most letters (of equal ones the first by name), score their share of all
    letters. A null text, one without letters, or a model without languages gives `und`, score 0 and no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}
    kinds = docs.select(*[c.alias(n) for n, c in extra.items()]).schema
    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[c.alias(n) for n, c in extra.items()])
    schema = ", ".join([f"id {part.schema['id'].dataType.simpleString()}, lang string, score double, spans array<struct<from:int,to:int,lang:string>>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            langs, scores, found = [], [], []
            for piece in slices(texts, TOGETHER):
                one = texts[piece]
                words = Words(one)
                sums = np.zeros((len(one), max(1, len(model.langs))))
                own: list = [[] for _ in one]
                if len(words.start) and model.langs:
                    path = model.paths(words, len(one))
                    np.add.at(sums, (words.row, path), words.end - words.start)
                    cut = np.concatenate(([True], (path[1:] != path[:-1]) | (words.row[1:] != words.row[:-1])))
                    heads = np.flatnonzero(cut)
                    tails = np.concatenate((heads[1:], [len(path)])) - 1
                    at = words.begin[words.row[heads]]
                    for r, a, b, k in zip(words.row[heads].tolist(), (words.start[heads] - at).tolist(), (words.end[tails] - at).tolist(), path[heads].tolist()):
                        own[r].append({"from": a, "to": b, "lang": model.langs[k]})
                total = sums.sum(axis=1)
                langs += [model.langs[k] if n else "und" for k, n in zip(sums.argmax(axis=1).tolist(), total.tolist())]
                scores += (sums.max(axis=1) / np.maximum(total, 1)).tolist()
                found += own
            yield pd.DataFrame({"id": pdf["id"], "lang": langs, "score": scores, "spans": found} | {n: pdf[n] for n in extra})

    return part.mapInPandas(label, schema)
