"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(key):
    return zlib.crc32(key.encode()) % 10_000


def plain(rows, items):
    """(doc_id, n_features, weight, score, rank) of each row, by the contract."""
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(bucket(k) for k in features(x)[1])
    for x in items:
        t.update(bucket(k) for k in features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for i, x in rows:
        w, f = features(x)
        weight = sum(gain(bucket(k)) for k in f) // max(len(f), 1)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    taken = able[: 25 * len(able) // 100]
    done = [(r[0], r[2], r[3], r[4], k + 1) for k, r in enumerate(taken)]
    left = Counter((r[0], r[2], r[3], r[4]) for r in out) - Counter(r[:4] for r in done)
    return Counter([*done, *[(*r, None) for r in left.elements()]])


@pytest.mark.parametrize("block,part", [(8_000_000, 500_000), (300, 50)])
def test_query_equals_the_plain_version(spark, docs, rows, tmp_path, monkeypatch, block, part):
    monkeypatch.setattr(importance, "BLOCK", block)
    monkeypatch.setattr(importance, "PART_WORDS", part)
    items = ["the ri ta on", None, "", "One two words", "Ω éa ßu the"]
    docs.withColumn("block", docs.size).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries.op12_importance(spark, str(tmp_path))
    assert all(k == "bigint" for _, k in out.dtypes)
    want = plain([r[:2] for r in rows], items)
    assert Counter(tuple(r) for r in out.collect()) == want and any(k[4] for k in want)
    took = importance.resampled(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert took.columns == docs.columns and {r.doc_id for r in took.collect()} == {k[0] for k in want if k[4]}


def test_sums_over_a_block_equal_sums_over_each_text():
    rng = random.Random(5)
    texts = ["", "one", "a b a b a", None, *[" ".join(rng.choices("abcdé", k=rng.randint(0, 30))) for _ in range(50)], ""]
    words = sorted({w for t in texts for w in (t or "").split()})
    import numpy as np
    import pyarrow as pa

    sizes = np.array([len((t or "").split()) for t in texts])
    places = np.array([words.index(w) for t in texts for w in (t or "").split()], np.int32)
    own = importance.Features(sizes, importance.packed(importance.ended(pa.array(words))[0]), importance.packed(places), 7)
    strings = own.strings().to_pylist()
    gains = np.array([rng.randint(-50, 50) for _ in strings])
    gain = dict(zip(strings, gains.tolist()))
    assert own.sums(gains).tolist() == [sum(gain[k] for k in features(t)[1]) for t in texts]
    assert dict(zip(strings, own.times.tolist())) == Counter(k for t in texts for k in features(t)[1])


def test_empty_tables_and_ids_of_any_type(spark, empty, tmp_path):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.drawn(importance.weights(empty, none)).count() == 0
    some = spark.createDataFrame([("b", "x y x"), (None, None)], "doc_id string, text string")
    got = {r.id: tuple(r)[1:] for r in importance.weights(some, none).collect()}
    assert got[None] == (0, 0, 0) and got["b"][:2] == (3, 5) and got["b"][2] < 0
    assert [r["rank"] for r in importance.drawn(importance.weights(some, none), percent=100, least_words=0).orderBy("rank").collect()] == [1, 2]
