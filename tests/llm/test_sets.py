"""SimHash, mixing, sharding and sketches against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from lodestone.llm import mixing, queries, sharding, simhash, sketch

ASCII_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = ASCII_SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(values, radius):
    """Connected classes of distinct values, by comparing all of them."""
    label = {v: v for v in values}
    for _ in values:
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= radius:
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(4)
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 4) * 500:
        diff = sum(1 << int(i) for i in rng.choice(64, k, replace=False))
        assert any(diff & m == 0 for m in masks)
    assert len(masks) == 31 and all(20 <= m.bit_count() <= 44 for m in masks)


def test_long_runs_are_split_without_losing_links(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    values = np.unique(np.concatenate([base, base ^ np.uint64(1 << 40 | 7), base ^ np.uint64(3 << 20)]))
    joined = lambda masks: {frozenset(map(int, r)) for part in simhash.spanning_links(values, 4, masks) for r in part}
    whole = classes([int(v) for v in values], 4)
    monkeypatch.setattr(simhash, "RUN_LIMIT", 10)
    label = {int(v): int(v) for v in values}
    for _ in range(5):
        for pair in joined(simhash.covering_masks(4)):
            low = min(label[v] for v in pair)
            label |= {v: low for v in pair}
    assert all((label[a] == label[b]) == (whole[a] == whole[b]) for a in label for b in label)


def test_near_duplicates_equal_brute_force(docs, rows):
    got = [(r.id, r.fp % 2**64, r.component) for r in simhash.near_duplicates(docs).collect()]
    assert Counter((i, f) for i, f, _ in got) == Counter((r[0], plain_fingerprint(r[1])) for r in rows)
    label = classes(sorted({f for _, f, _ in got}), 4)
    least = defaultdict(lambda: 10**9)
    for i, f, _ in got:
        least[label[f]] = min(least[label[f]], 10**9 if i is None else i)
    assert all(c == (None if least[label[f]] == 10**9 else least[label[f]]) for _, f, c in got)


def test_keep_one_keeps_columns_and_one_row_of_each_component(docs, rows, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    found = {(r.id, r.component) for r in simhash.near_duplicates(docs).collect()}
    assert Counter(r.doc_id for r in got) == Counter({i: 1 for i, c in found if i == c})
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_keep_one_keeps_unrelated_rows_of_equal_and_null_ids(spark):
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(2, words[0], "x"), (2, words[1], "x"), (None, words[2], "x"), (None, words[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    assert Counter(map(tuple, simhash.keep_one(docs).collect())) == Counter(rows)
    more = [*rows, (2, words[0], "y"), (None, words[2], None), (5, words[2], "x"), (7, None, "n"), (7, None, "n"), (None, "", "n"), (9, words[0].upper(), "x")]
    got = Counter(map(tuple, simhash.keep_one(spark.createDataFrame(more, docs.schema)).collect()))
    kept = Counter(r[:2] for r in got.elements())
    assert kept == Counter([(2, words[0]), (2, words[1]), (5, words[2]), (None, words[3]), (7, None)])
    named = spark.createDataFrame([("b", words[0]), ("a", words[0]), ("c", None)], "doc_id string, text string")
    assert {(r.id, r.component) for r in simhash.near_duplicates(named).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_large_groups_under_a_mask_are_split_before_the_join(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 40)
    values = sorted({int(v) for v in [*base, *(base ^ 7), *(base ^ (1 << 50 | 1 << 20)), *(base[:20] ^ 0b111110000)]})
    monkeypatch.setattr(simhash, "RUN_LIMIT", 3)
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    want, label = classes(values, 4), {v: v for v in values}
    for _ in values:
        for a, b in got:
            label[a] = label[b] = min(label[a], label[b])
    assert all((label[a] == label[b]) == (want[a] == want[b]) for a in values for b in values)


def plain_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, left = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        over = {s for s in left if total * weight[s] / sum(weight[x] for x in left) > 2 * sizes[s]}
        if not over:
            return target | {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        target |= {s: 2.0 * sizes[s] for s in over}
        total -= sum(2 * sizes[s] for s in over)
        left -= over


def test_mix_meets_targets_and_takes_no_word_three_times(docs, rows, empty):
    got = mixing.words_taken(*mixing.mixture(docs, block=8)).collect()
    assert Counter((r.id, r["size"]) for r in got) == Counter((r[0], len(ASCII_SPACE.findall(r[1] or ""))) for r in rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size >= r["size"]
    plain = plain_targets(sizes)
    for s in sizes:
        assert abs(plain[s] - target[s]) < 1e-6 * (1 + plain[s])
        assert abs(taken[s] - target[s]) <= 0.5
    again = mixing.words_taken(*mixing.mixture(docs.repartition(5), block=8)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.words_taken(*mixing.mixture(empty)).count() == 0


def test_slots_use_a_permutation_and_spread_over_shards(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(mixing.shuffled(F.col("id"), F.lit(1000), F.lit(5)).alias("x"))
    x = [r.x for r in df.collect()]
    assert sorted(x) == list(range(1000)) and sum(abs(a - i) for i, a in enumerate(x)) > 200_000


def test_the_mix_comes_from_the_counts_drawn_for_each_shard(spark, docs):
    from pyspark.sql import functions as F

    rows, pieces = mixing.mixture(docs, block=8, shards=4)
    plan = spark.createDataFrame([("a", 0, 1000), ("a", 1, 7), (None, 0, 9000)], "source string, epoch long, slots long")
    drawn = mixing.draws(plan, 4, 42).collect()
    assert {(s, e): sum(r["count"] for r in drawn if (r.source, r.epoch) == (s, e)) for s, e in (("a", 0), ("a", 1), (None, 0))} == {("a", 0): 1000, ("a", 1): 7, (None, 0): 9000}
    big = [r["count"] for r in drawn if r.source is None]
    assert 0 < max(big) - min(big) < 400  # drawn, not dealt evenly
    # Slots of a shard are numbered without gaps over all sources, and a slot takes words of one block of one source.
    slots = pieces.groupBy("shard", "slot").agg(F.count_distinct("source", "epoch").alias("k"), F.sum(F.col("word_to") - F.col("word_from")).alias("w"), F.min((F.col("start") + F.col("word_from")) / 8).alias("a"), F.max((F.col("start") + F.col("word_to") - 1) / 8).alias("b")).collect()
    for shard in range(4):
        assert sorted(r.slot for r in slots if r.shard == shard) == list(range(sum(r.shard == shard for r in slots)))
    assert all(r.k <= 1 and r.w <= 8 and int(r.a) == int(r.b) for r in slots)
    # All shards but the last have as many slots.
    held = [sum(r.shard == s for r in slots) for s in range(4)]
    assert len(set(held[:3])) == 1 and held[0] - 4 < held[3] <= held[0]
    assert sum(r.w for r in slots) == sum(r.taken for r in mixing.words_taken(rows, pieces).collect())


def test_another_draw_changes_what_the_query_returns_but_not_the_totals(docs):
    told = lambda **k: {(r.id, r.source, r.start): (r.shard, r.slot, r.taken) for r in mixing.words_taken(*mixing.mixture(docs, block=8, **k)).collect()}
    one, same, other, single = told(shards=4), told(shards=4), told(shards=4, seed=7), told(shards=1)
    assert one == same and one != other and one != single
    sums = lambda t: Counter({s: sum(v[2] for k, v in t.items() if k[1] == s) for s in {k[1] for k in t}})
    assert sums(one) == sums(other) == sums(single)
    assert all((v[0] is None) == (v[2] == 0) for v in one.values()) and {0} < {v[0] for v in one.values()} - {None} <= {0, 1, 2, 3}


def test_equal_rows_of_two_sources_are_taken_apart(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "A"), (1, text, "B"), (2, text, "A"), (2, text, "A"), (3, text + " end", "B"), (None, text, None), (None, text, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as _copies")
    taken = Counter()
    for r in mixing.words_taken(*mixing.mixture(docs)).collect():
        taken[r.id, r.source] += r.taken
    held = Counter()
    for r in mixing.mixed_documents(docs).collect():
        held[r.doc_id, r.source] += len(r.text.split())
    assert held == taken


def test_mixed_documents_hold_the_words_taken(docs, empty):
    taken = Counter()
    for r in mixing.words_taken(*mixing.mixture(docs, block=8)).collect():
        taken[r.id] += r.taken
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    held, source = Counter(), defaultdict(list)
    for r in docs.collect():
        source[r.doc_id].append(ASCII_SPACE.findall(r.text or ""))
    for r in out.collect():
        words = ASCII_SPACE.findall(r.text)
        held[r.doc_id] += len(words)
        assert any(not Counter(words) - Counter(w) for w in source[r.doc_id]) and r["size"] in ("clash", None)
    assert +held == +taken
    assert mixing.mixed_documents(empty).count() == 0


def test_shards_are_even_gapless_and_keep_groups(docs, rows, empty, spark):
    got = sharding.shard_documents(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.id, r["size"], r.text_crc32) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 8
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    groups = defaultdict(set)
    for r in got:
        groups[(r.text_crc32, r["size"])].add(r.shard)
    assert sum(len(g) - 1 for g in groups.values()) <= 2
    assert sharding.shard_documents(empty).count() == 0
    hot = spark.createDataFrame([(i, "same" if i % 2 else f"t{i // 6}", "x") for i in range(403)], "doc_id long, text string, size string")
    counts = Counter(r.shard for r in sharding.shard_documents(hot).collect())
    assert sorted(counts.values()) == [50] * 5 + [51] * 3


def test_groups_end_whole_beside_one_too_large_for_a_shard(spark):
    texts = ["same"] * 1200 + [f"t{i // 2}" for i in range(2400)]
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [450] * 8
    groups = defaultdict(set)
    for r in got:
        groups[texts[r.id]].add(r.shard)
    assert len(groups.pop("same")) <= 4 and sum(len(g) > 1 for g in groups.values()) < 8
    # All rows are linked, and one group takes most of a shard.
    texts = ["most"] * 400 + [f"t{i // 2}" for i in range(3200)]
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [450] * 8
    groups = defaultdict(set)
    for r in got:
        groups[texts[r.id]].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())


def test_linked_pairs_meet_when_every_row_is_linked(spark):
    rows = [(i, f"t{i % 80}") for i in range(160)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.collect()
    groups = defaultdict(set)
    for r in got:
        groups[rows[r.id][1]].add(r.shard)
    assert all(len(g) == 1 for g in groups.values()) and sorted(Counter(r.shard for r in got).values()) == [20] * 8
    assert dict(out.dtypes)["slot"] == "bigint"


def plain_sketch(hash_of, text, scale=8):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    keys = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    all_ = {hash_of[k] for k in keys}
    return {h for h in all_ if h < -(2**63) + 2**64 // scale} or ({min(all_)} if all_ else set())


def test_sketches_equal_brute_force(docs, rows, spark, empty):
    from pyspark.sql import functions as F

    got = sketch.edited_fingerprints(docs).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want, texts = [], set()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        want.append((i, t, t[: len(t) - k] + n[:k], n))
        texts |= {t, want[-1][2]}
    assert Counter((r.id, r.n_chars, r.edited) for r in got) == Counter((i, len(t), e) for i, t, e, _ in want)
    # Each distinct shingle's hash comes from Spark's own function.
    words = {tuple(w[i : i + 5]) for t in texts for w in [[x for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x]] for i in range(max(1, len(w) - 4)) if w}
    shingles = spark.createDataFrame([(list(w),) for w in words], "w array<string>")
    hashes = {tuple(r.w): r.h for r in shingles.select("w", F.xxhash64(*[F.xxhash64(F.get("w", j)) if False else F.when(F.lit(j) < F.size("w"), F.xxhash64(F.get("w", F.lit(j)))) for j in range(5)]).alias("h")).collect()}
    text = lambda s: "".join(f"{h % 2**64:016x}" for h in sorted(s))
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    full = Counter()
    for i, t, e, n in want:
        a, b, c = (plain_sketch(hashes, x) for x in (t, e, n))
        full[i, text(a), text(b), round(like(a, b), 9), round(like(a, c), 9)] += 1
    assert Counter((r.id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == full
    assert sketch.edited_fingerprints(empty).count() == 0


def test_sketches_merge_and_estimate_containment(spark):
    from pyspark.sql import functions as F

    small, large = " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(small, large, "w1 w2 w3 w4 w5")], "a string, b string, c string")
    s = df.select(*[sketch.sketch(F.col(x)).alias(x) for x in "abc"], sketch.sketch(F.col("b")).alias("all"))
    r = s.select(sketch.containment(F.col("a"), F.col("b")).alias("in"), sketch.likeness(F.col("a"), F.col("b")).alias("like"), (sketch.merge(F.col("a"), F.col("b")) == F.col("all")).alias("same")).first()
    assert r["in"] == 1.0 and abs(r["like"] - 0.03) < 0.01 and r["same"]


def true_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_short_texts_are_compared_by_their_true_shingles(spark, tmp_path):
    from pyspark.sql import functions as F

    texts = [" ".join(f"{'abcdefg'[(i * k) % 7]}{i}" for i in range(n)) for n in range(6, 31) for k in (1, 2)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.near_edited, r.near_next) for r in queries.op10_sketch(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        follow, k = texts[i - 1], len(t) // 3
        own = true_shingles(t)
        for value, other in zip(got[i], (t[: len(t) - k] + follow[:k], follow)):
            assert abs(value - len(own & true_shingles(other)) / len(own | true_shingles(other))) < 1e-9
    long = " ".join(f"x{i}" for i in range(400))
    rows = [(t, s) for t in texts for s in (f"{long} {t} {long}", f"{long} {t[: len(t) // 2]}")]
    for scale in (1, 8):
        a, b = (sketch.sketch(F.col(c), scale) for c in "ab")
        for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", sketch.containment(a, b, scale).alias("in")).collect():
            want = len(true_shingles(r.a) & true_shingles(r.b)) / len(true_shingles(r.a))
            assert abs(r["in"] - want) < 1e-9 if scale == 1 else want < 1 or r["in"] in (None, 1.0)


def test_propagation_makes_most_groups_whole_and_nothing_does_without_it(spark):
    rows = [(i, f"t{i % 1000}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with_, without = {}, {}
    for told, rounds in ((with_, None), (without, 0)):
        got = sharding.shard_documents(docs, rounds=rounds, told=told).collect()
        assert sorted(Counter(r.shard for r in got).values()) == [375] * 8
        groups = defaultdict(set)
        for r in got:
            groups[r.id % 1000].add(r.shard)
        assert sum(len(g) > 1 for g in groups.values()) < 8
    assert with_["propagated"] >= 0.8 * 3000 and without["propagated"] <= 0.2 * 3000 and without["laid"] >= 0.8 * 3000


def test_links_between_different_texts_bring_documents_together(spark):
    import random

    # Sixty circles of ten documents, each document linked with the next two of its circle.
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(600)], "doc_id long, text string")
    pairs = [(10 * c + k, 10 * c + (k + d) % 10) for c in range(60) for k in range(10) for d in (1, 2)]
    random.Random(1).shuffle(pairs)
    links = spark.createDataFrame([*pairs, (5, None), (5, 9999), (7, 7)], "a long, b long")
    cut = {}
    for rounds in (0, None):
        shard = {r.id: r.shard for r in sharding.shard_documents(docs, links=links, rounds=rounds).collect()}
        assert sorted(Counter(shard.values()).values()) == [75] * 8
        cut[rounds] = sum(shard[a] != shard[b] for a, b in pairs)
    assert cut[0] > 0.8 * len(pairs) and cut[None] < 0.5 * cut[0]


def test_full_shards_exchange_rows():
    asked = [(0, 1, 3, 0, 5), (1, 0, 3, 0, 5), (0, 1, 1, 1, 5), (2, 0, 2, 0, 50)]
    load, room = [10, 10, 60], [10, 10, 60]
    assert sharding.granted(asked, load, [15, 10, 60]) == [(1, 0, 3, 0), (0, 1, 3, 0)] and load == [10, 10, 60]
    assert sharding.granted(asked[:2], [10, 10], [10, 10]) == [] and room == [10, 10, 60]
