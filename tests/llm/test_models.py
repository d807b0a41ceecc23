"""Language, toxicity, token counts and repeated lines against plain versions and held-out rows."""

import random
from collections import Counter as Tally

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import langid, linededup, queries, tokens, toxicity


def sentences(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


A, B, C = ["the", "ing", "wh", "er"], ["sch", "ung", "ei", "zu"], ["пр", "ов", "ст", "ам"]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(sentences(rng, s, 40), lang) for s, lang in ((A, "en"), (B, "de"), (C, "ru")) for _ in range(40)] + [("x", None), (None, "en")]
    return langid.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_language_spans_of_mixed_texts(spark, model):
    rng = random.Random(2)
    a, b, c = sentences(rng, A, 30), sentences(rng, B, 50), sentences(rng, C, 20)
    rows = [(1, f"{a}. {b}! {c}"), (2, a), (3, c), (4, None), (5, ""), (6, "12 34 !"), (7, a + " zu " + a), (8, "ελλ ην"), (9, f"{b} " * 400), (2, a), (None, "İİ " + a)]
    got = {r.id: r for r in langid.spans(spark.createDataFrame(rows, "id long, text string").withColumnRenamed("id", "doc_id"), model).collect()}
    assert [(s["lang"]) for s in got[1].spans] == ["en", "de", "ru"]
    text = rows[0][1]
    assert [text[s["from"] : s["to"]] for s in got[1].spans] == [a, b, c]
    assert got[1].lang == "de" and 0.3 < got[1].score < 0.8
    assert [got[i].lang for i in (2, 3, 4, 5, 6, 9, None)] == ["en", "ru", "und", "und", "und", "de", "en"]
    assert got[4].score == 0 and got[3].score == 1 and len(got[7].spans) == 3
    assert got[8].lang in ("en", "de", "ru")
    steady = langid.Model(model.langs, model.weights, model.allowed, 1000.0)
    one = langid.spans(spark.createDataFrame(rows[6:7], "doc_id long, text string"), steady).first()
    assert len(one.spans) == 1 and one.lang == "en"


def test_a_small_language_beside_a_large_one_is_predicted(spark):
    rng = random.Random(9)
    few = [(sentences(rng, B, 60), "de") for _ in range(8)]
    much = [(sentences(rng, A, 100_000), "en") for _ in range(10)] + [(sentences(rng, A, 3), "en") for _ in range(150)]
    model = langid.fit(spark.createDataFrame(few + much, "text string, lang string"), rows=20)
    docs = spark.createDataFrame([(i, sentences(rng, s, 20)) for i, s in enumerate((A, B) * 5)], "doc_id long, text string")
    assert [r.lang for r in langid.spans(docs, model).orderBy("id").collect()] == ["en", "de"] * 5
    # Of each language as many texts as there are, up to the bound.
    sampled = langid.fit(spark.createDataFrame([(sentences(rng, A, 3), "en") for _ in range(400)] + few[:1], "text string, lang string"), rows=5)
    assert sampled.langs == ["de", "en"]


def test_viterbi_equals_brute_force(model):
    rng = random.Random(3)
    texts = [" ".join(rng.choice([*A, *B, "theung", "eier", "ст"]) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    words = langid.Words(texts)
    path, score = model.paths(words, len(texts)), model.scores(words)
    for i in range(len(texts)):
        at = np.flatnonzero(words.row == i)
        if not len(at):
            continue
        best = {k: (score[at[0], k], [k]) for k in range(len(model.langs))}
        for w in at[1:]:
            best = {k: max(((v - model.switch * (j != k) + score[w, k]), p + [k]) for j, (v, p) in best.items()) for k in best}
        top = max(v for v, _ in best.values())
        mine = score[at, path[at]].sum() - model.switch * (np.diff(path[at]) != 0).sum()
        assert abs(top - mine) < 1e-4


def test_scores_are_of_words_alone_and_many_languages_fit(model):
    words = langid.Words(["hello", "a hello", "über hello there", "x-hello, hello"])
    score = model.scores(words)
    own = [score[i] for i in range(len(words.row)) if words.end[i] - words.start[i] == 5 and i != len(words.row) and (words.row[i] != 2 or words.start[i] < words.begin[2] + 8)]
    assert len(own) == 5 and all((s == own[0]).all() for s in own)
    langs = [f"l{i:03}" for i in range(200)]
    rng = np.random.default_rng(1)
    wide = langid.Model(langs, rng.standard_normal((langid.BUCKETS, 200)).astype(np.float32), np.ones((len(langid.SCRIPTS) + 1, 200), bool), 0.0)
    words = langid.Words([" ".join("abcdefgh"[i % 8] * (i % 5 + 1) + "xyz"[i % 3] for i in range(120))])
    assert wide.paths(words, 1).tolist() == wide.scores(words).argmax(axis=1).tolist() and wide.scores(words).argmax(axis=1).max() > 127


def test_no_labels_give_und(spark, empty):
    model = langid.fit(empty)
    got = langid.spans(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), model).first()
    assert (got.lang, got.score, got.spans) == ("und", 0.0, [])
    assert langid.spans(empty, model).count() == 0


def toxic_corpus(n=300):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        words = sentences(rng, A, rng.choice([20, 90, 300])).split()
        bad = i % 4 == 0
        for _ in range(rng.randint(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["moronic", "Idiot!", "trashy"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark, docs, empty):
    rows = toxic_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.fit(df, df.where("doc_id % 3 != 0").select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.scored(df.select("doc_id", "text"), scorer).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    kept = toxicity.keep_clean(docs, scorer)
    clean = toxicity.scored(docs.select("doc_id", "text"), scorer).where("score < 0.5")
    assert kept.columns == docs.columns and kept.count() == clean.count() > 20
    assert toxicity.keep_clean(empty, scorer).count() == 0
    none = toxicity.scored(docs.select("doc_id", "text"), scorer).where("text is null or trim(text) = ''").collect()
    assert len(none) >= 4 and all(0 <= r.score < 0.5 for r in none)
    flat = toxicity.fit(df, df.where("toxic = 0"))
    assert {r.score for r in toxicity.scored(df, flat).collect()} == {0.0}


def test_scores_do_not_depend_on_the_batch(spark):
    rows = toxic_corpus(120)
    df = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    scorer = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], 0.25, epochs=2)
    together = scorer.score([t for _, t, _ in rows])
    assert np.allclose(together, [scorer.score([t])[0] for _, t, _ in rows], atol=1e-5)
    got = {r.doc_id: r.score for r in toxicity.scored(df, scorer).collect()}
    assert np.allclose([got[i] for i, _, _ in rows], together, atol=1e-5)
    assert toxicity.keep_clean(df.withColumnRenamed("score", "_toxicity"), scorer).columns == ["doc_id", "text", "_toxicity"]


def test_all_windows_overlap_and_cover():
    row = np.repeat([0, 2, 3], [5, 64, 200])
    which, first, size = toxicity.windows(row, 5)
    assert which.tolist() == [0, 2, 3, 3, 3, 3] and first.tolist() == [0, 5, 69, 117, 165, 213] and size.tolist() == [5, 64, 64, 64, 64, 56]


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = toxicity.Network(inputs=3, hidden=2)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, y = rng.standard_normal((4, 3, 3)), np.array([0.0, 1, 1])
    mask = np.arange(4)[:, None] < np.array([4, 2, 1])

    def loss():
        z = net.logits(x, mask).astype(float)
        return np.mean(np.log1p(np.exp(-z)) + (1 - y) * z)

    g = net.gradients(x, mask, y)
    for k, v in net.p.items():
        for i in np.ndindex(v.shape):
            old = v[i]
            v[i] = old + 1e-2
            up = loss()
            v[i] = old - 1e-2
            down = loss()
            v[i] = old
            assert abs((up - down) / 2e-2 - g[k][i]) < 2e-3, k


def test_counts_after_edits_equal_counting_anew(spark, docs, empty):
    rng = random.Random(6)
    counter = tokens.Counter(tokens.ranks_of(tokens.VOCABULARY))
    whole = lambda t: len(counter.encoding.encode_ordinary(t))
    bits = ["word", " ", "  ", "\n", "\n\n ", "'s", "'", "re", "123", "é", "😀", "!?", "\t", " a", "'ll"]
    for size in (0, 1, 5, 60, 3000):
        tree = tokens.CountTree("".join(rng.choices(bits, k=size)), counter)
        assert tree.total == whole(tree.text)
        for _ in range(60):
            a = rng.randint(-2, len(tree.text) + 2)
            new = "".join(rng.choices(bits, k=rng.choice([0, 1, 3, 400])))
            want = tree.text[: max(0, min(a, len(tree.text)))]
            b = a + rng.choice([0, 1, 4, 40])
            want += new + tree.text[max(len(want), min(b, len(tree.text))) :]
            tree.edit(a, b, new)
            assert tree.text == want and tree.total == whole(want) and sum(n for c, _ in tree.blocks for n in c) == len(want)
    tree = tokens.CountTree("plain words " * 5000, counter)
    tree.edit(30_000, 30_003, "X")
    assert tree.recounted < 12
    got = tokens.token_counts(docs).collect()
    assert Tally((r.id, r.n_tokens, r.edited_tokens, r.recounted) for r in got) == Tally((r.doc_id, whole(r.text or ""), whole(r.text or ""), 0) for r in docs.collect())
    assert tokens.token_counts(empty).count() == 0


def test_stored_trees_take_edits_without_counting_anew(spark, docs, tmp_path):
    counter = tokens.Counter(tokens.ranks_of(tokens.VOCABULARY))
    whole = lambda t: sum(map(counter.of, counter.split.findall(t)))
    from pyspark.sql import functions as F

    tokens.trees(docs).write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    assert Tally((r.id, r.n_tokens) for r in kept.collect()) == Tally((r.doc_id, whole(r.text or "")) for r in docs.collect())
    edits = F.expr("array(struct(2, 4, 'new word'), struct(length(text), length(text), ' tail'))")
    once = tokens.edited(kept, edits)
    twice = tokens.edited(once, F.expr("array(struct(0, 1, ''))")).collect()
    expected = Tally((r.doc_id, (lambda t: ((t[:2] + "new word" + t[4:])[: len(t)] + " tail" + (t[:2] + "new word" + t[4:])[len(t) :])[1:])(r.text or "")) for r in docs.collect())
    assert Tally((r.id, r.text) for r in twice) == expected
    assert all(r.n_tokens == whole(r.text) for r in twice)
    assert max(r.recounted for r in once.collect() if len(r.text) > 5000) < 20
    # A tree that was changed by hand shows in the counts: what edits do not touch comes from it.
    false = kept.where("length(text) > 5000").withColumn("text", F.expr("overlay(text placing '7!7!7!7!' from 3000)"))
    assert all(r.n_tokens != whole(r.text) for r in tokens.edited(false, edits).collect())


def test_very_long_runs_are_counted(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "x" * 300_000), (3, "\n" * 200_000 + "a"), (None, None)], "doc_id long, text string")
    got = {r.id: r for r in tokens.token_counts(df).collect()}
    assert got[1].n_tokens > 0 and got[None].n_tokens == 0 and got[2].n_tokens > 1000 and got[3].edited_chars == 200_001
    with pytest.raises(FileNotFoundError, match="LODESTONE_VOCABULARY"):
        tokens.token_counts(df, vocabulary="/nowhere")


def plain_lines(rows, near=0.8):
    places, out = {}, {}
    for i, t in rows:
        out.setdefault(i, [0, [], 0])
        for no, line in enumerate((t or "").split("\n")):
            w = line.lower().split()
            s = frozenset(zip(w, w[1:])) or frozenset(w)
            if s:
                out[i][0] += 1
                places.setdefault(s, []).append((i, no))
    sets = list(places)
    for s in sets:
        linked = [t for t in sets if t != s and len(s & t) >= near * len(s | t) - 1e-9]
        first = min(min(places[t]) for t in [s, *linked])
        for i, no in places[s]:
            out[i][2] += len(linked)
            if (i, no) > first:
                out[i][1].append(no)
    return {i: (n, sorted(r), k) for i, (n, r, k) in out.items()}


def test_repeated_lines_equal_brute_force(spark, docs, empty, monkeypatch):
    rng = random.Random(7)
    pool = [sentences(rng, A + B, n) for n in (1, 2, 3, 5, 6, 9, 14, 30) for _ in range(6)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(["new", "Other", "the"])
            own.append(rng.choice([" ", "  "]).join(w))
        rows.append((i, rng.choice(["\n", "\n\n"]).join(own)))
    base = sentences(rng, A + B, 24).split()
    rows += [(200 + i, " ".join([*base[: i % 20], f"other{i}", *base[i % 20 + 1 :]])) for i in range(40)]  # all different, all similar
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "same line here\n" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for buckets, block, held in ((1 << 20, 4096, 500_000), (1 << 14, 3, 4)):
        monkeypatch.setattr(linededup, "BUCKETS", buckets)
        monkeypatch.setattr(linededup, "BLOCK", block)
        monkeypatch.setattr(linededup, "HELD", held)
        got = {r.id: (r.n_lines, list(r.removed), r.n_links) for r in linededup.repeated_lines(df, words=False).collect()}
        assert got == plain_lines(rows)
        by_words = {r.id: (r.n_lines, list(r.removed), r.n_links) for r in linededup.repeated_lines(df).collect()}
        assert by_words == plain_word_lines(rows)
    assert any(v[2] for v in got.values())
    cut = {r.doc_id: r.text for r in linededup.without_repeated_lines(df).collect()}
    assert cut[103] == "same line here\n" and cut[100] is None
    assert linededup.repeated_lines(empty).count() == 0
    kept = linededup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def plain_word_lines(rows, near=0.8):
    sets, out = {}, {}
    for i, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            if line.split():
                sets.setdefault(frozenset(line.lower().split()), []).append((i, no))
    for i, _ in rows:
        out[i] = [0, [], 0]
    for s, places in sets.items():
        linked = [t for t in sets if t != s and len(s & t) >= near * len(s | t) - 1e-9]
        first = min(min(sets[t]) for t in [s, *linked])
        for i, no in places:
            out[i][0] += 1
            out[i][1] += [no] * ((i, no) > first)
            out[i][2] += len(linked)
    return {i: (n, sorted(r), k) for i, (n, r, k) in out.items()}


def test_lines_are_compared_by_words_in_the_query(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for n in range(4, 19):
        w = [f"w{n}x{i}" for i in range(n)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w[: n // 2], "other", *w[n // 2 + 1 :]]))]
    w = [f"long{i}" for i in range(50)]
    rows += [(100, " ".join(w)), (101, " ".join("other" if i in (10, 25, 40) else x for i, x in enumerate(w)))]
    pool = [f"v{i}" for i in range(14)]
    rows += [(200 + i, "\n".join(" ".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, list(r.removed), r.n_links) for r in queries.op4_lines(spark, str(tmp_path)).collect()}
    assert got == plain_word_lines(rows)
    assert all(got[2 * (n - 4) + 1][1] == [0] for n in range(9, 19)) and got[101][1] == [0]


def test_a_block_counts_alike_in_small_parts(monkeypatch):
    rng = np.random.default_rng(4)
    order = np.sort(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.sort(rng.choice(order[:60], n, replace=False)) for n in rng.integers(4, 40, 80)]
    sets += [np.sort(np.concatenate([np.delete(sets[0], i % len(sets[0])), order[100 + i : 101 + i]])) for i in range(30)]
    sizes = np.array([len(s) for s in sets])
    sketch = linededup.sketches(np.concatenate(sets), np.cumsum(sizes) - sizes, sizes).view(np.int64)
    rows = sorted((int(t), k, at) for k, s in enumerate(sets) for at, t in enumerate(s[: linededup.prefix_length(np.int64(len(s)))]))
    token, k, at = (np.array(x, np.int64) for x in zip(*rows))
    met = {"token": token, "k1": k, "size": sizes[k] << 32 | at, **{f"s{i}": sketch[k, i] for i in range(4)}}
    table = pa.table({"token": token, "p": 0 * k, "q": 0 * k, "block": 0 * k, "k1": k, "k2": k, "n": sizes[k], "at": at, "tokens": [sets[i].tobytes() for i in k], "known": 0 * k + 1, "id": k, "no": 0 * k})
    want = {}
    for a, x in enumerate(sets):
        near = [b for b, y in enumerate(sets) if a != b and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) - 1e-9]
        if near:
            want[a] = (len(near), min(near))
    for pairs, tokens_, look in ((200_000, 1_000_000, 64), (3, 5, 1)):
        monkeypatch.setattr(linededup, "PAIRS", pairs)
        monkeypatch.setattr(linededup, "TOKENS", tokens_)
        monkeypatch.setattr(linededup, "LOOK", look)
        keep = linededup.partnered(met)
        some = {c: v[keep] for c, v in met.items()}
        there = set(zip(some["k1"].tolist(), (some["size"] & 0xFFFFFFFF).tolist()))
        some["follows"] = np.array([(i, t - 1) in there for i, t in zip(some["k1"].tolist(), (some["size"] & 0xFFFFFFFF).tolist())], np.int64)
        some["prior"] = np.array([sets[i][t - 1].view(np.int64) for i, t in zip(some["k1"], some["size"] & 0xFFFFFFFF)])
        live = table.filter(pa.array(keep)).filter(pa.array(linededup.partnered(some, prior="prior")))
        assert len(live) < keep.sum() or look == 1
        got = linededup.counted(live).to_pandas().groupby("k1").agg({"links": "sum", "id": "min"})
        assert {k: (r.links, r.id) for k, r in got.iterrows()} == want
    assert not len(linededup.counted(table[:0]))


def test_sketches_of_any_size_never_hide_a_near_set():
    rng = np.random.default_rng(5)
    for n in (10, 90, 95, 96, 110, 190, 210, 400):
        base = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        other = np.concatenate([base[n // 12 :], rng.integers(0, 2**63, n // 12 + n // 40).astype(np.uint64)])
        far = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        sizes = np.array([n, len(other), n])
        sketch = linededup.sketches(np.concatenate([base, other, far]), np.cumsum(sizes) - sizes, sizes)
        differ = len(np.setxor1d(base, other))
        i, j = np.array([0, 0]), np.array([1, 2])
        assert linededup.near_sketches(sketch, sizes, i, j, np.array([differ, n // 5])).tolist() == [True, False]


def test_ids_of_any_type_and_repeated_ids(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [("b", f"{line}\n{line} eleven"), ("a", line.upper()), (None, "other words\nOTHER words"), ("a", "other words"), (None, None)]
    got = linededup.repeated_lines(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {r.id: (r.n_lines, list(r.removed), r.n_links) for r in got.collect()} == {"b": (2, [0, 1], 2), "a": (2, [0], 1), None: (2, [1], 0)}
    cut = {(r.doc_id, r.text) for r in linededup.without_repeated_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert ("b", "") in cut and (None, "other words") in cut


@pytest.mark.parametrize("words", [True, False])
def test_lines_end_at_line_feeds_only(spark, words):
    line = "alpha beta gamma delta"
    texts = [f"x\0y\n{line}\n{line}\nlast one here now", f"\0{line}\nfirst\0one", f"end one here\n{line} \0", f"a\rb\u2028{line}\rc\n{line}", "\0", "\0\n\0", "tail one\0"]
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _removed string, `a.b` string")
    got = {r.id: (r.n_lines, list(r.removed), r.n_links) for r in linededup.repeated_lines(df, words=words).collect()}
    plain = [(i, t.replace("\0", " ").replace("\u2028", " ")) for i, t in enumerate(texts)]
    want = plain_word_lines(plain) if words else plain_lines(plain)
    assert got == want
    kept = linededup.without_repeated_lines(df, words=words)
    assert kept.columns == df.columns
    cut = {r.doc_id: r.text for r in kept.collect()}
    assert cut == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i][1]) for i, t in enumerate(texts)}
    assert cut[0] == f"x\0y\n{line}\nlast one here now"


def plain_recurrence(p, d, x):
    """States of one direction by the equations of a gated recurrent unit, word by word, in double precision."""
    u, k = p["U" + d].astype(float), p["U" + d].shape[0]
    h, out = np.zeros(k), {}
    for t in range(len(x)) if d == "f" else reversed(range(len(x))):
        a, g = x[t] @ p["W" + d].astype(float) + p["c" + d], h @ u
        z, r = (1 / (1 + np.exp(-(a[i * k : (i + 1) * k] + g[i * k : (i + 1) * k]))) for i in (0, 1))
        h = z * h + (1 - z) * np.tanh(a[2 * k :] + r * g[2 * k :])
        out[t] = h
    return np.array([out[t] for t in range(len(x))])


def plain_score(scorer, text):
    """Score of the most toxic of all windows, each read by itself."""
    word, _, gram, of = toxicity.parts([text])
    x = scorer.evidence.inputs(word, gram, of).astype(float)
    if not len(x):
        return scorer.base
    p, best, start = scorer.network.p, -np.inf, 0
    while True:
        own = x[start : start + toxicity.WINDOW]
        h = np.concatenate([plain_recurrence(p, d, own) for d in "fb"], axis=1)
        e = np.exp(h @ p["v"].astype(float) - (h @ p["v"].astype(float)).max())
        best = max(best, float((e / e.sum()) @ h @ p["w"].astype(float) + p["b"][0]))
        if start + toxicity.WINDOW >= len(x):
            break
        start += toxicity.STRIDE
    return 1 / (1 + np.exp(-(best + scorer.shift)))


def test_window_scores_equal_each_window_read_by_itself():
    rng = random.Random(12)
    texts = [sentences(rng, A, rng.choice([5, 40, 64, 65, 112, 113, 300])) for _ in range(60)]
    labels = [i % 3 == 0 for i in range(60)]
    texts = [f"{t} idiot moron {t[:20]}" if y else t for t, y in zip(texts, labels)]
    scorer = toxicity.train(texts, [int(y) for y in labels], 0.2, epochs=2)
    some = [*texts, None, "", "12 !", "idiot", sentences(rng, A, 1000) + " moron idiot " + sentences(rng, A, 90), texts[0], texts[0]]
    assert np.allclose(scorer.score(some), [plain_score(scorer, t or "") for t in some], atol=1e-4)
