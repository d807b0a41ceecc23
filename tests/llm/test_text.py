"""Decontamination and chat formatting against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import chat, decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_hits(text, items):
    words = list(WORD.finditer(lower(text)))
    w, hit, found = [m[0] for m in words], set(), set()
    for i, t in items:
        own = WORD.findall(lower(t))
        for k in range(max(1, len(own) - 12) if own else 0):
            part = own[k : k + 13]
            for a in range(len(w) - len(part) + 1):
                if w[a : a + len(part)] == part:
                    hit |= set(range(a, a + len(part)))
                    found.add(i)
    return len(w), hit, sorted(str(i) for i in found if i is not None), words


def test_index_finds_all_occurrences():
    rng = random.Random(1)
    for size in (1, 2, 5, 90):
        runs = [[rng.randint(1, size) for _ in range(rng.randint(1, 40))] for _ in range(20)]
        runs += [runs[0], runs[0]]
        text = np.array([x for r in runs for x in [*r, 0]])
        index = decontam.FMIndex(text, size)
        for _ in range(60):
            r = rng.choice(runs)
            a = rng.randrange(len(r))
            p = r[a : a + rng.randint(1, 9)]
            low, high = index.search(np.array([[0] * (9 - len(p)) + p]), np.array([len(p)]))
            got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert got == [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]


def test_a_stored_index_finds_and_places_all_occurrences():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["aa", "b", "ccc", "é"], k=n)) for n in (0, 1, 12, 13, 115, 116, 128, 129, 500, 1000)] + ["aa b " * 400, None]
    hashes, row, start, end = decontam.words_of(texts)
    shard = decontam.Shard.of(decontam.Shard(hashes, row, start, end, np.arange(len(texts)) + 70).stored())
    items = [("x", "aa b " * 20), ("y", " ".join(texts[8].split()[100:130])), ("z", "ccc"), ("z", "é é"), (None, "b")]
    got = shard.find(decontam.Phrases(*map(list, zip(*items))))
    for i, t in enumerate(texts):
        n, hit, ids, words = plain_hits(t, items)
        spans, found = got.get(i + 70, ([], []))
        assert {w for a, b, _, _ in spans for w in range(a, b)} == hit and found == ids
        assert all((words[a].start(), words[b - 1].end()) == (c, d) for a, b, c, d in spans)


def test_one_index_serves_many_benchmarks(spark, docs, rows):
    whole, bench, all_rows, items = cases(spark, docs, rows)
    index = decontam.indexed(whole)
    for some in ("item_id < 9", "item_id >= 9 or item_id is null", "item_id > 999"):
        part = [(r.item_id, r.text) for r in bench.where(some).collect()]
        got = Counter((r.id, r.n_words, tuple(r["items"])) for r in decontam.search(index, bench.where(some)).collect())
        assert got == Counter((r[0], *(lambda h: (h[0], tuple(h[2])))(plain_hits(r[1], part))) for r in all_rows)


def test_clashing_names_string_ids_and_benchmarks_of_nulls(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([("a", text, 1), ("a", text, 1), (None, None, 2), ("b", "other", 3)], "doc_id string, text string, _items int").withColumn("shard", F.lit("x")).withColumn("_gone", F.lit("y"))
    bench = spark.createDataFrame([(1, text), (1, text)], "item_id long, text string")
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or "", r.shard) for r in kept.collect()) == [("", "x"), ("b", "x")]
    assert [r["items"] for r in decontam.report(docs, bench).where("id = 'a'").collect()] == [["1"]] * 2
    nulls = spark.range(3).selectExpr("id as item_id", "cast(null as string) as text")
    assert decontam.report(docs, nulls).where("n_hit = 0").count() == 4


def cases(spark, docs, rows):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 13, 14, 30])))) for i in range(25)]
    items += [(7, "short one"), (7, "two words"), (None, "EMOJI text"), (90, None), (91, "..."), (92, "One")]
    texts = []
    for _ in range(40):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(3)]
        parts.insert(1, rng.choice(items[:25])[1].upper() if rng.random() < 0.7 else "")
        texts.append(rng.choice([". ", "\n", "-"]).join(parts))
    more = [(1000 + i, t, None, None, None, None, None) for i, t in enumerate([*texts, items[4][1] + " é", "wé " + items[4][1]])]
    return docs.union(spark.createDataFrame(more, docs.schema)), spark.createDataFrame(items, "item_id long, text string"), [*rows, *more], items


def test_decontamination_equals_brute_force(spark, docs, rows, empty, monkeypatch):
    whole, bench, all_rows, items = cases(spark, docs, rows)
    want = Counter()
    for r in all_rows:
        n, hit, ids, words = plain_hits(r[1], items)
        spans = sorted({(words[a].start(), words[b].end()) for a in hit if a - 1 not in hit for b in [next(x for x in range(a, n) if x + 1 not in hit)]})
        want[r[0], n, len(hit), tuple(ids), tuple(spans), bool(hit) and 20 * len(hit) >= n] += 1
    as_rows = lambda df: Counter((r.id, r.n_words, r.n_hit, tuple(r["items"]), tuple((s["from"], s["to"]) for s in r.removal), r.contaminated) for r in df.collect())
    assert as_rows(decontam.report(whole, bench)) == want and any(k[5] for k in want)
    monkeypatch.setattr(decontam, "PASS_WORDS", 40)
    monkeypatch.setattr(decontam, "SHARD_SYMBOLS", 50)
    assert as_rows(decontam.report(whole, bench)) == want
    kept = decontam.clean(whole, bench)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r[0], r[1]) for r in all_rows if not (lambda h: h[1] and 20 * len(h[1]) >= h[0])(plain_hits(r[1], items)))
    assert decontam.report(empty, bench).count() == 0
    assert decontam.clean(docs, bench.where("item_id > 999")).count() == docs.count()


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["### user: ", "</turn>\n", "\\", "\\b", "\\l", "#", "<", "\n", "word", "two words", "é😀", "", " ", ":"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd: role#"]), "".join(rng.choices(bits, k=rng.randint(0, 30))) if rng.random() < 0.9 else None, "clash") for c in range(6) for t in range(rng.choice([1, 2, 40]))]
    rows += [(9, 0, "system", "rules", ""), *[(9, t, ["assistant", "user"][t % 2], "w " * 9, "") for t in range(1, 60)], (None, None, "user", "x", ""), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string").repartition(3)
    out = chat.windows(df, budget=60, history=20)
    back = {r.conv: r for r in chat.read_back(out).collect()}
    want = defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(back) == set(want)
    for c, turns in want.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        assert [(t.role, t.text) for t in back[c].turns] == [t[1:] for t in turns]
        assert list(back[c].targets) == [t[2] for t in turns if t[1] == "assistant"]
    nine = sorted((r.window, r.text, r.own_from) for r in out.where("conv = 9").collect())
    assert len(nine) > 5 and all(text.startswith("### system: rules</turn>") for _, text, _ in nine)
    assert all(len(text.split()) <= 60 and own > 30 for _, text, own in nine[1:])
    d = {r.conv: r for r in chat.digests(chat.read_back(out)).collect()}[9]
    told = "".join(f"{r}\n{t}\n" for _, r, t in want[9])
    assert d.turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and d.n_turns == 60
    assert d.formatted_chars == sum(len(t) for _, t, _ in nine) and d.loss_chars == sum(len(t) for _, r, t in want[9] if r == "assistant")
    assert chat.read_back(chat.windows(df.where("false"))).count() == 0


def test_chat_windows_keep_the_budget_and_the_system_turns(spark):
    rng = random.Random(8)
    rows = [(1, t, "system" if t in (0, 1, 40) else ["user", "assistant"][t % 2], "w " * rng.randint(0, 40)) for t in range(200)]
    rows += [(2, None, "user", "early"), (2, 3, "assistant", "a " * 30), (2, 3, "system", "rules"), *[(2, t, "user", "u " * rng.choice([1, 150, 400])) for t in range(4, 60)]]
    rows += [(3, 0, "system", "long " * 900), *[(3, t, "assistant", "b " * 50) for t in range(1, 40)], *[(4, t, "system", "s " * 30) for t in range(50)]]
    rows += [(5, 0, "system", "half " * 190), *[(5, t, "assistant", "b " * 30) for t in range(1, 40)]]
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=400, history=50, slack=40).collect()
    made = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.conv, r.window)):
        made[r.conv].append([(x.split(": ")[0][4:], len(x.split()), x) for x in r.text.split("</turn>\n")[:-1]] + [r])
    count = lambda w: sum(n + (x.endswith(": ")) for _, n, x in w[:-1])
    for c in (1, 4):
        assert len(made[c]) > 4 and all(count(w) <= 400 for w in made[c])
    for w in made[2]:  # over the budget only with one turn that is too long for it
        assert count(w) <= 400 or w[-1].text[w[-1].own_from :].count("</turn>") == 1
    firm = [x for _, _, x in made[1][0][:2]]
    assert all([x for _, _, x in w[:2]] == firm for w in made[1])
    where = [i for i, w in enumerate(made[2]) if any(r == "system" for r, _, _ in w[:-1])]
    assert where == list(range(where[0], len(made[2]))) and len(where) > 5
    # A first system turn that is too long to be repeated is a turn of its own, and leaves the others their room.
    assert [x for w in made[3] for x in w[:-1]][0][0] == "system" and len(made[3][0]) == 2
    assert all(all(r != "system" for r, _, _ in w[:-1]) and count(w) <= 400 for w in made[3][1:])
    assert len(made[5]) > 3 and all(w[0][0] == "system" and count(w) <= 400 for w in made[5])
    assert all(sum(r == "system" and x in {y for _, _, y in made[4][0][:-1]} for r, _, x in w[:-1]) for w in made[4])
    repeated = [r.text[: r.own_from] for r in out if r.conv == 1 and r.window]
    assert all(len("".join(x for x in t.split("### ")[4:]).split()) <= 50 + 60 for t in repeated)
