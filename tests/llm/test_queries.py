"""The queries of the subpackage and the corpus pipeline over small folders of tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lodestone.llm import queries

from .test_sets import plain_fingerprint, plain_targets
from .test_text import plain_hits

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices(["the", "ing", "wh", "er", "on", "ta"], k=rng.randint(1, 3))) for _ in range(n))


def write(spark, folder, docs, labels, items, conversations=()):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(conversations), "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = {i: prose(rng, rng.choice([30, 60, 150])) for i in range(400)}
    toxic = set(range(0, 400, 5))
    for i in toxic:
        words = texts[i].split()
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(["moronic", "idiot!", "trashy"]))
        texts[i] = " ".join(words)
    items = [(k, prose(rng, 30)) for k in range(4)] + [(3, prose(rng, 20)), (9, None), (None, "x y"), (10, "...")]
    dirty = {7: items[0][1], 18: texts[18] + " " + items[1][1].upper(), 401: items[2][1]}
    texts |= dirty
    copies = {402: texts[11], 403: texts[11].upper(), 404: texts[12].replace(" ", "  "), 405: None, 406: "", 407: " \n"}
    texts |= copies
    rows = [(i, t, None if t is None else "en", rng.choice(["a", "b", "b", None]), None if t is None else len(t)) for i, t in texts.items()]
    rows += [rows[11], (None, texts[13] + " more", "en", "c", 1), (None, None, None, None, None)]
    labels = [(i, 1, int(i in toxic)) for i in range(400) if i % 7] + [(5, 1, None), (None, 0, 1)]
    return rows, labels, items, toxic, set(dirty), texts


def test_pipeline_keeps_what_is_clean_and_drops_what_is_not(spark, corpus, tmp_path):
    rows, labels, items, toxic, dirty, texts = corpus
    folder = write(spark, tmp_path, rows, labels, items)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{folder}/after_{k}")
        docs = spark.read.parquet(f"{folder}/after_{k}")
        seen.append([tuple(r) for r in docs.collect()])
    clean, single, pure, mixed, sharded = seen
    ids = {r[0] for r in clean}
    assert len(ids & toxic) <= 0.05 * len(toxic) and len({i for i in range(400)} - toxic - ids) <= 6
    # One row of each component of fingerprints within four bits.
    prints = [plain_fingerprint(r[1]) for r in clean]
    label = list(range(len(prints)))
    for _ in range(4):
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    groups = defaultdict(list)
    for r, g in zip(clean, label):
        groups[g].append(r)
    assert len(single) == len(groups) and not Counter(single) - Counter(clean)
    assert {r[0] for r in single} == {min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()}

    def bad(text):
        n, hit, _, _ = plain_hits(text, items)
        return bool(hit) and 20 * len(hit) >= n

    assert Counter(pure) == Counter(r for r in single if not bad(r[1])) and dirty & {r[0] for r in single} and not dirty & {r[0] for r in pure}
    size, taken = Counter(), Counter()
    for r in pure:
        size[r[3]] += len(SPACE.findall(r[1] or ""))
    for r in mixed:
        taken[r[3]] += len(SPACE.findall(r[1]))
    want = plain_targets(size)
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    counts = Counter(r[4] for r in sharded)
    assert len(sharded) == len(mixed) and max(counts.values()) - min(counts.values()) <= 1
    again = corpus_pipeline.run(spark, folder)
    assert Counter(tuple(r)[:4] for r in again.collect()) == Counter(r[:4] for r in sharded)


def test_pipeline_over_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [], [])).count() == 0


def test_queries_return_one_row_a_document_with_the_contracts_columns(spark, corpus, tmp_path):
    rows, labels, items, _, _, texts = corpus
    turns = [(1, 0, "system", "rules"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (None, None, "assistant", "x")]
    folder = write(spark, tmp_path, rows, labels, items, turns)
    n = Counter(r[0] for r in rows)
    kinds = {
        "op1_language": {"held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op2_tokens": {"n_tokens": "bigint", "edited_tokens": "bigint"},
        "op3_toxicity": {"held_out": "boolean", "score": "double", "predicted": "int"},
        "op6_simhash": {"fingerprint": "string", "component_id": "bigint"},
        "op8_mixing": {"size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op9_sharding": {"size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op10_sketch": {"n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    }
    for name, kind in kinds.items():
        out = queries.queries()[name](spark, folder)
        assert {k: v for k, v in out.dtypes if k in kind} == kind, name
        got = out.collect()
        assert Counter(r.doc_id for r in got) == n, name
        if "held_out" in kind:
            assert all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
        if name == "op1_language":
            assert all((r.lang_pred == "und") == (not re.search("[a-zA-Z]", texts.get(r.doc_id) or "")) for r in got if r.doc_id is not None)
        if name == "op6_simhash":
            assert all(int(r.fingerprint, 16) == plain_fingerprint(texts[r.doc_id]) for r in got if r.doc_id is not None)
    chat = {r.conv_id: r for r in queries.op7_chat(spark, folder).collect()}
    assert set(chat) == {1, None, -7} and chat[-7].loss_sha256 == hashlib.sha256(b"\\### Assistant: </turn> ok").hexdigest()


def test_token_counts_of_the_query_equal_counting_anew(spark, corpus, tmp_path):
    from lodestone.llm import tokens

    rows, labels, items, _, _, texts = corpus
    extra = [(900, "é 😀 don't\n\n  x" * 40, None, None, None), (901, " " * 500, None, None, None), (902, "ab", None, None, None)]
    folder = write(spark, tmp_path, [*rows, *extra], labels, items)
    count = lambda t: len(tokens.Counter(tokens.ranks_of(tokens.VOCABULARY)).encoding.encode_ordinary(t))
    want = Counter()
    for i, text, *_ in [*rows, *extra]:
        text, done = text or "", text or ""
        q = len(text) // 4
        for a, b, new in ((q, q + 5, ""), (2 * q, 2 * q, " an inserted phrase's"), (3 * q, 3 * q + 8, text[:8])):
            a = min(a, len(done))
            done = done[:a] + new + done[max(a, min(b, len(done))) :]
        want[i, count(text), count(done), len(done)] += 1
    got = queries.op2_tokens(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.edited_tokens, r.edited_chars) for r in got) == want


def test_shards_and_mixes_of_the_queries_hold_their_laws(spark, corpus, tmp_path):
    rows, labels, items, _, _, _ = corpus
    folder = write(spark, tmp_path, rows, labels, items)
    import zlib

    dealt = queries.op9_sharding(spark, folder).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in dealt) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    counts = Counter(r.shard for r in dealt)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1 and {r.law for r in dealt} == {"rows"}
    assert all(sorted(r.slot for r in dealt if r.shard == s) == list(range(n)) for s, n in counts.items())
    size, sizes, taken = Counter(), Counter(), Counter()
    for i, t, _, source, _ in rows:
        size[source] += len(SPACE.findall(t or ""))
        sizes[i, len(SPACE.findall(t or ""))] += 1
    goal = plain_targets(size)
    mixed = queries.op8_mixing(spark, folder).collect()
    assert Counter((r.doc_id, r["size"]) for r in mixed) == sizes
    source_of = {size[s]: s for s in size}
    for r in mixed:
        s = source_of[r.source_size]
        taken[s] += r.taken
        assert abs(r.target - goal[s]) < 1e-6 * (1 + goal[s]) and r.taken <= 2 * r["size"] and (r.first_shard is None) == (r.taken == 0)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in size)
