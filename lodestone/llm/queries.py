"""The queries of this subpackage over the tables in a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; -1 if it is null."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)), F.lit(-1))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, spans

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(_remainder(4) != 2))
    found = spans(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "spans")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of each text: a cut, an insertion and a replacement."""
    from .tokens import token_counts

    n = F.coalesce(F.length("text"), F.lit(0))
    quarter = F.floor(n / 4).cast("int")
    edit = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), t.alias("text"))
    edits = F.array(edit(quarter, quarter + 5, F.lit("")), edit(2 * quarter, 2 * quarter, F.lit(" an inserted phrase's")), edit(3 * quarter, 3 * quarter + 8, F.substring("text", 1, 8)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return token_counts(docs, edits_col="edits").withColumnRenamed("id", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, scored

    docs = table(spark, sf_dir, "documents")
    scorer = fit(docs, table(spark, sf_dir, "labels").where(_remainder(5) != 0))
    found = scored(docs.select("doc_id", "text"), scorer)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import repeated_lines

    found = repeated_lines(table(spark, sf_dir, "documents"), words=True)
    return found.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "n_links")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import report

    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, read_back, windows

    both = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], both.schema)
    found = digests(read_back(windows(both.unionByName(extra))))
    return found.withColumnRenamed("conv", "conv_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture, words_taken

    return words_taken(*mixture(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.col("shard").alias("first_shard"), F.col("slot").alias("first_slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    dealt = shard_documents(table(spark, sf_dir, "documents"))
    return dealt.select(F.col("id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketch import SCALE, edited_fingerprints

    found = edited_fingerprints(table(spark, sf_dir, "documents"), scale=SCALE)
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair; the digest of a conversation needs its turns together."""
    from .structure import damaged, repair, repaired, report

    every = table(spark, sf_dir, "conversations")
    rows, found = repair(damaged(every))
    line = F.struct("place", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = repaired(rows, found).groupBy(F.col("conv").alias("c")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"), 256).alias("sha"))
    ids = every.select("conv_id").distinct()
    met = ids.join(report(rows, found), F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import drawn, weights

    found = drawn(weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import neighbours

    found = neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_tokens, op3_toxicity, op4_lines, op5_decontamination, op6_simhash, op7_chat, op8_mixing, op9_sharding, op10_sketch, op11_structure, op12_importance, op13_neighbours)}


#: A-Z as a-z, nothing else changed.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') key
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
place AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') key
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT DISTINCT place.doc_id, place.i, place.n, win.item_id FROM place JOIN win USING (n, key)),
hit AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR s FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP7 = """
WITH every AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
t AS (SELECT *, len(regexp_extract_all('### ' || role || ': ' || text || '</turn>', '[^ \\t\\n\\x0B\\f\\r]+')) tokens
  FROM (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM every)),
n AS (SELECT *, row_number() OVER o no, role = 'system' AND (sum(tokens) FILTER (role = 'system') OVER p <= 256 OR count(*) FILTER (role = 'system') OVER p = 1 AND sum(tokens) FILTER (role = 'system') OVER p <= 512) kept,
  length(role) + length(text) + len(regexp_extract_all(role, '[\\\\<#:]')) + len(regexp_extract_all(text, '[\\\\<#]')) + 14 chars
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), p AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, CASE WHEN kept THEN 0 ELSE tokens END cost, greatest(128, 768 - coalesce(sum(tokens) FILTER (kept) OVER (PARTITION BY conv_id), 0)) room FROM n),
b AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY no ROWS UNBOUNDED PRECEDING) - cost before FROM c),
l AS (SELECT *, (2 * (before // room) + (cost > 128 AND before + cost > (before // room + 1) * room)::INT)::BIGINT span FROM b),
s AS (SELECT *, max(span) OVER (PARTITION BY conv_id) top FROM l),
own AS (SELECT conv_id, span, min(before) start, lead(span) OVER (PARTITION BY conv_id ORDER BY span) following FROM s GROUP BY conv_id, span),
seen AS (SELECT conv_id, span, chars FROM s
  UNION ALL SELECT s.conv_id, own.span, chars FROM s JOIN own ON s.conv_id = own.conv_id AND own.span > s.span WHERE kept
  UNION ALL SELECT s.conv_id, after.span, chars FROM s JOIN own USING (conv_id, span) JOIN own after ON own.conv_id = after.conv_id AND own.following = after.span
  WHERE NOT kept AND after.start - before <= 128),
f AS (SELECT conv_id, sum(chars)::BIGINT formatted_chars FROM seen GROUP BY conv_id)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) loss_sha256, any_value(formatted_chars) formatted_chars
FROM s JOIN f USING (conv_id) GROUP BY conv_id"""


#: crc32 of a word or pair, bit by bit: the UTF-8 bytes' bits, least first, go through the polynomial.
_BITS = "list_transform(range(8 * octet_length(encode(key))), lambda i: (('0x' || substr(hex(encode(key)), 2 * (i // 8) + 1, 2))::BIGINT >> (i % 8)) & 1)"
_CRC32 = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BITS}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"



def _more(path: str, cost: str, edit: str) -> str:
    return f"CASE WHEN {path} IS NULL THEN NULL ELSE {{'c': {path}.c + {cost}, 'a': {path}.a || '{edit}'}} END"


def _best(*paths: str) -> str:
    return f"list_min([{', '.join(paths)}])"


#: Least (cost, audit) by state of the roles so far, n nothing, s, u, a: with turns inserted, and after one more row.
_INSERTED = f"n, s, {_best('u', *(_more(x, '2', 'I') for x in 'nsa'))} u, {_best('a', _more('u', '2', 'I'), _more('n', '4', 'II'), _more('s', '4', 'II'))} a"
_STAYS = lambda path, letter: (f"CASE WHEN NOT gone AND letter = '{letter}' THEN {_more(path, 'cut', 'K')} END", f"CASE WHEN NOT gone THEN {_more(path, '2 + cut', 'R')} END")
_NEXT = f"""{_more('n', '3', 'D')} n, {_best(_more('s', '3', 'D'), f"CASE WHEN NOT gone AND letter = 's' THEN {_more('n', 'cut', 'K')} END")} s,
  {_best(_more('u', '3', 'D'), *(x for q in 'nsa' for x in _STAYS(q, 'u')))} u, {_best(_more('a', '3', 'D'), *_STAYS('u', 'a'))} a"""

OP11 = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') key FROM conversations),
h AS (SELECT key, {_CRC32} % 20 h FROM (SELECT DISTINCT key FROM k)),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END text, unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) copy FROM k JOIN h USING (key) WHERE h <> 0),
g AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) no, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) last FROM d),
f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY no) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END fault FROM g),
r AS (SELECT g, no, role, text, left(role, 1) letter, fault IN ('blank', 'duplicate') gone, (fault = 'truncated')::INT cut FROM f),
t AS (SELECT g, any_value(conv_id) conv_id, count(*) n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (fault = 'blank') blank, count(*) FILTER (fault = 'duplicate') duplicate, count(*) FILTER (fault = 'truncated') truncated FROM f GROUP BY g),
j AS (SELECT g, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) illegal FROM (SELECT g, lag(letter) OVER (PARTITION BY g ORDER BY no) || letter pair FROM r) GROUP BY g),
p AS (SELECT g, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} n, NULL::STRUCT(c BIGINT, a VARCHAR) s, NULL::STRUCT(c BIGINT, a VARCHAR) u, NULL::STRUCT(c BIGINT, a VARCHAR) a FROM t
  UNION ALL SELECT g, i + 1, {_NEXT} FROM (SELECT g, i, {_INSERTED} FROM p) JOIN r USING (g) WHERE no = i + 1),
b AS (SELECT g, {_best('n', 'a')} best FROM (SELECT g, {_INSERTED} FROM p JOIN t USING (g) WHERE i = n_rows)),
e AS (SELECT g, best.a audit, unnest(range(1, length(best.a) + 1)) AS pos FROM b),
o AS (SELECT e.g, pos, substr(audit, pos, 1) edit, length(replace(substr(audit, 1, pos), 'D', '')) place, role, text FROM e LEFT JOIN r ON r.g = e.g AND r.no = length(replace(substr(audit, 1, pos), 'I', ''))),
w AS (SELECT *, bool_or(place = 1 AND edit = 'K' AND role[1] = 's') OVER (PARTITION BY g) led FROM o WHERE edit <> 'D'),
l AS (SELECT g, string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE (place - led::INT) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) lines FROM w GROUP BY g),
x AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.c cost, best.a audit, lines FROM t JOIN j USING (g) JOIN b USING (g) LEFT JOIN l USING (g))
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate, coalesce(truncated, 0)::BIGINT truncated, coalesce(illegal, 0)::BIGINT illegal,
       coalesce(cost, 0)::BIGINT cost, coalesce(audit, '') audit, sha256(coalesce(lines, '')) repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM i.conv_id"""

OP12 = f"""
WITH every AS (SELECT 0 AS side, doc_id, row_number() OVER () no, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
w AS (SELECT side, doc_id, no, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM every),
f AS (SELECT side, no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) key FROM w),
each AS (SELECT side, no, key, count(*) n FROM f GROUP BY ALL),
known AS (SELECT key, {_CRC32} % 10000 bucket FROM (SELECT DISTINCT key FROM each)),
held AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) s, coalesce(sum(n) FILTER (side = 1), 0) t FROM each JOIN known USING (key) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) ss, coalesce(sum(t), 0) tt FROM held),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT gain FROM held, total),
sums AS (SELECT no, sum(n)::BIGINT n_features, sum(n * gain)::BIGINT total FROM each JOIN known USING (key) JOIN gain USING (bucket) WHERE side = 0 GROUP BY no),
d AS (SELECT doc_id, len(w) n_words, coalesce(n_features, 0) n_features, coalesce(floor(total / n_features), 0)::BIGINT weight,
  ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT h FROM w LEFT JOIN sums USING (no) WHERE side = 0),
r AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT score FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) place, count(*) FILTER (n_words >= 20) OVER () able FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS "rank" FROM o"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5, "op7_chat": OP7, "op11_structure": OP11, "op12_importance": OP12}
