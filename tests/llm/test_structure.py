"""Structure repair against plain dynamic programming, over whole conversations and in the query."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodestone.llm import queries, structure

GOOD = re.compile(r"(s?(ua)+)?\Z")


def plain_repair(signs):
    """(cost, audit) by trying every path: least cost, then least audit."""
    n = len(signs)

    def better(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value

    # By the last role so far: none, s, u or a.
    layer = {"": (0, "")}
    for i in range(n + 1):
        for _ in range(4):  # inserted turns before row i, or at the end
            for last, (cost, audit) in list(layer.items()):
                new = "a" if last == "u" else "u"
                better(layer, new, (cost + 2, audit + "I"))
        if i == n:
            break
        onward = {}
        sign = signs[i]
        for last, (cost, audit) in layer.items():
            better(onward, last, (cost + 3, audit + "D"))
            if sign in "1234":
                continue
            extra = sign.isupper()
            low = sign.lower()
            if (low == "s" and last == "") or (low == "u" and last != "u") or (low == "a" and last == "u"):
                better(onward, low, (cost + extra, audit + "K"))
            better(onward, "a" if last == "u" else "u", (cost + 2 + extra, audit + "R"))
        layer = onward
    return min(layer[q] for q in ("", "a") if q in layer)


def best_of(found):
    return min(found[q] for q in structure.ENDS if q in found)


def test_search_equals_dynamic_programming_on_all_short_and_many_long_sequences():
    signs = structure.LETTERS + structure.TRUNCATED + "14"
    for n in range(4):
        for s in itertools.product(signs, repeat=n):
            assert best_of(structure.search("".join(s), structure.NOTHING)) == plain_repair("".join(s)), s
    rng = random.Random(4)
    for _ in range(300):
        s = "".join(rng.choices(signs, k=rng.randint(4, 40)))
        cost, audit = best_of(structure.search(s, structure.NOTHING))
        assert (cost, audit) == plain_repair(s), s
        turns = structure.written(audit, s, structure.NOTHING)
        roles = "".join({"K": s[min(i, len(s) - 1)].lower()}.get(t, t.lower()) for i, own in enumerate(turns) for t in own)
        assert GOOD.match(roles) and len(turns) == len(s) + 1


def plain_rows(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_report(rows):
    """What the query returns, by its contract."""
    got = {}
    damaged = plain_rows(rows)
    for c in {r[0] for r in rows}:
        own = sorted((r[1:] for r in damaged if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        signs, seen, faults = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for t, role, text in own:
            first = role[:1] if role[:1] in tuple("sua") else "x"
            end = re.findall(r"[^\x20\x09-\x0D]", text)
            k = "suax".index(first)
            if not end:
                faults["blank"] += 1
                signs += "1234"[k]
            elif (role, text) in seen:
                faults["duplicate"] += 1
                signs += "1234"[k]
            elif end[-1] not in ".!?":
                faults["truncated"] += 1
                signs += "SUAX"[k]
            else:
                signs += "suax"[k]
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        letters = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        cost, audit = plain_repair(signs)
        lines, last, i = [], "", 0
        for e in audit:
            new = "a" if last == "u" else "u"
            if e == "I":
                lines.append({"u": "user:", "a": "assistant:"}[new])
                last = new
                continue
            if e == "K":
                lines.append(f"{own[i][1]}:{own[i][2]}")
                last = own[i][1][0]
            elif e == "R":
                lines.append({"u": "user:", "a": "assistant:"}[new] + own[i][2])
                last = new
            i += 1
        got[c] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return got


def conversations(rng, n):
    rows = []
    say = lambda: rng.choice(["Yes.", "No!", "Why?", "cut of", "", " \n", None, "same.", "same.", "é ünd.\n ", "x .", "nbsp "])
    for c in [*range(n), None]:
        for t in range(rng.choice([1, 2, 3, 5, 8, 30])):
            for _ in range(rng.choice([1, 1, 1, 1, 2])):
                rows.append((c, rng.choice([t, t, t, None, 2 * t]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]), say()))
    return rows + rows[5:9]


@pytest.mark.parametrize("bits", [8, 2])
def test_query_equals_the_plain_version(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(structure, "PIECE_BITS", bits)
    rows = conversations(random.Random(bits), 60)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, conv string, at string")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op11_structure(spark, str(tmp_path))
    assert [k for _, k in out.dtypes] == ["bigint"] * 7 + ["string"] * 2
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    assert got == plain_report(rows)


def test_a_long_conversation_is_repaired_in_pieces_over_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(structure, "PIECE_BITS", 4)
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), rng.choice(["Yes.", "cut", f"say {t}.", f"more {t}"])) for t in range(1500)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_structure(spark, str(tmp_path)).collect()}
    assert got == plain_report(rows)


def test_empty_and_wholly_dropped_conversations(spark, tmp_path):
    kind = "conv_id long, turn int, role string, text string"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert queries.op11_structure(spark, f"{tmp_path}/a").count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi."), (None, None, None, None)], kind).write.parquet(f"{tmp_path}/b/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_structure(spark, f"{tmp_path}/b").collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got == plain_report([(gone, 0, "user", "Hi."), (None, None, None, None)]) and got[gone] == (0, 0, 0, 0, 0, 0, "", none)
