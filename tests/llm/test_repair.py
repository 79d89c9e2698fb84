import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strideline.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sign(text):
    return re.search(r"[^\x20\x09-\x0D]", text)


def faults(rows):
    """First fault of each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\f\r")[-1:]
        out.append("blank" if not sign(text) else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest repair by a plain search over states with whole audits and texts."""
    want = {0: "u", 1: "u", 2: "a", 3: "u"}
    ways = {0: (0, "", ())}

    def better(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way

    def inserts(ways):
        for _ in range(3):
            for s, (c, audit, out) in list(ways.items()):
                better(ways, 3 if s == 2 else 2, (c + 5, audit + "I", (*out, ("assistant" if s == 2 else "user") + ":")))
        return ways

    for (_, role, text), fault in zip(rows, faults(rows)):
        new = {}
        for s, (c, audit, out) in inserts(dict(ways)).items():
            better(new, s, (c + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            better(new, 3 if s == 2 else 2, (c + 1 + extra, audit + "R", (*out, f"{'assistant' if s == 2 else 'user'}:{text}")))
            if role[:1] == want[s] or role[:1] == "s" and s == 0:
                better(new, {"s": 1, "u": 2, "a": 3}[role[:1]], (c + extra, audit + "K", (*out, f"{role}:{text}")))
        ways = new
    return min(w for s, w in inserts(ways).items() if s in (0, 3))


def expected(rows):
    """The result's row for rows (turn, role, text) in order."""
    turns = [r[0] for r in rows if r[0] is not None]
    f, pairs = faults(rows), [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, out = brute(rows)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: f.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if fate == 4 else role
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def result(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def made(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 30])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["One.", "Two!", "Three?", "cut off", "", " \n", "One. ", "é.", None, f"said {turn}.", f"more {turn}"])
            rows.append((conv, rng.choice([turn, turn, turn + 5, None]), role, text))
    return rows


def test_equals_plain_search(spark):
    rows = made(300)
    got = result(repair.repaired_digests(frame(spark, rows)))
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got.keys() == by.keys()
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert got[conv] == expected(own), own


def test_query_equals_plain_search(spark, sf_dir):
    from strideline.llm import entry

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = result(entry.queries()["op11_conversation_repair"](spark, sf_dir))
    want = damaged(rows)
    assert got.keys() == want.keys()
    for conv, own in want.items():
        assert got[conv] == expected(own), own


def test_long_conversation_goes_through_rules(spark):
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]) if i % 5 == 0 else ("user", "assistant")[i % 2], f"{i}{'.' if i % 7 else ''}") for i in range(3 * repair.CHUNK // 2)]
    got = result(repair.repaired_digests(frame(spark, rows)))
    assert got[7] == expected([r[1:] for r in rows])
    strings = spark.createDataFrame([("EIEIEI" * 50, 3), ("AEIEI", 2)], "seq string, n long")
    rules = repair.grammar(strings)
    assert len(repair.compress(["EIEIEI" * 50], rules)) <= 10 and rules[0] == (4, 8)


def test_rules_equal_symbols():
    rng = random.Random(2)
    rules = [(4, 8), (8, 4), (16, 16), (3, 3), (19, 17), (18, 12)]
    one, many = repair.Matrices([]), repair.Matrices(rules)
    for _ in range(300):
        s = "".join(chr(65 + rng.choice([0, 3, 4, 7, 8, 9, 12, 14])) for _ in range(rng.randrange(25)))
        assert many.solve([ord(c) - 65 for c in repair.compress([s], rules)]) == one.solve([ord(c) - 65 for c in s])


def test_pairs_are_counted_as_they_are_replaced():
    strings, weights = ["AAAAB", "AAA", "BAB", ""], [2, 1, 5, 9]
    got = repair.pair_counts(repair.compress(strings, []), weights)
    assert got == {(0, 0): 2 * 2 + 1, (0, 1): 2 + 5, (1, 0): 5}
    assert repair.choose([(9, 1, 2), (8, 2, 3), (7, 1, 4), (6, 5, 5), (5, 5, 6), (1, 8, 9)], 9) == [(1, 2), (1, 4), (5, 5)]


EDGES = [
    (None, None, None, None), (None, 1, "user", "null id."), (None, None, "user", "x."), (1, 0, "user", "a."), (1, 0, "user", "a."), (2, 3, "system", "only."),
    (3, 0, "user", "word " * 100_000), (3, 1, "assistant", "y" * 300_000 + "."), (4, 5, "assistant", "b."), (4, 5, "assistant", "a."), (5, 0, "user", "ends with a line separator. "),
]


def test_edges(spark):
    got = result(repair.repaired_digests(repair.damage(frame(spark, EDGES)), F.col("present")))
    want = {c: expected(own) for c, own in damaged(EDGES).items()}
    assert got == want
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = result(repair.repaired_digests(repair.damage(frame(spark, [(dropped, 0, "user", "gone.")])), F.col("present")))
    assert got == {dropped: dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}}


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]])
def test_clashing_columns_and_empty(spark, rows):
    df = frame(spark, rows).withColumns({c: F.lit("mine") for c in ("place", "present", "audit", "seq", "chunk", "n", "there", "fate", "copy", "symbol", "fault", "of", "cost")})
    got = result(repair.repaired_digests(df))
    assert got == ({1: expected([r[1:] for r in rows])} if rows else {})
    assert len(result(repair.repaired_digests(repair.damage(df), F.col("present")))) == len({r[0] for r in rows})


def test_repaired_rows(spark):
    plans, fixed = repair.repair(frame(spark, [(1, 0, "assistant", "a."), (1, 1, "assistant", "b.")]))
    assert plans.collect()[0]["audit"] == "RK"
    assert [tuple(r)[2:] for r in fixed.orderBy("place").collect()] == [("R", "user", "a."), ("K", "assistant", "b.")]
