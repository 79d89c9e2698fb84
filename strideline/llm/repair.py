"""Repair of conversation structure by a grammar-compressed dynamic program.

A conversation's rows, in order, are symbols: the role (system, user, assistant, other) and the row's first fault
(none, blank, duplicate, truncated). The cheapest edits that make the roles read ``(s?(ua)+)?`` are a path through four
states: at the start, after a system row, after a user row, after an assistant row.

1. Rows get their places, faults and symbols by windows over the conversation.
2. Re-Pair over all conversations' symbol strings: the most frequent pairs become rules. A round takes many pairs at
   once, none of whose first symbols is another's second one, so replacing them doesn't interfere and counts stay exact.
3. Each rule gets one min-plus transfer matrix, made bottom-up of its two parts: the least cost between any two states,
   the rank of its audit among those of the same first state, and the state where the parts meet. The last is the
   rule's audit rope: an audit is spelled by going down to the parts.
4. A conversation is a walk over its compressed string with the rules' shared matrices, then up the states it came by.
5. Rows and audits are sorted together by conversation, and a stream applies the edits row by row.

Ranks settle ties without comparing texts: each row takes exactly one letter of D, K, R after any number of I, so of two
audits of the same rows neither begins the other, and whichever is less stays less when both are continued.

Any grammar gives the same results, so RULES and ROUNDS bound it; what it leaves out is read symbol by symbol.

Edge cases: null roles and texts are one space; null turns come first, turns with one number are ordered by role, then
text; a null conv_id is a conversation; repeated rows are duplicates; a conversation without rows costs nothing; only
conv_id, turn, role and text are read, so other columns' names can't clash; an empty table gives no rows. One
conversation's audit is one value, and its rows pass one task's stream, because its digest is a chain; rows aren't held
there, and sorting spills.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACES, cut

START, SYSTEM, USER, ASSISTANT = range(4)
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, KEEP_TRUNCATED = 1, 2, 5, 5
#: Symbols of rows: role times four plus fault.
SYMBOLS = 16
#: Bounds of the grammar; symbols of a string made at once; longest audit of a rule that a worker remembers.
RULES, ROUNDS, IN_ROUND, CHUNK, KEPT = 512, 16, 64, 4096, 1024
_INF = 1 << 60
_FIRST = ord("A")
#: Between strings; no symbol.
_GAP = "\n"
PLAN = "cost long, audit string"
FIXED = "conv_id long, place long, edit string, role string, text string"


def _next_role(state: int) -> int:
    """What an inserted or reroled row becomes: assistant after user, else user."""
    return ASSISTANT if state == USER else USER


def _terminal(symbol: int) -> tuple[list, list, list]:
    """Least costs, ranks and audits of one row, with what is inserted before it."""
    role, fault = divmod(symbol, 4)
    best: list[list] = [[(_INF, "")] * 4 for _ in range(4)]
    for i in range(4):
        state, cost, letters = i, 0, ""
        for _ in range(3):
            steps = [(state, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                extra = KEEP_TRUNCATED if fault == TRUNCATED else 0
                steps.append((_next_role(state), REROLE + extra, "R"))
                if role == 0 and state == START:
                    steps.append((SYSTEM, extra, "K"))
                if role in (1, 2) and role + 1 == _next_role(state):
                    steps.append((role + 1, extra, "K"))
            for j, c, letter in steps:
                best[i][j] = min(best[i][j], (cost + c, letters + letter))
            state, cost, letters = _next_role(state), cost + INSERT, letters + "I"
    costs = [[c for c, _ in row] for row in best]
    ranks = [[sorted(w for c, w in row if c < _INF).index(x) if c < _INF else 0 for c, x in row] for row in best]
    return costs, ranks, [[w for _, w in row] for row in best]


class Matrices:
    """The transfer matrix of every symbol and rule: costs, ranks, and where a rule's parts meet."""

    def __init__(self, rules: list[tuple[int, int]]):
        self.rules = rules
        self.costs, self.ranks, self.meets = [], [], []
        self._audits: dict[tuple[int, int, int], str] = {}
        for s in range(SYMBOLS):
            costs, ranks, audits = _terminal(s)
            self.costs.append(costs)
            self.ranks.append(ranks)
            self.meets.append(None)
            self._audits |= {(s, i, j): audits[i][j] for i in range(4) for j in range(4)}
        for left, right in rules:
            rows = [self.follow(self.costs[left][i], self.ranks[left][i], right) for i in range(4)]
            for to, part in zip((self.costs, self.ranks, self.meets), zip(*rows)):
                to.append(list(part))

    def follow(self, cost: list[int], rank: list[int], symbol: int) -> tuple[list[int], list[int], list[int]]:
        """One row of a product: costs, ranks and the state between, after a symbol that follows audits of these costs and ranks."""
        then, then_rank = self.costs[symbol], self.ranks[symbol]
        out, via = [_INF] * 4, [0] * 4
        for j in range(4):
            found = min((cost[k] + then[k][j], rank[k], k) for k in range(4))
            if found[0] < _INF:
                out[j], via[j] = found[0], found[2]
        order = sorted((rank[via[j]], then_rank[via[j]][j], j) for j in range(4) if out[j] < _INF)
        ranks = [0] * 4
        for n, (_, _, j) in enumerate(order):
            ranks[j] = n
        return out, ranks, via

    def audit(self, symbol: int, i: int, j: int) -> str:
        """The letters of the cheapest way from state i to j through a symbol."""
        found = self._audits.get((symbol, i, j))
        if found is None:
            left, right = self.rules[symbol - SYMBOLS]
            k = self.meets[symbol][i][j]
            found = self.audit(left, i, k) + self.audit(right, k, j)
            if len(found) <= KEPT:
                self._audits[symbol, i, j] = found
        return found

    def solve(self, symbols: list[int]) -> tuple[int, str]:
        """Cost and audit of a compressed string."""
        cost, rank, vias = [0, _INF, _INF, _INF], [0] * 4, []
        for s in symbols:
            cost, rank, via = self.follow(cost, rank, s)
            vias.append(via)
        ends = [(cost[START], rank[START], START, ""), (cost[ASSISTANT], rank[ASSISTANT], ASSISTANT, ""), (cost[USER] + INSERT, rank[USER], USER, "I"), (cost[SYSTEM] + 2 * INSERT, rank[SYSTEM], SYSTEM, "II")]
        total, _, state, tail = min(ends)
        parts = [tail]
        for s, via in zip(reversed(symbols), reversed(vias)):
            parts.append(self.audit(s, via[state], state))
            state = via[state]
        return total, "".join(reversed(parts))


def compress(strings: list[str], rules: list[tuple[int, int]]) -> str:
    """The strings between gaps, with every rule applied in order."""
    text = _GAP.join(strings)
    for n, (a, b) in enumerate(rules):
        text = text.replace(chr(_FIRST + a) + chr(_FIRST + b), chr(_FIRST + SYMBOLS + n))
    return text


def pair_counts(text: str, weights: list[int]) -> dict[tuple[int, int], int]:
    """How often pairs can be replaced in a compressed text, each string times its weight."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) - _FIRST
    if len(codes) < 2:
        return {}
    gap = ord(_GAP) - _FIRST
    weight = np.asarray(weights, np.int64)[np.cumsum(codes == gap)]
    a, b = codes[:-1], codes[1:]
    fits = (a != gap) & (b != gap)
    # Of a run of equal symbols every second pair counts.
    at = np.arange(len(a))
    starts = np.maximum.accumulate(np.where(np.concatenate([[True], a[1:] != a[:-1]]), at, 0))
    fits &= (a != b) | ((at - starts) % 2 == 0)
    pairs, where = np.unique(a[fits] << 32 | b[fits], return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, where, weight[:-1][fits])
    return {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(pairs, sums)}


def choose(counts: list[tuple[int, int, int]], room: int) -> list[tuple[int, int]]:
    """The most frequent pairs of which none's first symbol is another's second: (count, a, b), most frequent first."""
    firsts, seconds, out = set(), set(), []
    for n, a, b in counts:
        if n < 2 or len(out) == room:
            break
        if a in seconds or b in firsts or a == b and (a in firsts or b in seconds):
            continue
        firsts.add(a)
        seconds.add(b)
        out.append((a, b))
    return out


def grammar(strings: DataFrame) -> list[tuple[int, int]]:
    """Re-Pair rules over all symbol strings; strings: seq and n, how many conversations have it."""
    rules: list[tuple[int, int]] = []
    for _ in range(ROUNDS):

        def count(batches: Iterator, rules: list = rules) -> Iterator:
            import pyarrow as pa

            for b in batches:
                found = pair_counts(compress(b.column("seq").to_pylist(), rules), b.column("n").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([p[0] for p in found], [p[1] for p in found], list(found.values()))], names=["a", "b", "n"])

        counts = strings.mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        # Most of a round's pairs exclude each other, so more are looked at than taken.
        top = counts.filter("n > 1").orderBy(F.desc("n"), "a", "b").limit(4 * IN_ROUND).collect()
        new = choose([(r["n"], r["a"], r["b"]) for r in top], min(IN_ROUND, RULES - len(rules)))
        if not new:
            break
        rules = rules + new
    return rules


def mark(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """The rows with place (from 1), symbol and signs; rows that aren't present stay as conv_id alone, at place 0.

    turns: conv_id, turn, role, text."""
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    df = turns.select(F.col("conv_id").cast("long").alias("conv_id"), there.alias("there"), F.when(there, F.col("turn")).alias("turn"), F.when(there, F.coalesce("role", F.lit(" "))).alias("role"), F.when(there, F.coalesce("text", F.lit(" "))).alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy(F.desc("there"), F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "there", "role", "text").orderBy("place")
    initial = F.substring("role", 1, 1)
    df = df.withColumns({"place": F.row_number().over(ordered).cast("long"), "before": F.lag(initial).over(ordered), "last_turn": F.lag("turn").over(ordered)})
    df = df.withColumn("seen", F.row_number().over(same) > 1)
    white = " \t\n\x0b\f\r"
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACES}]"), BLANK).when(F.col("seen"), DUPLICATE)
        .when(~F.substring(F.rtrim("text", F.lit(white)), -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    )
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    letters = F.lit("".join(chr(_FIRST + i) for i in range(SYMBOLS)))
    return df.select(
        "conv_id", F.when(F.col("there"), F.col("place")).otherwise(0).alias("place"), "turn", "role", "text", F.when(F.col("there"), fault).alias("fault"),
        F.when(F.col("there"), F.substring(letters, kind * 4 + fault + 1, F.lit(1))).alias("symbol"),
        (F.col("there") & F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")).alias("illegal"),
        (F.col("there") & F.col("turn").isNotNull() & ((F.col("place") == 1) | ~F.col("turn").eqNullSafe(F.col("last_turn")))).alias("new_turn"),
    )


def plan(marked: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, counts of faults, cost and audit of its cheapest repair."""
    sums = {"lo": F.min("turn"), "hi": F.max("turn"), "turns": F.count_if("new_turn"), "illegal": F.count_if("illegal")} | {name: F.count_if(F.col("fault") == f) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    chunks = marked.groupBy("conv_id", ((F.col("place") - 1) / CHUNK).cast("long").alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("symbol").isNotNull(), F.struct("place", "symbol")))), lambda x: x["symbol"]), "").alias("seq"), *[x.alias(k) for k, x in sums.items()]
    )
    add = {"lo": F.min("lo"), "hi": F.max("hi")} | {k: F.sum(k) for k in sums if k not in ("lo", "hi")}
    whole = chunks.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("seq"), *[x.alias(k) for k, x in add.items()])
    whole = cut(whole)
    rules = grammar(cut(whole.groupBy("seq").agg(F.count("*").alias("n"))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matrices = Matrices(rules)
        for b in batches:
            strings = b.column("seq").to_pylist()
            places = {s: i for i, s in enumerate(dict.fromkeys(strings))}
            solved = [matrices.solve([ord(c) - _FIRST for c in x]) for x in compress(list(places), rules).split(_GAP)] if places else []
            found = [solved[places[s]] for s in strings]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=[*b.schema.names[:-1], "cost", "audit"])

    counts = ["blank", "duplicate", "truncated", "illegal"]
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    head = whole.select("conv_id", gaps, *[F.col(k).cast("long").alias(k) for k in counts], "seq")
    return head.mapInArrow(run, f"conv_id long, gaps long, {', '.join(f'{k} long' for k in counts)}, {PLAN}")


def apply_edits(marked: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), edit (K, R or I), role, text. A conversation's rows follow each other in one partition."""
    rows = marked.filter("place > 0").select("conv_id", "place", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = plans.select("conv_id", F.lit(0).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), "audit")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, kinds = ["conv_id", "place", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        audit, at, state, place = "", 0, START, 0
        for b in batches:
            out: list[tuple] = []
            for conv, here, role, text, new in zip(*(b.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", "audit"))):
                if not here:
                    audit, at, state, place = new, 0, START, 0
                else:
                    letter, at = audit[at], at + 1
                    if letter != "D":
                        state = (SYSTEM if role[:1] == "s" else _next_role(state)) if letter == "K" else _next_role(state)
                        place += 1
                        out.append((conv, place, letter, role if letter == "K" else ("user", "assistant")[state - USER], text))
                # Inserted rows stand before the next row's letter, or at the end.
                while at < len(audit) and audit[at] == "I":
                    state, at, place = _next_role(state), at + 1, place + 1
                    out.append((conv, place, "I", ("user", "assistant")[state - USER], ""))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=names)

    return rows.union(heads).repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, FIXED)


def digest(fixed: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of its ``role:text`` rows, joined by newlines; rows as apply_edits gives them."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        last, state, begun = None, None, False
        for b in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not begun or conv != last:
                    if begun:
                        out.append((last, state.hexdigest()))
                    last, state, begun = conv, hashlib.sha256(), True
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return fixed.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame, present: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan of every conversation and its repaired rows."""
    marked = cut(mark(turns, present))
    plans = cut(plan(marked))
    return plans, apply_edits(marked, plans)


def damage(turns: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops it (present is false), 1
    empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("fate"))
    fate = F.col("fate")
    df = df.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (fate != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1))).alias("copy"),
    )
    return df.drop("copy")


def repaired_digests(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row for each conversation: its plan and the digest of its repaired rows."""
    plans, fixed = repair(turns, present)
    found = digest(fixed).withColumnRenamed("conv_id", "of")
    joined = plans.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.drop("of").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
