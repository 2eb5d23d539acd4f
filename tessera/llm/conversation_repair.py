"""Repair of conversations by iterative-deepening A*.

A conversation's rows are edited until the initials of their roles are an optional system row and then pairs of user and assistant: Keep, Rerole,
Delete and Insert, at the least cost, and of all cheapest edits those whose initials come first in ASCII. The search is depth first in the order
D, I, K, R under a bound that grows to the next cost that may do; a table keeps for every state (row, what the next role must be) the least cost
that its failures have proved, so no failed state is tried again with as little left, and the first path that is accepted is the answer.

A conversation may hold most rows, so it is cut: Spark orders all rows by range, and runs of at most ``SEGMENT`` rows of a conversation are searched apart.
Inserts come before a row, or at the very end, so the edits of a run don't depend on where it was cut, and neither is the first in ASCII among the cheapest.
Three steps: searches give the cost of each run between any two states; a stream over a conversation's runs, last to first, gives what the
rest costs from each state; searches with these ends give each run's edits from each state, and a stream, first to last, chains them. The streams hold one
run at a time; the hash of a conversation is over its texts one after the other, which no cut could spare.

Styles: order, faults, ties and counts are DataFrame functions; runs, searches and streams are Python on Arrow batches.

Defined results: nulls are one space in every column of the rules (a null text is blank, a null role can't be kept); a null conv_id is a conversation; rows of
the same turn are ordered by role, then by the MD5 of their text; an empty role has no initial and can't be kept, and a pair with it is illegal; a role counts by its first character; repeated rows are
duplicates of the first; a conversation that loses all rows has zeros; an empty table gives no rows; other columns are ignored; texts of any length are read whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written

SEGMENT, RANGE_ROWS = 64, 20_000
INFINITE = 1 << 40
#: States: nothing yet, after system, after user, after assistant. What a row of a role leads to, and an insert or rerole.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FORCED = (USER, USER, ASSISTANT, USER)
FORCED_ROLE = ("user", "user", "assistant", "user")
#: At the end: the cost of each state and the inserts that it needs.
AT_END = ((0, ""), (4, "II"), (2, "I"), (0, ""))
#: Of a row, the initial of its role, whether it must go, whether it is truncated.
ROW = tuple[str, bool, bool]


def search(rows: list[ROW], entry: int, ends: tuple[int, ...]) -> tuple[int, str, int] | None:
    """The cheapest edits of a run from a state, where leaving it in state q costs ends[q] more: cost, initials, state at the end. None: no way."""
    n = len(rows)
    floor = [min(ends)] * (n + 1)
    for k in range(n - 1, -1, -1):
        floor[k] = floor[k + 1] + (3 if rows[k][1] else 1 if rows[k][2] else 0)
    most = 3 * n + 4 + max((e for e in ends if e < INFINITE), default=0)
    proved: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def least(k: int, q: int) -> int:
        return ends[q] if k == n else proved.get((k, q), floor[k])

    def moves(k: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        initial, gone, cut = rows[k]
        yield "D", 3, k + 1, q
        yield "I", 2, k, FORCED[q]
        if not gone:
            to = KEEP[q].get(initial)
            if to is not None:
                yield "K", int(cut), k + 1, to
            yield "R", 2 + cut, k + 1, FORCED[q]

    # depth first with a stack of its own: state, cost left, moves not yet tried, the least cost that the tried ones have proved
    bound = least(0, entry)
    while bound <= most:
        stack = [[0, entry, bound, moves(0, entry) if n else iter(()), INFINITE]]
        if not n:
            return (ends[entry], "", entry) if ends[entry] < INFINITE else None
        while stack:
            k, q, left, todo, best = stack[-1]
            for edit, cost, to, state in todo:
                need = least(to, state)
                if cost + need > left:
                    best = min(best, cost + need)
                    continue
                path.append(edit)
                if to == n:
                    return bound, "".join(path), state
                stack[-1][4] = best
                stack.append([to, state, left - cost, moves(to, state), INFINITE])
                break
            else:
                proved[k, q] = max(least(k, q), best)
                stack.pop()
                if stack:
                    path.pop()
                    edit_cost = stack[-1][2] - left
                    stack[-1][4] = min(stack[-1][4], edit_cost + proved[k, q])
        grown = least(0, entry)
        if grown <= bound:
            return None
        bound = grown
    return None


def between(rows: list[ROW]) -> list[list[int]]:
    """The cost of a run from each state to each state."""
    may = any(i == "s" and not gone for i, gone, _ in rows)
    out = [[INFINITE] * 4 for _ in range(4)]
    for q in range(4):
        for to in range(4):
            if q == to and q in (START, SYSTEM):
                out[q][to] = 3 * len(rows)  # every row goes
                continue
            if to == START or to == SYSTEM and not (q == START and may):
                continue
            found = search(rows, q, tuple(0 if s == to else INFINITE for s in range(4)))
            out[q][to] = found[0] if found else INFINITE
    return out


def visible(text: Column, pattern: str = r"[^\x20\x09-\x0D]") -> Column:
    return text.rlike(pattern)


def damaged(rows: DataFrame) -> DataFrame:
    """From conv_id, turn, role, text: the rows that the rule of damage leaves; id tells repeated rows apart."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    out = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"), hit.alias("hit"), F.monotonically_increasing_id().alias("row"))
    out = out.where("hit != 0").withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role"))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("row") * 2 + F.col("copy")).alias("id"))


def faulty(rows: DataFrame) -> DataFrame:
    """From damaged rows: their order (conv_id, turn, role, digest, id) without the texts, and fault: blank, duplicate, truncated or null, the first that holds."""
    text = F.col("text")
    shape = F.when(~visible(text), "blank").when(~visible(text, r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    rows = rows.select("conv_id", "turn", "role", digest().alias("digest"), "id", shape.alias("shape"))
    # the first of equal rows, by the least of its order, so that a row repeated very often costs one row for each task
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "id")).alias("first"))
    same = F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.role") == F.col("f.role")) & (F.col("r.digest") == F.col("f.digest"))
    again = F.when((F.col("shape").isNull() | (F.col("shape") != "blank")) & (F.col("r.id") != F.col("f.first.id")), "duplicate")
    return rows.alias("r").join(first.alias("f"), same).select(*[f"r.{c}" for c in ("conv_id", *ORDER)], F.coalesce(again, "shape").alias("fault"))


def digest() -> Column:
    return F.md5(F.col("text").cast("binary"))


#: What orders the rows of a conversation.
ORDER = ["turn", "role", "digest", "id"]
RUN = "conv_id long, turn long, role string, digest string, id long, part int, seq int, codes array<string>, faults array<string>"


def runs(rows: DataFrame, segment: int = SEGMENT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """From faulty() (a stored table): runs of at most ``segment`` rows of a conversation, with the order of the first one; (part, seq) orders a conversation's runs."""
    parts = -(-rows.count() // range_rows) or 1
    ordered = rows.repartitionByRange(parts, "conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, seq = None, 0
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            conv, starts = plain(pdf["conv_id"]), [0]
            for k in range(1, len(pdf)):
                if k - starts[-1] == segment or conv[k - 1] != conv[k]:
                    starts.append(k)
            if len(starts) > 1:
                yield shown(pdf, starts, seq)
                seq += len(starts) - 1
            rest = pdf.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield shown(rest, [0, len(rest)], seq)

    def shown(pdf: pd.DataFrame, starts: list[int], seq: int) -> pd.DataFrame:
        initials, faults, at = [r[:1] for r in pdf["role"]], plain(pdf["fault"]), starts[:-1]
        out = pdf[["conv_id", *ORDER, "part"]].iloc[at].reset_index(drop=True)
        out["seq"] = range(seq, seq + len(at))
        out["codes"], out["faults"] = ([x[lo:hi] for lo, hi in zip(at, starts[1:], strict=True)] for x in (initials, faults))
        return out.astype({"conv_id": "Int64", "turn": "Int64"})

    return ordered.mapInPandas(cut, RUN)


def plain(values: pd.Series) -> list:
    """With None for nulls."""
    return [None if n else v for v, n in zip(values.tolist(), values.isna(), strict=True)]


def coded(codes: list, faults: list) -> list[ROW]:
    return [(c, f in ("blank", "duplicate"), f == "truncated") for c, f in zip(codes, faults, strict=True)]


def _streamed(df: DataFrame, order: list[Column], run, schema: str) -> DataFrame:
    """Conversations whole and in order, as a stream."""
    return df.withColumn("_c", F.xxhash64(F.col("conv_id").isNull(), "conv_id")).repartition("_c").sortWithinPartitions("_c", F.col("conv_id"), *order).drop("_c").mapInPandas(run, schema)


def rest_costs(found: DataFrame) -> DataFrame:
    """From the runs: conv_id, part, seq, rest: the least cost of all that comes after a run, by the state after it."""

    def costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # a conversation of one run needs no costs between states
            tables = [[] if alone else [x for row in between(coded(c, f)) for x in row] for alone, c, f in zip(pdf["alone"], pdf["codes"], pdf["faults"], strict=True)]
            yield pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "part": pdf["part"], "seq": pdf["seq"], "costs": tables})

    def backwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, state = None, None
        for pdf in batches:
            out = []
            for conv, table_ in zip(plain(pdf["conv_id"]), pdf["costs"], strict=True):
                if state is None or conv != before:
                    before, state = conv, [c for c, _ in AT_END]
                out.append(list(state))
                if len(table_):
                    state = [min(INFINITE, min(table_[4 * q + to] + state[to] for to in range(4))) for q in range(4)]
            yield pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "part": pdf["part"], "seq": pdf["seq"], "rest": out})

    many = found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    each = found.select("conv_id", "part", "seq", "codes", "faults").alias("r").join(many.alias("m"), F.col("r.conv_id").eqNullSafe(F.col("m.conv_id"))).select("r.*", (F.col("n") == 1).alias("alone"))
    between_ = each.mapInPandas(costs, "conv_id long, part int, seq int, costs array<long>")
    return _streamed(between_, [F.col("part").desc(), F.col("seq").desc()], backwards, "conv_id long, part int, seq int, rest array<long>")


def edits(found: DataFrame, rest: DataFrame) -> DataFrame:
    """The runs with, for each state before a run, cost (with the rest) and audit."""

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ways = []
            for c, f, ends, head in zip(pdf["codes"], pdf["faults"], pdf["rest"], pdf["head"], strict=True):
                rows, ends = coded(c, f), tuple(int(e) for e in ends)
                ways.append([search(rows, q, ends) if q == START or not head else None for q in range(4)])
            out = pdf[["conv_id", *ORDER, "faults"]].astype({"conv_id": "Int64", "turn": "Int64"})
            out["costs"], out["audits"] = ([[w[k] if w else None for w in x] for x in ways] for k in (0, 1))
            yield out

    heads = found.groupBy("conv_id").agg(F.min(F.struct("part", "seq")).alias("first"))
    same = lambda x: F.col("r.conv_id").eqNullSafe(F.col(f"{x}.conv_id"))
    each = found.alias("r").join(rest.alias("e"), same("e") & (F.col("r.part") == F.col("e.part")) & (F.col("r.seq") == F.col("e.seq")))
    each = each.join(heads.alias("h"), same("h")).select("r.*", "e.rest", ((F.col("r.part") == F.col("h.first.part")) & (F.col("r.seq") == F.col("h.first.seq"))).alias("head"))
    return each.mapInPandas(searched, "conv_id long, turn long, role string, digest string, id long, faults array<string>, costs array<long>, audits array<string>")


class _Report:
    """What is gathered of a conversation while its rows come by."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.state, self.cost, self.audit, self.sha, self.any = conv, START, None, [], hashlib.sha256(), False
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.last, self.rows, self.turn, self.low, self.distinct = 0, "", 0, None, None, 0

    def run(self, costs: list, audits: list, faults: list) -> None:
        """The edits of the next rows."""
        self.cost = int(costs[self.state]) if self.cost is None else self.cost
        self.edits, self.faults = iter(audits[self.state]), iter(faults)
        self.audit.append(audits[self.state])

    def emit(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def forced(self, text: str = "") -> None:
        self.emit(FORCED_ROLE[self.state], text)
        self.state = FORCED[self.state]

    def row(self, turn: int | None, role: str, text: str) -> None:
        while (edit := next(self.edits)) == "I":
            self.forced()
        code = role[:1]
        if edit == "R":
            self.forced(text)
        elif edit == "K":
            self.emit(role, text)
            self.state = KEEP[self.state][code]
        if fault := next(self.faults):
            self.counts[fault] += 1
        self.illegal += bool(self.rows) and self.last + code not in ("su", "ua", "au")
        self.last, self.rows = code, self.rows + 1
        if turn is not None:
            self.distinct += turn != self.turn
            self.low, self.turn = turn if self.low is None else self.low, turn

    def result(self) -> tuple:
        if self.rows:
            self.audit.append(AT_END[self.state][1])
            for _ in AT_END[self.state][1]:
                self.forced()
        gaps = self.turn - self.low + 1 - self.distinct if self.distinct else 0
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost or 0, "".join(self.audit), self.sha.hexdigest())


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reported(rows: DataFrame, ways: DataFrame, all_ids: DataFrame) -> DataFrame:
    """One row for each conversation of all_ids. Its rows (damaged ones, with their texts) and the edits of its runs come by in order, so texts are shuffled once."""
    none = lambda *kinds: [F.lit(None).cast(k.split(" ")[1]).alias(k.split(" ")[0]) for k in kinds]
    text, more = ["text string"], ["costs array<long>", "audits array<string>", "faults array<string>"]
    a = ways.select("conv_id", *ORDER, F.lit(1).alias("what"), *none(*text), *[m.split(" ")[0] for m in more])
    b = rows.select("conv_id", "turn", "role", digest().alias("digest"), "id", F.lit(2).alias("what"), "text", *none(*more))
    c = all_ids.select("conv_id", *none("turn long", "role string", "digest string", "id long"), F.lit(0).alias("what"), *none(*text), *none(*more))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        names = [x.split(" ")[0] for x in OUT.split(", ")]
        for pdf in batches:
            out = []
            for what, conv, turn, role, text_, costs, audits, faults in zip(pdf["what"], plain(pdf["conv_id"]), plain(pdf["turn"]), pdf["role"], pdf["text"], pdf["costs"], pdf["audits"], pdf["faults"], strict=True):
                if what == 0:
                    if at is not None:
                        out.append(at.result())
                    at = _Report(conv if conv is None else int(conv))
                elif what == 1:
                    at.run(costs, audits, faults)
                else:
                    at.row(turn if turn is None else int(turn), role, text_)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if at is not None:
            yield pd.DataFrame([at.result()], columns=names).astype({"conv_id": "Int64"})

    first = (F.col("what") != 0).alias("first")
    return _streamed(a.unionByName(b).unionByName(c), [first, *[F.col(c) for c in ORDER], F.col("what")], report, OUT)


def repaired(given: DataFrame, rows: DataFrame, segment: int = SEGMENT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """From rows (conv_id, turn, role, text, id; no nulls in role and text): one row for each conversation of given."""
    found = written(runs(written(faulty(rows), "repair-rows"), segment, range_rows), "repair-runs")
    ways = edits(found, written(rest_costs(found), "repair-rest"))
    return reported(rows, ways, given.select(F.col("conv_id").cast("long")).distinct())


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired(given, damaged(given))
