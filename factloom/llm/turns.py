"""Conversation structure repair by dynamic programming over turns and grammar states.

A repaired conversation's role initials are ``(s?(ua)+)?``. Going through its rows in
order, each is kept, given the role that the grammar wants next, or deleted, and turns
without text may be inserted between them. The least cost from every row and grammar
state to the end is computed backwards; a forward walk then takes, among the edits that
keep to that cost, the one whose initial comes first in ASCII.

Rows are range-partitioned by conversation, turn, role and text, so a conversation of any
size is dealt over tasks like any other rows. The parts of a conversation that spans
several tasks are tied together by small tables: each part as a 4 x 4 matrix of least
costs from state to state, from which the costs at its end follow, then where the walk
leaves it from each state, from which its first state follows. Most conversations lie
whole in one part and need neither.

Defined results: a null role or text counts as one space; rows of one turn are taken in
the order of role and text, null turns first; a null conversation id is a conversation;
repeated rows are duplicates; a conversation without rows has zero counts, an empty audit
and no text; an empty table gives an empty result; extra columns are ignored. A
conversation's own result row holds its whole repaired text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut_lineage

#: Costs of edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar states: nothing yet, after a system turn, after a user's, after an assistant's. Role wanted next, and the state after it.
WANTED, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
NEVER = 1 << 40
SPACES = " \t\n\v\f\r"

Row = tuple[str, str, str]  # role, text, fault


def fault(text: str, seen: bool) -> str:
    """The first fault of a row; ``seen``: role and text came earlier."""
    last = text.rstrip(SPACES)[-1:]
    return "blank" if not last else "duplicate" if seen else "" if last in ".!?" else "truncated"


def kept_state(role: str, state: int) -> int | None:
    """The state after a row is kept as it is; None where the grammar forbids it."""
    initial = role[:1]
    return 1 if initial == "s" and state == 0 else AFTER[state] if initial == WANTED[state][0] else None


def with_inserts(cost: list[int]) -> list[int]:
    """Least costs when turns may be inserted first."""
    user, assistant = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return [min(cost[0], INSERT + user), min(cost[1], INSERT + user), user, assistant]


#: At the end of a conversation: empty or after an assistant's turn.
END = with_inserts([0, NEVER, NEVER, 0])


def costs_to_go(rows: list[Row], end: list[int]) -> list[list[int]]:
    """Least cost from each row (the end last) and state."""
    out = [end]
    for role, _, wrong in reversed(rows):
        after, cost = out[-1], []
        for state in range(4):
            best = DELETE + after[state]
            if wrong not in ("blank", "duplicate"):
                to = kept_state(role, state)
                stay = min(REROLE + after[AFTER[state]], NEVER if to is None else after[to])
                best = min(best, stay + (TRUNCATED if wrong == "truncated" else 0))
            cost.append(best)
        out.append(with_inserts(cost))
    return out[::-1]


def walk(rows: list[Row], costs: list[list[int]], state: int, last: bool) -> tuple[str, list[tuple[str, str]], int]:
    """(audit, repaired turns, state at the end): the ASCII-least among the cheapest edits; ``last`` ends the conversation."""
    audit, turns, i = [], [], 0
    while i < len(rows) or (last and state not in (0, 3)):
        now, wanted, ahead = costs[i][state], WANTED[state], AFTER[state]
        if i < len(rows):
            (role, text, wrong), after = rows[i], costs[i + 1]
            if now == DELETE + after[state]:
                audit.append("D")
                i += 1
                continue
        if now == INSERT + costs[i][ahead]:
            audit.append("I")
            turns.append((wanted, ""))
            state = ahead
            continue
        more = TRUNCATED if wrong == "truncated" else 0
        to = kept_state(role, state)
        if to is not None and now == more + after[to]:
            audit.append("K")
            turns.append((role, text))
            state = to
        else:
            audit.append("R")
            turns.append((wanted, text))
            state = ahead
        i += 1
    return "".join(audit), turns, state


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def cost_of(audit: str, rows: list[Row]) -> int:
    """What the edits cost, truncated rows that stay included."""
    total, at = 0, iter(rows)
    for edit in audit:
        wrong = "" if edit == "I" else next(at)[2]
        total += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit] + (TRUNCATED if wrong == "truncated" and edit != "D" else 0)
    return total


_ROW = "conv_id long, turn long, role string, text string, there boolean, part int, pos long, seen boolean"
_PIECE = (
    "conv_id long, part int, first_turn long, last_turn long, distinct_turns long, blank long, duplicate long, truncated long, illegal long, "
    "first_initial string, last_initial string, cost long, audit string, turns array<struct<role: string, text: string>>"
)
_MATRIX, _ENDS = "conv_id long, part int, least array<array<long>>", "conv_id long, part int, end array<long>, last boolean"
_EXITS, _STARTS = "conv_id long, part int, leaves array<long>", "conv_id long, part int, state int"


def _maker(ddl: str):
    """Rows to an Arrow table of a Spark schema."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def make(rows: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return make


def _marked():
    """Numbers the rows of a part and marks those whose role and text came earlier in it; dropped rows don't count."""
    make = _maker(_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, conv, known = TaskContext.get().partitionId(), 0, (), set()
        for batch in batches:
            rows = []
            for conv_id, turn, role, text, there in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != (conv_id,):
                    conv, known = (conv_id,), set()
                rows.append((conv_id, turn, role, text, there, part, pos, (role, text) in known))
                if there:
                    known.add((role, text))
                pos += 1
            yield from make(rows).to_batches()

    return run


def _rows(group: list[tuple]) -> list[Row]:
    return [(role, text, fault(text, seen)) for _, _, role, text, there, _, _, seen in group if there]


def _piece(group: list[tuple], end: list[int], state: int, last: bool) -> tuple:
    """The row of one part of a conversation."""
    rows = _rows(group)
    audit, turns, _ = walk(rows, costs_to_go(rows, end), state, last)
    numbers = [r[1] for r in group if r[4] and r[1] is not None]
    initials, wrong = [r[0][:1] for r in rows], [r[2] for r in rows]
    ends = (initials[0], initials[-1]) if rows else (None, None)
    counts = [wrong.count(w) for w in ("blank", "duplicate", "truncated")]
    first, last_turn = (min(numbers), max(numbers)) if numbers else (None, None)
    return (group[0][0], group[0][5], first, last_turn, len(set(numbers)), *counts, illegal_pairs(initials), *ends, cost_of(audit, rows), audit, [{"role": r, "text": t} for r, t in turns])


def _whole():
    """Pieces of conversations that lie whole in one part, as their rows pass by."""
    make = _maker(_PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out, size = [], 0
        for _, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)
            out.append(_piece(group, END, 0, True))
            size += len(group)
            if size >= 10_000:
                yield from make(out).to_batches()
                out, size = [], 0
        if out:
            yield from make(out).to_batches()

    return run


def _per_group(ddl: str, f):
    """``f`` of a group's rows in order, as an Arrow function."""
    make = _maker(ddl)
    return lambda table: make(f(sorted(zip(*(c.to_pylist() for c in table.columns), strict=True), key=lambda r: (r[5], r[6]) if len(r) > 6 else r[1])))


def _matrix(group: list[tuple]) -> list[tuple]:
    """Least costs from each state before a part to each state after it."""
    rows = _rows(group)
    columns = [costs_to_go(rows, [0 if i == j else NEVER for i in range(4)])[0] for j in range(4)]
    return [(group[0][0], group[0][5], [[min(c[i], NEVER) for c in columns] for i in range(4)])]


def _ends(parts: list[tuple]) -> list[tuple]:
    """The costs at the end of each part of a conversation."""
    out, end = [], END
    for conv_id, part, least in reversed(parts):
        out.append((conv_id, part, end, not out))
        end = [min(a + b for a, b in zip(row, end, strict=True)) for row in least]
    return out


def _exits(group: list[tuple]) -> list[tuple]:
    """The state in which the walk leaves a part, for each state it may come in."""
    rows, (end, last) = _rows([r[:8] for r in group]), group[0][8:]
    costs = costs_to_go(rows, end)
    return [(group[0][0], group[0][5], [walk(rows, costs, s, last)[2] if costs[0][s] < NEVER else s for s in range(4)])]


def _starts(parts: list[tuple]) -> list[tuple]:
    out, state = [], 0
    for conv_id, part, leaves in parts:
        out.append((conv_id, part, state))
        state = leaves[state]
    return out


def _spanning(rows: DataFrame) -> DataFrame:
    """Pieces of the conversations that lie in several parts, joined to one row each."""
    first = rows.filter("there").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("text").alias("_t")).agg(F.min("part").alias("_first"))
    said = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text") == F.col("_t"))
    earlier = F.col("seen") | F.coalesce(F.col("part") > F.col("_first"), F.lit(False))
    known = cut_lineage(rows.join(first, said, "left").withColumn("seen", earlier).select(*rows.columns))
    on = lambda a, b: [a.conv_id.eqNullSafe(b.conv_id), a.part == b.part]
    least = known.groupBy("conv_id", "part").applyInArrow(_per_group(_MATRIX, _matrix), _MATRIX)
    ends = cut_lineage(least.groupBy("conv_id").applyInArrow(_per_group(_ENDS, _ends), _ENDS))
    ended = known.join(ends, on(known, ends)).select(*[known[c] for c in known.columns], "end", "last")
    exits = ended.groupBy("conv_id", "part").applyInArrow(_per_group(_EXITS, _exits), _EXITS)
    starts = exits.groupBy("conv_id").applyInArrow(_per_group(_STARTS, _starts), _STARTS)
    full = ended.join(starts, on(known, starts)).select(*[known[c] for c in known.columns], "end", "last", "state")
    pieces = full.groupBy("conv_id", "part").applyInArrow(_per_group(_PIECE, lambda g: [_piece([r[:8] for r in g], g[0][8], g[0][10], g[0][9])]), _PIECE)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pair = F.concat(F.last("last_initial", ignorenulls=True).over(before), "first_initial")
    edges = pieces.select("*", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).cast("long").alias("pair"), F.coalesce(F.max("last_turn").over(before) == F.col("first_turn"), F.lit(False)).cast("long").alias("both"))
    listed = F.array_sort(F.collect_list(F.struct("part", "audit", "turns")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")]
    one = edges.groupBy("conv_id").agg(F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), (F.sum("distinct_turns") - F.sum("both")).alias("distinct_turns"), *sums, (F.sum("illegal") + F.sum("pair")).alias("illegal"), listed.alias("p"))
    return one.withColumns({"audit": F.array_join(F.transform("p", lambda x: x["audit"]), ""), "turns": F.flatten(F.transform("p", lambda x: x["turns"]))})


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns): every conversation with its faults, edits and repaired turns.

    ``turns`` has conv_id, turn, role and text, and may have ``there``: a row that is not there only names its conversation.
    """
    there = F.col("there") if "there" in turns.columns else F.lit(True)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), there.alias("there"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    parts = cut_lineage(sorted_.mapInArrow(_marked(), _ROW))
    # At most one conversation spans any edge between two parts, so these are no more than the parts.
    spans = F.broadcast(parts.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select(F.col("conv_id").alias("_conv")))
    split = F.col("conv_id").eqNullSafe(F.col("_conv"))
    pieces = parts.join(spans, split, "left_anti").mapInArrow(_whole(), _PIECE)
    names = ["conv_id", "first_turn", "last_turn", "distinct_turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]
    both = pieces.select(*names).unionByName(_spanning(parts.join(spans, split, "left_semi")).select(*names))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct_turns"), F.lit(0))
    return both.select("conv_id", gaps.alias("gaps"), *names[4:])


def damaged(turns: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of their conversation and turn: dropped, emptied, without sentence ends, repeated, or given to the user. Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (F.col("kind") != 0).alias("there"))


def repair_digests(found: DataFrame) -> DataFrame:
    """The rows of ``repaired`` with a digest in place of the turns."""
    line = lambda x: F.concat(x["role"], F.lit(":"), x["text"])
    return found.select(*[c for c in found.columns if c != "turns"], F.sha2(F.array_join(F.transform("turns", line), "\n"), 256).alias("repaired_sha256"))
