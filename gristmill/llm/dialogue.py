"""Conversation structure repair: the cheapest edits that make roles alternate, found backward and read forward.

Turns are sorted once over all conversations and cut into blocks. A block knows what it costs from each state of the
grammar to each other, so blocks are joined by a pass over small rows, and a conversation of any length is the work of
many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, kind, partitions

#: Turns in a block, at most.
BLOCK = 1 << 14
#: States: 0 at the start, 1 after a system turn, 2 after the user's, 3 after the assistant's. Turns may end in 0 and 3.
#: The state after a turn that is kept, by state and kind of its role (1 system, 2 user, 3 assistant).
KEPT = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}
#: The state after a turn that is inserted or gets another role: only one role fits.
FILLED = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
DELETE, RENAME, INSERT, BROKEN = 4, 3, 3, 3
SOUND, GONE, CUT = 0, 1, 2
FAR = 10**9
Costs = tuple[int, int, int, int]
#: What is inserted at the end of a conversation, by state.
TAILS = {0: "", 1: "II", 2: "I", 3: ""}


def _closed(costs: list[int]) -> list[int]:
    """Costs from each state, where turns may be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[FILLED[s]]) for s, c in enumerate(costs)]
    return costs


#: Costs from each state where no turns are left.
END: Costs = tuple(_closed([0, FAR, FAR, 0]))


def _ways(code: int, state: int, after: Costs) -> Iterator[tuple[str, int, int]]:
    """What can be done with a turn, in the order of its letters: letter, cost with all that follows, state."""
    role, fault = divmod(code, 3)
    yield "D", DELETE + after[state], state
    if fault != GONE:
        more = BROKEN * (fault == CUT)
        if (to := KEPT.get((state, role))) is not None:
            yield "K", more + after[to], to
        yield "R", RENAME + more + after[FILLED[state]], FILLED[state]


@lru_cache(1 << 16)
def _before(code: int, after: Costs) -> tuple[int, Costs]:
    """Costs before a turn from those after it, less their minimum, and the minimum."""
    costs = _closed([min(c for _, c, _ in _ways(code, s, after)) for s in range(4)])
    low = min(costs)
    return low, tuple(c - low if c < FAR // 2 else FAR for c in costs)


@lru_cache(1 << 16)
def _step(code: int, state: int, after: Costs) -> tuple[str, int]:
    """The ASCII-least letters among the cheapest for a turn, and the state after it."""
    low, before = _before(code, after)
    letters = ""
    while True:
        ways = {letter: (cost, to) for letter, cost, to in _ways(code, state, after)}
        cost = low + before[state]
        if "D" in ways and ways["D"][0] == cost:
            return letters + "D", state
        if INSERT + low + before[FILLED[state]] == cost:
            letters, state = letters + "I", FILLED[state]
            continue
        letter = next(x for x in "KR" if x in ways and ways[x][0] == cost)
        return letters + letter, ways[letter][1]


def backward(codes: bytes, end: Costs) -> tuple[int, Costs, list[Costs]]:
    """What a block costs: the common part, the rest by state at its start, and the costs after each turn."""
    total, now, after = 0, end, []
    for code in reversed(codes):
        after.append(now)
        low, now = _before(code, now)
        total += low
    return total, now, after[::-1]


def forward(codes: bytes, after: list[Costs], state: int) -> tuple[str, int]:
    """The letters of a block entered in a state, and the state at its end."""
    letters = []
    for code, costs in zip(codes, after):
        more, state = _step(code, state, costs)
        letters.append(more)
    return "".join(letters), state


def _codes(column: pa.Array) -> Iterator[bytes]:
    """Codes from letters."""
    return ((np.frombuffer(x.encode(), np.uint8) - 97).tobytes() for x in column.to_pylist())


def _normal(costs: list[int]) -> Costs:
    low = min(costs)
    return tuple(c - low if c < FAR // 2 else FAR for c in costs)


def _tables(batches) -> Iterator[pa.RecordBatch]:
    """costs: 16 for each block, from each state at its start (rows) to each at its end."""
    for b in batches:
        out = []
        for codes in _codes(b.column("codes")):
            columns = []
            for t in range(4):
                low, rest, _ = backward(codes, tuple(0 if s == t else FAR for s in range(4)))
                columns.append([low + c if c < FAR // 2 else FAR for c in rest])
            out.append([columns[t][s] for s in range(4) for t in range(4)])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], names=[*b.schema.names, "costs"])


def _ends(batches) -> Iterator[pa.RecordBatch]:
    """after (costs by state after each block, less their minimum), cost (of all from the block on, from the start state), last; blocks come from a conversation's last to its first."""
    now, costs = object(), END
    for b in batches:
        after, cost, last = [], [], []
        for conv, table in zip(b.column("conv").to_pylist(), b.column("costs").to_pylist()):
            last.append(conv != now)
            if conv != now:
                now, costs = conv, list(END)
            after.append(list(_normal(costs)))
            costs = [min(table[4 * s + t] + costs[t] for t in range(4)) for s in range(4)]
            cost.append(costs[0])
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("first"), b.column("codes"), pa.array(after, pa.list_(pa.int64())), pa.array(cost, pa.int64()), pa.array(last)], names=["conv", "first", "codes", "after", "cost", "last"])


def _walks(batches) -> Iterator[pa.RecordBatch]:
    """exits and audits of each block, by the state in which it is entered."""
    for b in batches:
        exits, audits = [], []
        for codes, end in zip(_codes(b.column("codes")), b.column("after").to_pylist()):
            after = backward(codes, tuple(end))[2]
            found = [forward(codes, after, s) for s in range(4)]
            audits.append([x for x, _ in found])
            exits.append([s for _, s in found])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(exits, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], names=[*b.schema.names, "exits", "audits"])


def _joined(batches) -> Iterator[pa.RecordBatch]:
    """state in which each block is entered, its audit (with what is inserted at the conversation's end), illegal (pairs of neighbours that don't fit); blocks come in order."""
    now, state, role = object(), 0, 0
    for b in batches:
        states, audits, illegal = [], [], []
        for conv, codes, exits, letters, last in zip(b.column("conv").to_pylist(), _codes(b.column("codes")), *(b.column(c).to_pylist() for c in ("exits", "audits", "last"))):
            kinds = np.frombuffer(codes, np.uint8).astype(int) // 3
            if conv != now:
                now, state, pairs = conv, 0, 4 * kinds[:-1] + kinds[1:]
            else:
                pairs = 4 * np.concatenate(([role], kinds[:-1])) + kinds
            illegal.append(int((~np.isin(pairs, [4 * 1 + 2, 4 * 2 + 3, 4 * 3 + 2])).sum()))
            role = int(kinds[-1])
            states.append(state)
            audit, state = letters[state], exits[state]
            audits.append(audit + TAILS[state] if last else audit)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "first", "codes", "cost")), pa.array(states, pa.int64()), pa.array(audits, pa.string()), pa.array(illegal, pa.int64())], names=["conv", "first", "codes", "cost", "state", "audit", "illegal"])


def _skeleton(batches) -> Iterator[pa.RecordBatch]:
    """conv, at, nth, own, role for each turn of the repaired conversation, in the order of (at, nth).

    own: it is the turn at place `at` of the input; its role is null if kept. The others are inserted before that place.
    """
    for b in batches:
        out = []
        for conv, place, codes, state, audit in zip(b.column("conv").to_pylist(), b.column("first").to_pylist(), _codes(b.column("codes")), *(b.column(x).to_pylist() for x in ("state", "audit"))):
            first, nth = place, 0
            for x in audit:
                if x == "K":
                    state = KEPT[state, codes[place - first] // 3]
                elif x != "D":
                    state = FILLED[state]
                if x != "D":
                    out.append((conv, place, nth, x != "I", None if x == "K" else ROLES[state]))
                place, nth = (place, nth + 1) if x == "I" else (place + 1, 0)
        for k in range(0, len(out), 20_000):
            conv, at, nth, own, role = zip(*out[k : k + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(conv, b.schema.field("conv").type), pa.array(at, pa.int64()), pa.array(nth, pa.int64()), pa.array(own), pa.array(role, pa.string())], names=["conv", "at", "nth", "own", "role"])


def _digests(batches, line: str) -> Iterator[pa.RecordBatch]:
    """conv and the SHA-256 of its lines, joined by line ends; lines come in order, and no more than a batch is held."""
    now, digest = object(), None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], kind_of), pa.array([digest.hexdigest()])], names=["conv", "sha256"])

    for b in batches:
        kind_of = b.schema.field("conv").type
        for conv, text in zip(b.column("conv").to_pylist(), b.column(line).to_pylist()):
            if conv != now:
                if digest:
                    yield done()
                now, digest = conv, hashlib.sha256(text.encode())
            else:
                digest.update(b"\n" + text.encode())
    if digest:
        yield done()


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text after damage by h = crc32("conv:turn") % 20: 0 drops a row, 1 empties its text, 2 takes its
    marks . ! ? away, 3 repeats it, 4 makes it the user's. A null counts as one space, in the hash and as role or text."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = (F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col)).cast("binary")) % 20).cast("int")
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.where("h <> 0").select("conv", "turn", F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _key(column: str):
    """A join key that nulls share."""
    return F.struct(F.col(column).alias("x"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cheapest repairs of conversations: a row per conversation (conv, blank, duplicate, truncated, illegal, cost, audit),
    and the repaired turns (conv, at, nth, role, text; in the order of at and nth).

    turns has conv, turn, role, text. Rows of a conversation are taken by turn (nulls first, of any type that can be
    ordered), then role, then text. Faults, the first of a row counts: blank (no character but ASCII white space),
    duplicate (role and text as in an earlier row), truncated (the last other character is none of . ! ?). Edits, named
    by their first letters: Keep costs nothing, Rename the role to user or assistant 3, Delete 4 (a must for blank and
    duplicate rows), Insert an empty turn of user or assistant 3; truncated rows that stay cost 3 more. The initials of the
    repaired roles read (s?(ua)+)?, and of the cheapest audits the ASCII-least is taken.

    Null conversations are one conversation; role and text must not be null. Repeated rows are duplicates. Conversations
    without rows, as in an empty table, have none here. Long texts are only ever one value of a row. A conversation may
    hold any share of the rows: only its blocks, a row for up to BLOCK turns, meet in one task.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    order = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    tail = F.right(F.rtrim("text", F.lit(" \t\n\v\f\r")), F.lit(1))
    rows = turns.select("conv", "turn", "role", "text", order.alias("place"), tail.alias("tail"), F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("uid"))
    rows = cut(rows, "dialogue-rows")
    seen = rows.where("tail <> ''").groupBy(_key("conv").alias("k"), F.col("role").alias("r"), F.col("sha").alias("s")).agg(F.min(F.struct("place", "uid")).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = rows.join(seen, (_key("conv") == F.col("k")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")), "left")
    fault = F.when(F.col("tail") == "", F.lit("blank")).when(F.struct("place", "uid") > F.col("earliest"), F.lit("duplicate")).when(~F.col("tail").isin(".", "!", "?"), F.lit("truncated"))
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    code = F.char(F.lit(97) + 3 * role + F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(SOUND))
    slim = met.withColumn("fault", fault).select("conv", "place", "role", "text", "fault", code.alias("code"), "uid")
    dealt = slim.repartitionByRange(partitions(turns), "conv", "place", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv", "place", "role", "text", "uid")
    placed = cut(dealt.select("conv", "role", "text", "fault", "code", F.monotonically_increasing_id().alias("at")), "dialogue-placed")
    conv_type = kind(placed, "conv")
    blocks = placed.groupBy("conv", F.shiftright("at", BLOCK.bit_length() - 1).alias("block")).agg(F.min("at").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes"))
    tables = cut(blocks.select("conv", "first", "codes").mapInArrow(_tables, f"conv {conv_type}, first long, codes string, costs array<long>"), "dialogue-blocks")
    n = partitions(turns)
    ends = tables.repartition(n, "conv").sortWithinPartitions("conv", F.desc("first")).mapInArrow(_ends, f"conv {conv_type}, first long, codes string, after array<long>, cost long, last boolean")
    walks = ends.repartition(n, "conv", "first").mapInArrow(_walks, f"conv {conv_type}, first long, codes string, after array<long>, cost long, last boolean, exits array<long>, audits array<string>")
    joined = walks.repartition(n, "conv").sortWithinPartitions("conv", "first").mapInArrow(_joined, f"conv {conv_type}, first long, codes string, cost long, state long, audit string, illegal long")
    joined = cut(joined, "dialogue-audits")
    audits = joined.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.max_by("cost", -F.col("first")).alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    faults = placed.groupBy("conv").agg(*(F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")))
    whole = faults.join(audits, faults["conv"].eqNullSafe(audits["conv"])).select(faults["conv"], "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    shape = cut(joined.mapInArrow(_skeleton, f"conv {conv_type}, at long, nth long, own boolean, role string"), "dialogue-turns")
    kept = shape.where("own").select("conv", "at", "nth", F.col("role").alias("new")).join(placed.select("at", "role", "text"), "at").select("conv", "at", "nth", F.coalesce("new", "role").alias("role"), "text")
    return whole, kept.unionByName(shape.where("not own").select("conv", "at", "nth", "role", F.lit("").alias("text")))


def line_digests(repaired: DataFrame) -> DataFrame:
    """conv, sha256 of its `role:text` lines in order, for conversations that have any."""
    bounded_batches(repaired.sparkSession)
    lines = repaired.select("conv", "at", "nth", F.concat_ws(":", "role", "text").alias("line"))
    in_order = lines.repartition(partitions(repaired), "conv").sortWithinPartitions("conv", "at", "nth")
    return in_order.mapInArrow(partial(_digests, line="line"), f"conv {kind(repaired, 'conv')}, sha256 string")


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conversation of the input, after damage (see damaged and repair).

    gaps: turns that lack between the least and the greatest after damage. Conversations of which no row is left have
    zeros, an empty audit and the digest of nothing. Columns other than the four named don't matter.
    """
    turns = damaged(conversations, conv_col, turn_col, role_col, text_col)
    whole, repaired = repair(turns)
    digests = line_digests(repaired).withColumnRenamed("conv", "c2")
    turn = F.col("turn")
    gaps = turns.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(turn), F.lit(0)).cast("long").alias("gaps")).withColumnRenamed("conv", "c1")
    every = conversations.select(F.col(conv_col).alias("conv_id")).distinct()
    same = lambda name: F.col("conv_id").eqNullSafe(F.col(name))
    out = every.join(gaps, same("c1"), "left").join(whole, same("conv"), "left").join(digests, same("c2"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
