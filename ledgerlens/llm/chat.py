"""Chat formatting: minimum-cost role repair.

A legal conversation is: an optional system turn, then user and assistant
turns in alternation that begin with the user and end with the assistant.  A
dynamic program over that automaton finds the cheapest repair of each
conversation.  Each turn keeps its role or is relabelled, and then follows
legally, is merged into the message before it, or follows an empty message that
is inserted.  Costs are in ``COSTS``; a turn whose role is unknown is relabelled.

A conversation may be of any length and none is gathered in one place.  Turns
are range-partitioned by conversation and turn and cut into segments of
``SEGMENT`` turns.  Over each stretch of a conversation in a segment the DP is
a 4 x 4 matrix of costs from state to state (min-plus); the matrices of a
conversation's stretches, one a segment, are chained to find the state at each
cut; then each segment is repaired between its two states.

Rows come out a turn: a merged turn is a further part of its message, so no
message is ever put together from an unbounded number of turns.  ``piece`` is
the turn's part of the rendered conversation: all pieces of a conversation, in
the order of (message, part), make its text.

Defined results: turns are in the order of ``turn`` (nulls last), then role and
text; of tied repairs the first in the order keep / merge / insert wins and of
roles system, user, assistant; a null text is an empty one; null conversation
ids are one conversation; repeated rows are repeated turns; an empty table
gives no rows; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, table

SEGMENT = 4096
ROLES = ("system", "user", "assistant")
SYSTEM, USER, ASSISTANT, UNKNOWN = range(4)
# Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
           "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
COSTS = {"relabel": 2, "merge": 1, "insert": 3}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

START = 3                 # states: the role of the last message, or the start
INF = 1 << 40
KEEP, MERGE, INSERT = "keep", "merge", "insert"


def legal(state: int, role: int) -> bool:
    return role == SYSTEM and state == START or role == USER and state != USER or role == ASSISTANT and state == USER


def step(state: int, role: int) -> tuple[int, str, int] | None:
    """Cheapest way to put a message of ``role`` after ``state``: cost, action
    and the role inserted before (-1: none)."""
    ways = []
    if legal(state, role):
        ways.append((0, KEEP, -1))
    if state == role:
        ways.append((COSTS["merge"], MERGE, -1))
    if role != SYSTEM:
        ways += [(COSTS["insert"], INSERT, x) for x in (USER, ASSISTANT) if legal(state, x) and legal(x, role)]
    return min(ways, key=lambda w: w[0], default=None)


STEPS = [[step(s, r) for r in range(3)] for s in range(4)]
# cost[given role][state][next state]
COST = np.array([[[(INF if r == START or STEPS[s][r] is None else
                    STEPS[s][r][0] + (0 if r == given else COSTS["relabel"]))
                   for r in range(4)] for s in range(4)] for given in range(4)], dtype=np.int64)
# cost of ending in a state: an empty assistant message, after an empty user message where that lacks too
END = np.array([2 * COSTS["insert"], COSTS["insert"], 0, 0], dtype=np.int64)


def stretch_cost(roles: np.ndarray) -> np.ndarray:
    """Min-plus product of the turns' matrices."""
    total = np.where(np.eye(4, dtype=bool), 0, INF)
    for given in roles:
        total = np.minimum((total[:, :, None] + COST[given][None]).min(axis=1), INF)
    return total


def repair(roles: np.ndarray, entry: int, exit_state: int) -> list[tuple[int, str, int]]:
    """The cheapest repair of a stretch between two states: role, action and
    inserted role of each turn."""
    n = len(roles)
    best = np.full((n + 1, 4), INF, dtype=np.int64)
    best[0, entry] = 0
    came = np.zeros((n, 4), dtype=np.int64)
    for i, given in enumerate(roles):
        ways = best[i][:, None] + COST[given]
        came[i] = ways.argmin(axis=0)
        best[i + 1] = ways.min(axis=0)
    out, state = [], exit_state
    for i in range(n - 1, -1, -1):
        before = int(came[i, state])
        out.append((state, STEPS[before][state][1], STEPS[before][state][2]))
        state = before
    return out[::-1]


def role_code(role: Column) -> Column:
    name = F.lower(F.trim(role))
    code = F.lit(UNKNOWN)
    for alias, r in ALIASES.items():
        code = F.when(name == alias, r).otherwise(code)
    return F.coalesce(code, F.lit(UNKNOWN)).cast("int")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        idx = np.arange(at, at + n, dtype=np.int64)
        at += n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(idx)],
                                         names=[*b.schema.names, "part", "idx"])


def placed_turns(conversations: DataFrame) -> DataFrame:
    """All turns in order, with ``part`` and ``idx``: partition and place in
    it.  Written once, so that both passes see the same cuts."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("given"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("code", role_code(F.col("given"))).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("given"), F.xxhash64("text"),
             F.col("row")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "conv_id long, turn long, given string, text string, code int, row long, part int, idx long"
    return materialize(ordered.mapInArrow(_placed, schema).drop("row"), "turns")


def _runs(conv: list) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    return list(zip(cuts[:-1], cuts[1:])) if conv else []


def _costs(rows: pa.Table) -> pa.Table:
    """One segment's stretches: conversation, cost matrix."""
    rows = rows.sort_by("idx")
    conv, code = rows["conv_id"].to_pylist(), rows["code"].to_numpy()
    runs = _runs(conv)
    part, seg = rows["part"][0].as_py(), rows["seg"][0].as_py()
    return pa.table({"conv_id": pa.array([conv[a] for a, _ in runs], pa.int64()),
                     "part": pa.array([part] * len(runs), pa.int32()), "seg": pa.array([seg] * len(runs), pa.int64()),
                     "cost": pa.array([stretch_cost(code[a:b]).ravel().tolist() for a, b in runs],
                                      pa.list_(pa.int64()))})


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches to their states: conversation by conversation, the
    cheapest way through its matrices."""
    held: list[tuple] = []

    def solve() -> pa.RecordBatch:
        best = np.full((len(held) + 1, 4), INF, dtype=np.int64)
        best[0, START] = 0
        came = []
        for i, (*_, cost) in enumerate(held):
            ways = best[i][:, None] + np.array(cost, dtype=np.int64).reshape(4, 4)
            came.append(ways.argmin(axis=0))
            best[i + 1] = ways.min(axis=0)
        state = int((best[-1] + END).argmin())
        cost = int((best[-1] + END).min())
        states = [state]
        for c in reversed(came):
            states.append(int(c[states[-1]]))
        states.reverse()
        n = len(held)
        return pa.RecordBatch.from_pydict({
            "conv_id": pa.array([h[0] for h in held], pa.int64()), "part": pa.array([h[1] for h in held], pa.int32()),
            "seg": pa.array([h[2] for h in held], pa.int64()), "entry": pa.array(states[:-1], pa.int32()),
            "exit": pa.array(states[1:], pa.int32()), "last": pa.array([i == n - 1 for i in range(n)]),
            "conv_cost": pa.array([cost] * n, pa.int64())})

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "seg", "cost"))):
            if held and held[0][0] != row[0]:
                yield solve()
                held = []
            held.append(row)
    if held:
        yield solve()


def _repaired(turns: pa.Table, states: pa.Table) -> pa.Table:
    """One segment's turns repaired between the states of its stretches:
    messages are numbered from 0 in each stretch."""
    turns = turns.sort_by("idx")
    conv, code, idx = turns["conv_id"].to_pylist(), turns["code"].to_numpy(), turns["idx"].to_pylist()
    known = {r["conv_id"]: r for r in states.to_pylist()}
    out: dict[str, list] = {k: [] for k in ("conv_id", "part", "seg", "idx", "local", "role", "action", "opens",
                                            "closes", "conv_cost")}

    def add(like: dict, place, local: int, role: int, action: str, opens: bool, closes: bool) -> None:
        for k, v in (("conv_id", like["conv_id"]), ("part", like["part"]), ("seg", like["seg"]), ("idx", place),
                     ("local", local), ("role", ROLES[role]), ("action", action), ("opens", opens),
                     ("closes", closes), ("conv_cost", like["conv_cost"])):
            out[k].append(v)

    for a, b in _runs(conv):
        s = known[conv[a]]
        local, state = -1, s["entry"]
        for i, (role, action, inserted) in enumerate(repair(code[a:b], s["entry"], s["exit"])):
            begun = state != START
            if inserted >= 0:
                local += 1
                add(s, None, local, inserted, INSERT, True, begun)
                begun = True
            if action != MERGE:
                local += 1
            relabelled = role != code[a + i]
            name = ("relabel" if relabelled else KEEP) if action != MERGE else "relabel+merge" if relabelled else MERGE
            add(s, idx[a + i], local, role, name, action != MERGE, begun and action != MERGE)
            state = role
        if s["last"]:
            while state in (SYSTEM, USER):
                state = USER if state == SYSTEM else ASSISTANT
                local += 1
                add(s, None, local, state, INSERT, True, True)
            add(s, None, local, state, "end", False, True)
    return pa.table({"conv_id": pa.array(out["conv_id"], pa.int64()), "part": pa.array(out["part"], pa.int32()),
                     "seg": pa.array(out["seg"], pa.int64()), "idx": pa.array(out["idx"], pa.int64()),
                     "local": pa.array(out["local"], pa.int64()), "role": pa.array(out["role"], pa.string()),
                     "action": pa.array(out["action"], pa.string()), "opens": pa.array(out["opens"], pa.bool_()),
                     "closes": pa.array(out["closes"], pa.bool_()),
                     "line": pa.array(range(len(out["idx"])), pa.int64()),
                     "conv_cost": pa.array(out["conv_cost"], pa.int64())})


def format_chat(conversations: DataFrame) -> DataFrame:
    """``(conv_id, message, part, role, action, turn, text, piece,
    conv_cost)``: a row for each turn, each inserted message, and the end of
    each conversation (action ``end``, with the closing mark)."""
    turns = placed_turns(conversations)
    narrow = turns.select("conv_id", "code", "part", "idx", F.floor(F.col("idx") / SEGMENT).alias("seg"))
    stretches = narrow.groupBy("part", "seg").applyInArrow(
        _costs, "conv_id long, part int, seg long, cost array<long>")
    ordered = stretches.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    states = materialize(ordered.select("conv_id", "part", "seg", "cost").mapInArrow(
        _chain, "conv_id long, part int, seg long, entry int, exit int, last boolean, conv_cost long"), "states")
    lines = materialize(narrow.groupBy("part", "seg").cogroup(states.groupBy("part", "seg")).applyInArrow(
        _repaired, "conv_id long, part int, seg long, idx long, local long, role string, action string, opens boolean,"
                   " closes boolean, line long, conv_cost long"), "repaired")

    # messages before a stretch: one row a stretch, of a conversation's stretches
    stretch = lines.groupBy("conv_id", "part", "seg").agg((F.max("local") + 1).alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part", "seg")) - F.col("n")
    at = F.struct(F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("n"), "part", "seg")
    first = stretch.select(at.alias("at"), before.alias("first"))
    numbered = lines.withColumn("at", at).join(first, "at")
    texts = turns.select(F.struct("part", "idx").alias("place"), "turn", "text")
    numbered = numbered.withColumn("place", F.struct("part", "idx"))
    with_text = numbered.filter("idx is not null").join(texts, "place")
    empty = numbered.filter("idx is null").withColumn("turn", F.lit(None).cast("long")).withColumn("text", F.lit(""))
    rows = with_text.unionByName(empty)
    closing = F.when(F.col("closes"), F.lit(CLOSE + "\n")).otherwise(F.lit(""))
    opening = F.when(F.col("opens"), F.concat(F.lit(OPEN), "role", F.lit("\n")))
    joint = F.when(F.col("action").endswith(MERGE), F.lit("\n")).otherwise(F.lit(""))
    return rows.select(
        "conv_id", (F.col("first") + F.col("local")).alias("message"),
        (F.col("part") * F.lit(1 << 33) + F.col("seg") * (4 * SEGMENT) + F.col("line")).alias("part"),
        "role", "action", "turn", "text", F.concat(closing, F.coalesce(opening, joint), "text").alias("piece"),
        "conv_cost")


def op6_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(table(spark, sf_dir, "conversations"))
