"""Chat formatting by minimum-cost role repair.

A dialogue is legal if it is an optional system message, then user and assistant in turn, ending with the assistant. A
dynamic program over that automaton chooses for each turn the cheapest of: keep it, give it another role, join it to the
message before, or put empty messages before it; at the end an empty message may follow. The repaired sequence is
rendered with chat tags.

Turns are put in order by a range partitioning, so a dialogue may span many tasks: a step of the automaton is a matrix
of costs, matrices of neighbouring turns combine, and each task only needs the costs before and after it of the one
dialogue cut at each of its ends. Those are two small matrices per task. No task or driver sees a whole long dialogue.

Result: one row per turn, in order within (conv_id, turn): ``action`` (keep, relabel, merge, merge_relabel), the ``role``
given, ``inserted`` (roles of the empty messages put before it), ``cost``, and ``rendered``, the piece of the rendered
dialogue that begins with this turn; the pieces of a dialogue in order are its rendering.

Roles are trimmed and lower-cased, common synonyms are known (``SYNONYMS``); an unknown or null role costs less to
relabel. Null texts are rendered as empty. A null conv_id is a dialogue of its own; null turns come first; ties and
repeated turns are ordered by a hash of the row, and each is a turn of its own. An empty table gives no rows. Other columns
are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm.common import ready

ROLES = ("system", "user", "assistant")
SYNONYMS = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Costs: another role for a known or unknown one, joining to the message before, an empty message.
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 3, 1, 1, 2
TAGS = ("<|im_start|>{role}\n", "<|im_end|>\n")

# states: before the first message, or the role of the last message
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 40
# empty messages that lead from a state to one where a role may follow; others are illegal
_BEFORE = {
    (START, SYSTEM): (), (START, USER): (), (SYSTEM, USER): (), (USER, ASSISTANT): (), (ASSISTANT, USER): (),
    (START, ASSISTANT): (USER,), (SYSTEM, ASSISTANT): (USER,), (USER, USER): (ASSISTANT,), (ASSISTANT, ASSISTANT): (USER,),
}


def _choices(given: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(from state, to state, cost, action, inserted) for a turn of a role (0: unknown), best first among equal costs."""
    relabel = RELABEL if given else RELABEL_UNKNOWN
    out = []
    for (a, b), empty in _BEFORE.items():
        out.append((a, b, len(empty) * INSERT + (0 if b == given else relabel), "keep" if b == given else "relabel", empty))
    for a in (SYSTEM, USER, ASSISTANT):
        out.append((a, a, MERGE + (0 if a == given else relabel), "merge" if a == given else "merge_relabel", ()))
    order = ("keep", "merge", "relabel", "merge_relabel")
    return sorted(out, key=lambda x: (x[2], order.index(x[3]), x[0], x[1]))


_BY_ROLE = [_choices(g) for g in range(4)]
# cheapest choice for each pair of states
_BEST = [{(a, b): x for x in reversed(cs) for a, b in [x[:2]]} for cs in _BY_ROLE]
_STEP = np.full((4, 4, 4), _FAR)
for _g in range(4):
    for (_a, _b), _x in _BEST[_g].items():
        _STEP[_g, _a, _b] = _x[2]
_END = np.array([0, 2 * INSERT, INSERT, 0])
_CLOSING = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}


def role_code(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = SYNONYMS.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of two stretches one after the other."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def _stretch(codes: list[int]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for g in codes:
        out = _then(out, _STEP[g])
    return out


def _path(codes: list[int], entry: int, after: np.ndarray) -> list[tuple]:
    """The cheapest choices from an entry state, given the cost of all that follows by exit state."""
    costs = [after]
    for g in reversed(codes):
        costs.append((_STEP[g] + costs[-1][None, :]).min(axis=1))
    costs.reverse()
    state, out = entry, []
    for i, g in enumerate(codes):
        to = int(np.argmin(_STEP[g, state] + costs[i + 1]))
        out.append(_BEST[g][state, to])
        state = to
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Dialogues of a sorted partition as (key, its turns)."""
    key, rows, begun = None, [], False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or row[0] != key:
                if begun:
                    yield key, rows
                key, rows, begun = row[0], [], True
            rows.append(row)
    if begun:
        yield key, rows


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[int]]]:
    return ((k, [role_code(r[2]) for r in rows]) for k, rows in _runs(batches))


def _joined(fragments: list) -> dict[int, dict[str, tuple]]:
    """By task: entry state and cost after it, for the dialogue cut at its first and its last end."""
    chains, out = [], {}
    for row in sorted(fragments, key=lambda r: (r["part"], r["place"])):
        cut = chains and chains[-1][-1]["part"] < row["part"] and chains[-1][-1]["key"] == row["key"] and chains[-1][-1]["ends"]
        if cut and row["place"] == 0:
            chains[-1].append(row)
        else:
            chains.append([row])
    for chain in chains:
        costs = [np.array(r["costs"]).reshape(4, 4) for r in chain]
        after = [_END]
        for c in reversed(costs):
            after.append((c + after[-1][None, :]).min(axis=1))
        after.reverse()
        state = START
        for i, r in enumerate(chain):
            closes = i == len(chain) - 1
            leave = int(np.argmin(costs[i][state] + after[i + 1]))
            # among equal ways, all tasks must agree on the state they meet in
            follows = after[i + 1].tolist() if closes else [0 if s == leave else _FAR for s in range(4)]
            out.setdefault(r["part"], {})[r["place"]] = (state, follows, closes)
            state = leave
    return out


def repair(turns: DataFrame) -> DataFrame:
    spark = ready(turns.sparkSession)
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    tie = F.xxhash64("conv_id", "turn", "role", "text")
    # checkpoint() keeps the partitions for the two steps below, and survives lost executors
    ordered = turns.select("conv_id", "turn", "role", "text").repartitionByRange("conv_id", "turn", tie).sortWithinPartitions("conv_id", "turn", tie, "role", "text").checkpoint()

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        part = TaskContext.get().partitionId()
        for key, codes in _codes(batches):
            if first is None:
                first = (key, _stretch(codes))
            else:
                last = (key, codes)
        if first is None:
            return
        ends = [(0, *first, last is None)] + ([(1, last[0], _stretch(last[1]), True)] if last is not None else [])
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(ends), pa.int32()), pa.array([e[0] for e in ends], pa.int32()), pa.array([repr(e[1]) for e in ends]), pa.array([e[2].ravel().tolist() for e in ends], pa.list_(pa.int64())), pa.array([e[3] for e in ends])],
            ["part", "place", "key", "costs", "ends"],
        )

    # two rows per task
    cuts = _joined(ordered.mapInArrow(fragments, "part int, place int, key string, costs array<bigint>, ends boolean").collect())
    known = spark.sparkContext.broadcast(cuts)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = known.value.get(TaskContext.get().partitionId(), {})
        begin, end = TAGS
        out: list[tuple] = []
        previous, place = None, 0
        for key, rows in _runs(batches):
            # the last dialogue of a task is known only when the next begins, so ends are looked up one behind
            if previous is not None:
                out += _rendered(*previous, mine.get(0) if place == 0 else None, begin, end)
                place += 1
            previous = (key, rows)
            if len(out) >= 4000:
                yield _batch(out)
                out = []
        if previous is not None:
            out += _rendered(*previous, mine.get(0) if place == 0 else mine.get(1), begin, end)
        if out:
            yield _batch(out)

    types = {c: pa.string() if k == "string" else {"int": pa.int32()}.get(k, pa.int64()) for c, k in kinds.items()}

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kind = [types["conv_id"], types["turn"], pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind, strict=True)], ["conv_id", "turn", "given", "action", "role", "inserted", "cost", "rendered"])

    return ordered.mapInArrow(render, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, given string, action string, role string, inserted array<string>, cost int, rendered string")


def _rendered(key, rows: list[tuple], bounds: tuple | None, begin: str, end: str) -> list[tuple]:
    """The rows of one dialogue, or of the stretch of it that this task holds."""
    entry, after, closes = bounds or (START, _END.tolist(), True)
    path = _path([role_code(r[2]) for r in rows], entry, np.array(after))
    out, head = [], "".join
    for i, (row, (a, b, cost, action, inserted)) in enumerate(zip(rows, path, strict=True)):
        merged = action.startswith("merge")
        # a message is closed by what follows it, so that a joined turn can go on with it
        piece = "\n\n" if merged else head([end] * (a != START)) + head(begin.format(role=ROLES[r - 1]) + end for r in inserted) + begin.format(role=ROLES[b - 1])
        piece += row[3] or ""
        if closes and i == len(rows) - 1:
            empty = _CLOSING.get(b, ())
            piece += end + head(begin.format(role=ROLES[r - 1]) + end for r in empty)
            cost += len(empty) * INSERT
        out.append((key, row[1], row[2], action, ROLES[b - 1], [ROLES[r - 1] for r in inserted], int(cost), piece))
    return out
