"""Repair of conversations by the cheapest edits, found by min-plus products over runs of equal symbols.

A repaired conversation has the roles ``(system? (user assistant)+)?``, told by their initials s, u and a. Its rows are
taken by turn, nulls first. A row is blank (nothing but white space), else a duplicate (role and text
seen earlier in its conversation), else truncated (its last character other than white space is none of . ! ?), else sound.
Keeping a row costs nothing, giving it the role user or assistant 3, deleting it 4 (the only way with blanks and
duplicates), inserting an empty row of user or assistant 3, and a truncated row that stays 3 more.

Every row is a symbol, its initial and its fault. A symbol is a 4 x 4 matrix of costs between the states *nothing yet*,
*after s*, *after u* and *after a*; a run of equal symbols is a power of it, put together from cached squares. Going back over
the runs gives what every state still costs; going forward, the choices of each run are unrolled: of all cheapest edits
those whose initials D, I, K, R come first in ASCII.

Rows are dealt to sorted ranges of even size, so a conversation of any length lies in many of them. One that lies within a
range is repaired there. Those at the ends of a range, and those longer than ``SEGMENT`` rows, are cut into segments: each
gives its matrix, these are folded to the cost behind every segment, each segment is unrolled from all four states, and a
second fold picks the one that it is entered with.

A null role or text counts as one space, a null turn comes first, rows without a conv_id are one conversation. Rows of one turn
go by role, the first 64 characters of the text and a digest of all of it; equal rows are alike. Columns other than conv_id, turn,
role and text are left out. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from manyfold.llm.common import lookup
from manyfold.sources.settled import settle

#: Rows of a conversation that a task keeps at once.
SEGMENT = 1 << 16
BATCH = 1 << 12
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 3  # of the classes s, u, a, other
SOUND, CUT, DROPPED = range(3)
FAULTS = ["", "truncated", "blank", "duplicate"]
FAR = 1 << 50
#: The state after an inserted or relabelled row, and the row's initial.
NEXT = {NOTHING: (USER, "u"), SYSTEM: (USER, "u"), USER: (ASSISTANT, "a"), ASSISTANT: (USER, "u")}
ROLES = {"u": "user", "a": "assistant"}
SPACE = "\x20\t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]

#: What it costs to end in a state: the inserts that are still needed.
ENDS: Vector = (0, 2 * INSERT, INSERT, 0)
TAILS = ("", "IuIa", "Ia", "")


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits that take a row of the symbol, with their cost and the state after; in the order of their initials."""
    role, kind = divmod(symbol, 3)
    found = [("D.", DELETE, state)]
    if kind == DROPPED:
        return found
    more = TRUNCATED if kind == CUT else 0
    if role == 0 and state == NOTHING:
        found.append(("K.", more, SYSTEM))
    elif role == 1 and state != USER:
        found.append(("K.", more, USER))
    elif role == 2 and state == USER:
        found.append(("K.", more, ASSISTANT))
    after, initial = NEXT[state]
    return [*found, ("R" + initial, RELABEL + more, after)]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def applied(a: Matrix, costs: Vector) -> Vector:
    return tuple(min(a[i][k] + costs[k] for k in range(4)) for i in range(4))


@lru_cache(maxsize=None)
def square(symbol: int, power: int) -> Matrix:
    """The matrix of 2**power rows of a symbol, with inserts before each."""
    if power:
        half = square(symbol, power - 1)
        return product(half, half)
    inserts = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        at, cost = state, 0
        for _ in range(3):
            inserts[state][at] = min(inserts[state][at], cost)
            at, cost = NEXT[at][0], cost + INSERT
    taken = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in choices(symbol, state):
            taken[state][after] = min(taken[state][after], cost)
    return product(tuple(map(tuple, inserts)), tuple(map(tuple, taken)))


@lru_cache(maxsize=1 << 16)
def back(symbol: int, length: int, costs: Vector) -> Vector:
    """What every state costs before a run, from the costs behind it."""
    for power in range(length.bit_length()):
        if length >> power & 1:
            costs = applied(square(symbol, power), costs)
    return costs


def run_matrix(symbol: int, length: int) -> Matrix:
    found = None
    for power in range(length.bit_length()):
        if length >> power & 1:
            found = square(symbol, power) if found is None else product(found, square(symbol, power))
    return found


def unroll(symbol: int, length: int, state: int, costs: Vector) -> tuple[list[str], int]:
    """The edits of every row of a run that is entered in a state, and the state after it."""
    ahead = [costs]
    for _ in range(length):
        ahead.append(applied(square(symbol, 0), ahead[-1]))
    edits = []
    for left in range(length, 0, -1):
        now, then, edit = ahead[left], ahead[left - 1], ""
        taken = False
        while not taken:
            options = choices(symbol, state)
            after, initial = NEXT[state]
            options.insert(1, ("I" + initial, INSERT, after))
            for name, cost, at in options:
                if cost + (now if name[0] == "I" else then)[at] == now[state]:
                    edit, state, taken = edit + name, at, name[0] != "I"
                    break
        edits.append(edit)
    return edits, state


@lru_cache(maxsize=1 << 16)
def unroll_short(symbol: int, length: int, state: int, costs: Vector) -> tuple[list[str], int]:
    return unroll(symbol, length, state, costs)


def runs_of(symbols: np.ndarray) -> list[tuple[int, int]]:
    first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    return list(zip(symbols[first].tolist(), np.diff(np.append(first, len(symbols))).tolist()))


def least_zero(costs: Vector) -> Vector:
    low = min(costs)
    return tuple(c - low for c in costs)


def repair_symbols(symbols: np.ndarray, state: int = NOTHING, costs: Vector = ENDS, ends: bool = True) -> tuple[list[str], int]:
    """The edits of every row, inserts before it included, two characters an edit: its initial and the new role's."""
    runs, behind = runs_of(symbols), [costs]
    for symbol, length in reversed(runs):
        behind.append(least_zero(back(symbol, length, behind[-1])))
    edits: list[str] = []
    for (symbol, length), costs_ in zip(runs, reversed(behind[:-1])):
        some, state = (unroll_short if length < 64 else unroll)(symbol, length, state, costs_)
        edits += some
    if ends:
        edits[-1] += TAILS[state]
    return edits, state


def matrix_of(symbols: np.ndarray) -> Matrix:
    found = None
    for symbol, length in runs_of(symbols):
        one = run_matrix(symbol, length)
        found = one if found is None else product(found, one)
    return found


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in: by the checksum of ``conv_id:turn`` some are dropped, emptied, cut, repeated or relabelled."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def with_faults(conversations: DataFrame) -> DataFrame:
    """key, id, symbol and fault of every row; ids tell repeated rows apart."""
    word = lambda c: F.coalesce(F.col(c), F.lit(" "))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), key.alias("key"))
    mark = F.md5(F.concat_ws(":", "key", F.octet_length("role").cast("string"), "role", "text").cast("binary"))
    rows = settle(rows.withColumn("mark", mark).withColumn("id", F.monotonically_increasing_id()), "conversations")
    first = F.min(F.struct("turn", "id")).alias("first")
    firsts = rows.groupBy("mark").agg(first, F.count(F.lit(1)).alias("n")).select("mark", F.col("first.id").alias("first_id"), "n")
    rows = lookup(rows, settle(firsts, "first-rows"), ["mark"], ["first_id"], "n", "id")
    bare = F.trim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(bare == "", 2).when(F.col("id") != F.col("first_id"), 3).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    )
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    symbol = role * 3 + F.least("fault", F.lit(DROPPED))
    return rows.withColumn("fault", fault).withColumn("symbol", symbol.cast("int")).drop("first_id")


ROW = "conv_id long, turn long, role string, text string, key string, id long, fault int, symbol int"
PLACED = ROW + ", part int, at long, edits string, before int"


def range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range: place of every row, and edits where the whole conversation is in it."""
    part = TaskContext.get().partitionId()
    ready: list[pa.RecordBatch] = []
    held: list[pa.RecordBatch] = []
    key, at, first, many = None, 0, True, False

    def placed(slices: list[pa.RecordBatch], start: int, whole: bool) -> None:
        total = sum(s.num_rows for s in slices)
        symbols = np.concatenate([s.column(7).to_numpy() for s in slices])
        edits = repair_symbols(symbols)[0] if whole else [None] * total
        before = np.append(-1, symbols[:-1] // 3).astype(np.int32)
        done = 0
        for s in slices:
            own = slice(done, done + s.num_rows)
            places = pa.array(np.arange(start + done, start + own.stop), pa.int64())
            added = [pa.array(np.full(s.num_rows, part, np.int32)), places, pa.array(edits[own], pa.string()), pa.array(before[own], mask=np.full(s.num_rows, not whole))]
            ready.append(pa.RecordBatch.from_arrays([*s.columns, *added], names))
            done += s.num_rows

    def out(least: int) -> Iterator[pa.RecordBatch]:
        if ready and sum(r.num_rows for r in ready) >= least:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
            ready.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        names = [*batch.schema.names, "part", "at", "edits", "before"]
        keys = batch.column(4).to_pylist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if keys[a] != key:
                if held:
                    placed(held, at, not (first or many))
                if key is not None:
                    first = False
                held, at, many, key = [], 0, False, keys[a]
            held.append(batch.slice(a, b - a))
            if sum(s.num_rows for s in held) >= SEGMENT:
                placed(held, at, False)
                at, held, many = at + sum(s.num_rows for s in held), [], True
            yield from out(BATCH)
    if held:
        placed(held, at, False)
    yield from out(1)


def segment_costs(rows: pd.DataFrame) -> pd.DataFrame:
    """The matrix of a segment and the class of its last role."""
    symbols = rows.sort_values("at")["symbol"].to_numpy()
    flat = [c for line in matrix_of(symbols) for c in line]
    return pd.DataFrame({"key": [rows["key"].iat[0]], "part": [rows["part"].iat[0]], "block": [rows["block"].iat[0]], "matrix": [flat], "role": [symbols[-1] // 3]})


def fold_back(segments: pd.DataFrame) -> pd.DataFrame:
    """The costs behind every segment of a conversation, whether it is the last, and the role before it."""
    segments = segments.sort_values(["part", "block"])
    costs, behind = ENDS, []
    for flat in reversed(segments["matrix"].tolist()):
        behind.append(list(costs))
        flat = [int(c) for c in flat]
        costs = least_zero(applied(tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4)), costs))
    before = [-1, *segments["role"].tolist()[:-1]]
    last = [False] * (len(segments) - 1) + [True]
    return segments[["key", "part", "block"]].assign(costs=behind[::-1], last=last, before=before)


def segment_edits(rows: pd.DataFrame) -> pd.DataFrame:
    """The edits of every row for each state that the segment can be entered in, and on the first row the states after."""
    rows = rows.sort_values("at")
    symbols = rows["symbol"].to_numpy()
    costs, last = tuple(int(c) for c in rows["costs"].iat[0]), bool(rows["last"].iat[0])
    found = [repair_symbols(symbols, state, costs, last) for state in range(4)]
    exits = [[after for _, after in found]] + [None] * (len(rows) - 1)
    before = np.append(rows["before"].iat[0], symbols[:-1] // 3)
    return rows[["key", "part", "block", "at"]].assign(variants=list(map(list, zip(*(e for e, _ in found)))), exits=exits, before=before)


def fold_on(segments: pd.DataFrame) -> pd.DataFrame:
    """The state in which every segment of a conversation is entered."""
    segments = segments.sort_values(["part", "block"])
    state, entered = NOTHING, []
    for exits in segments["exits"]:
        entered.append(state)
        state = int(exits[state])
    return segments[["key", "part", "block"]].assign(entered=entered)


def repair(conversations: DataFrame) -> DataFrame:
    """Every row of the table with its place (part, at), fault, edits and whether its role may not follow the one before.

    ``edits`` has two characters an edit, inserts before the row first and, at a conversation's last row, those after it.
    """
    rows = with_faults(conversations)
    # The same order deals and sorts; the digest stands for the rest of a text, so no long text is a bound of a range.
    order = ["key", "turn", "role", F.substring("text", 1, 64), "mark", "id"]
    columns = [c.split()[0] for c in ROW.split(", ")]
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns).mapInArrow(range_rows, PLACED), "placed")

    open_ = placed.filter(F.col("edits").isNull())
    thin = open_.select("key", "part", "at", "symbol", F.floor(F.col("at") / SEGMENT).alias("block"))
    names = ["key", "part", "block"]
    same = "key string, part int, block long"
    matrices = thin.groupBy(*names).applyInPandas(segment_costs, same + ", matrix array<long>, role int")
    behind = matrices.groupBy("key").applyInPandas(fold_back, same + ", costs array<long>, last boolean, before int")
    known = thin.join(settle(behind, "segments"), names)
    variants = known.groupBy(*names).applyInPandas(segment_edits, same + ", at long, variants array<string>, exits array<int>, before int")
    variants = settle(variants, "variants")
    entered = variants.filter(F.col("exits").isNotNull()).select(*names, "exits").groupBy("key").applyInPandas(fold_on, same + ", entered int")
    chosen = variants.join(entered, names).select("key", "part", "at", F.get("variants", "entered").alias("chosen"), F.col("before").alias("role_before"))
    late = open_.join(chosen, ["key", "part", "at"]).withColumn("edits", F.col("chosen")).withColumn("before", F.col("role_before"))
    whole = placed.filter(F.col("edits").isNotNull()).unionByName(late.select(*placed.columns))
    return whole.withColumn("illegal", illegal()).withColumn("fault", F.element_at(F.array(*map(F.lit, FAULTS)), F.col("fault") + 1)).drop("before", "symbol", "id")


def illegal() -> Column:
    """Two adjacent initials other than su, ua and au."""
    before, role = F.col("before"), F.floor(F.col("symbol") / 3)
    follows = ((before == 0) & (role == 1)) | ((before == 1) & (role == 2)) | ((before == 2) & (role == 1))
    return (before >= 0) & ~follows


SUMMARY = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summary_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of a stream sorted by key and place; of a conversation only numbers and initials are kept."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    done: list[list] = []
    now = None

    def close() -> None:
        turns = now["turns"]
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        counts = [now[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
        done.append([now["key"], gaps, *counts, "".join(now["audit"]), now["sha"].hexdigest()])

    for batch in batches:
        for key, turn, role, text, fault, edits, wrong in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or key != now["key"]:
                if now:
                    close()
                now = {"key": key, "turns": None, "audit": [], "sha": hashlib.sha256(), "any": False}
                now |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            if turn is not None:
                low, high, n = now["turns"] or (turn, None, 0)
                now["turns"] = (low, turn, n + (turn != high))
            now["illegal"] += wrong
            if fault:
                now[fault] += 1
            stays = TRUNCATED if fault == "truncated" else 0
            for at in range(0, len(edits), 2):
                edit, initial = edits[at], edits[at + 1]
                now["cost"] += {"D": DELETE, "I": INSERT, "K": stays, "R": RELABEL + stays}[edit]
                if edit != "D":
                    line = f"{ROLES.get(initial, role)}:{'' if edit == 'I' else text}"
                    now["sha"].update((("\n" if now["any"] else "") + line).encode())
                    now["any"] = True
            now["audit"].append(edits[::2])
        if len(done) >= BATCH:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done))), names)
            done = []
    if now:
        close()
    if done:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done))), names)


def summaries(repaired: DataFrame) -> DataFrame:
    """Gaps in the turns, counts, cost, audit and a digest of the repaired rows, for every conversation that has rows.

    The digest is one chain over a conversation, so its rows pass through one task, in order and a batch at a time.
    """
    rows = repaired.repartition("key").sortWithinPartitions("key", "part", "at")
    return rows.select("key", "turn", "role", "text", "fault", "edits", "illegal").mapInArrow(summary_rows, SUMMARY)
