"""The trie of conversations that share their first turns, by collapse of whole sequences.

Conversations with the same turns become one sequence with a weight and the list of those that end there. A sequence that
is a proper prefix of another is told by an anti-join of ends with the nodes that go on; the others are leaves. Every
sequence is spread to its prefixes once, and these are aggregated by weight to nodes.

A prefix is named by its depth and two polynomial hashes over the prime 2**61 - 1 of its turns' hashes. Such hashes of parts
can be put together, so a conversation of any length may lie in many sorted ranges, and one that begins with turns of another
needs only that one's hash. What a subtree saves is summed without walking it: every node belongs to the leaf with the
least conv_id below it, a leaf sums what its own nodes save from every depth on (over blocks of depths, then over the
blocks), and a node adds up what the leaves that pass through it have from its depth on.

A null role or text is empty, a null turn comes first, rows of one turn go by role, the first 64 characters of the text and a
digest of role and text. Repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are left out, as are
other columns. An empty table has no conversations and gives no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from manyfold.llm.common import lookup
from manyfold.sources.settled import settle

#: The largest number of turns taken from another conversation.
HEAD = 8
PRIME = (1 << 61) - 1
BASES = (1_313_131_313_131_313_131, 987_654_321_987_654_321)
#: Depths whose savings are summed together, and conversations in a part of a list of ends.
BLOCK = 1 << 12
LISTED = 1 << 14
BATCH = 1 << 12

U = np.uint64
LOW31, LOW30 = U((1 << 31) - 1), U((1 << 30) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, by halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> U(31), a & LOW31, b >> U(31), b & LOW31
    mid = a1 * b0 + a0 * b1
    return reduced(a1 * b1 * U(2) + (mid >> U(30)) + ((mid & LOW30) << U(31)) + a0 * b0)


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """Powers of a base; negative exponents are those of its inverse."""
    left = (exponents % (PRIME - 1)).astype(np.uint64)
    found, square = np.ones(len(left), np.uint64), base
    while left.any():
        odd = (left & U(1)).astype(bool)
        found[odd] = times(found[odd], U(square))
        left, square = left >> U(1), square * square % PRIME
    return found


def running(terms: np.ndarray) -> np.ndarray:
    """Cumulative sums modulo the prime."""
    low, high = np.cumsum(terms & LOW31), np.cumsum(terms >> U(31))
    return reduced(reduced(low) + times(reduced(high), U(1 << 31)))


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduced(a + U(PRIME) - b)


def turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range: the place of every turn, and the hash of its conversation before and after it, within the range."""
    part = TaskContext.get().partitionId()
    last_id, at, sums = None, 0, [0, 0]
    for batch in batches:
        ids = batch.column(0).to_numpy()
        n = len(ids)
        if not n:
            continue
        new = np.append(last_id is None or ids[0] != last_id, ids[1:] != ids[:-1])
        run = np.cumsum(new)  # 0 for what goes on from the batch before
        starts = np.append(0, np.flatnonzero(new))
        place = np.arange(n) - starts[run] + np.where(run == 0, at, 0)
        out = [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(place, pa.int64()), batch.column(1)]
        for k, base in enumerate(BASES):
            x = batch.column(2 + k).to_numpy().astype(np.uint64)
            terms = times(x, power(base, place))
            total = running(terms)
            before = minus(total, terms)
            carried = np.where(run == 0, U(sums[k]), U(0))
            offset = before[starts[run]] * (run > 0).astype(np.uint64)
            own = reduced(minus(total, offset) + carried)
            out += [pa.array(minus(own, terms).view(np.int64)), pa.array(own.view(np.int64))]
            sums[k] = int(own[-1])
        last_id, at = ids[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(out, ["conv_id", "part", "at", "bytes", "a_before", "a", "b_before", "b"])


TURNS = "conv_id long, part int, at long, bytes long, a_before long, a long, b_before long, b long"


def fold_parts(rows: pd.DataFrame) -> pd.DataFrame:
    """Turns and hash of a conversation before each of its ranges."""
    rows = rows.sort_values("part")
    start, sums, out = 0, [0, 0], []
    for row in rows.itertuples():
        out.append((row.conv_id, row.part, start, *sums))
        for k, own in enumerate((row.a, row.b)):
            sums[k] = (sums[k] + pow(BASES[k], start, PRIME) * int(own)) % PRIME
        start += row.n
    return pd.DataFrame(out, columns=["conv_id", "part", "start", "a_start", "b_start"])


def joined_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes h become plus + base**exponent * (h - minus); every column pair before and after a turn."""
    for rows in batches:
        for k, name in enumerate(("a", "b")):
            factor = power(BASES[k], rows["exponent"].to_numpy())
            plus, less = (rows[f"{name}_{c}"].to_numpy().astype(np.uint64) for c in ("plus", "minus"))
            for column in (f"{name}_before", name):
                own = rows[column].to_numpy().astype(np.uint64)
                rows[column] = reduced(plus + times(factor, minus(own, less))).astype(np.int64)
        yield rows


def shifted(rows: DataFrame) -> DataFrame:
    """The rows with their hashes joined to what comes before, as exponent, a_plus, a_minus, b_plus and b_minus say."""
    return rows.mapInPandas(joined_hashes, rows.schema).drop("exponent", "a_plus", "a_minus", "b_plus", "b_minus")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at, bytes and hashes before and after, of every turn of every conversation."""
    word = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", word("role").alias("role"), word("text").alias("text"))
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    low = F.lit((1 << 60) - 1)
    # Role and text have hashes of their own length, so what stands at their border matters.
    x = F.xxhash64(F.octet_length("role"), "role", "text").bitwiseAND(low)
    y = F.xxhash64(F.lit("second"), "text", F.octet_length("role"), "role").bitwiseAND(low)
    order = ["conv_id", "turn", "role", F.col("opening"), "x", "y", "id"]
    thin = rows.select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("opening"), "id", x.alias("x"), y.alias("y"), F.octet_length("text").cast("long").alias("bytes"))
    ranges = thin.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "bytes", "x", "y")
    found = settle(ranges.mapInArrow(turn_rows, TURNS), "turns")
    # A conversation lies in several ranges only if it crosses a border, so this list is as long as there are ranges.
    ends = found.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("a", "at").alias("a"), F.max_by("b", "at").alias("b"))
    ends = settle(ends, "ranges")
    crossing = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).filter(F.col("parts") > 1).select("conv_id")
    starts = ends.join(crossing, "conv_id").groupBy("conv_id").applyInPandas(fold_parts, "conv_id long, part int, start long, a_start long, b_start long")
    starts = F.broadcast(settle(starts.filter(F.col("start") > 0), "starts"))
    zero = F.lit(0).cast("long")
    both = found.join(starts, ["conv_id", "part"], "left").fillna(0, ["start", "a_start", "b_start"])
    moved = both.filter(F.col("start") > 0).withColumns({"exponent": F.col("start"), "a_plus": F.col("a_start"), "a_minus": zero, "b_plus": F.col("b_start"), "b_minus": zero})
    names = ["conv_id", "at", "bytes", "a_before", "a", "b_before", "b"]
    late = shifted(moved).withColumn("at", F.col("at") + F.col("start")).select(*names)
    return both.filter(F.col("start") == 0).select(*names).union(late)


def head_size(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % (HEAD + 1)).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: the first h of the one at the multiple of five below, h a checksum
    of the conv_id modulo nine, then the own turns but the first h.

    The first table has a row per conversation: conv_id, depth and the hashes of its end. The second has a row per turn.
    """
    own = settle(turns(conversations), "own-turns")
    first = own.filter(F.col("at") < HEAD).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "bytes", "a_before", "a", "b_before", "b"))).alias("head"))
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("a", "at").alias("a_end"), F.max_by("b", "at").alias("b_end"))
    sizes = sizes.withColumn("h", head_size(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(5)))
    known = settle(sizes.join(first, "conv_id"), "heads")
    bases = known.filter(F.col("conv_id") == F.col("base")).select("base", F.col("head").alias("base_head"))
    known = known.join(bases, "base", "left").withColumn("taken", F.slice(F.coalesce("base_head", F.expr("slice(head, 1, 0)")), 1, F.col("h").cast("int")))
    known = known.withColumn("k", F.size("taken").cast("long"))
    hash_at = lambda c, n, name: F.coalesce(F.get(F.col(c)[name], (n - 1).cast("int")), F.lit(0).cast("long"))
    skipped = F.least("h", "n")
    info = known.select(
        "conv_id", "n", "h", "k", "taken", "a_end", "b_end",
        *[hash_at("taken", F.col("k"), x).alias(f"{x}_plus") for x in "ab"],
        *[hash_at("head", skipped, x).alias(f"{x}_minus") for x in "ab"],
    )
    info = settle(info.withColumn("exponent", F.col("k") - F.col("h")), "rebuilt")
    # What follows the head moves to its end: base**(k - h) times the hash of the own turns after the first h.
    whole = info.select("conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"), *MOVES, F.col("a_end").alias("a"), F.col("b_end").alias("b"), F.col("a_end").alias("a_before"), F.col("b_end").alias("b_before"))
    ends = shifted(whole).select("conv_id", "depth", "a", "b")
    return settle(ends, "ends"), (own, info)


MOVES = ["exponent", "a_plus", "a_minus", "b_plus", "b_minus"]
NODE = ["depth", "a", "b"]


def prefixes(own: DataFrame, info: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, node and node before, bytes and the columns of ``chosen``, for every turn of the rebuilt chosen conversations."""
    more = [c for c in chosen.columns if c != "conv_id"]
    info = settle(info.join(chosen, "conv_id"), "chosen")
    names = ["conv_id", "depth", "bytes", "a_before", "a", "b_before", "b", *more]
    taken = info.select("conv_id", *more, F.explode("taken").alias("t"))
    heads = taken.select("conv_id", (F.col("t.at") + 1).alias("depth"), *[F.col(f"t.{c}").alias(c) for c in names[2:7]], *more)
    wanted = ["h", "k", *MOVES, *more]
    tails = lookup(own, info, ["conv_id"], wanted, "n", "at").filter(F.col("at") >= F.col("h"))
    tails = tails.withColumn("depth", F.col("k") + F.col("at") - F.col("h") + 1)
    return heads.unionByName(shifted(tails).select(*names))


def list_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the comma-joined lists of conversations of a range sorted by sequence and conv_id."""
    now, ids, out = None, [], []
    names = [*NODE, "first", "ids"]

    def close() -> None:
        out.append((*now, ids[0], ",".join(map(str, ids))))

    for batch in batches:
        for depth, a, b, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and ((depth, a, b) != now or len(ids) == LISTED):
                close()
                ids = []
            now = (depth, a, b)
            ids.append(conv_id)
        if len(out) >= BATCH:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), names)
            out = []
    if ids:
        close()
    if out:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), names)


def list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of every list, whose parts come in order."""
    now, digest, out = None, None, []
    names = [*NODE, "ends_sha256"]
    for batch in batches:
        for depth, a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, a, b) != now:
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = (depth, a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(out) >= BATCH:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), names)
            out = []
    if now:
        out.append((*now, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), names)


def end_lists(ends: DataFrame) -> DataFrame:
    """Sequence, first conv_id and the ids of the conversations that are this sequence, in parts of bounded length."""
    order = [*NODE, "conv_id"]
    return ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(list_rows, "depth long, a long, b long, first long, ids string")


def end_digests(ends: DataFrame) -> DataFrame:
    parts = end_lists(ends).repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return parts.mapInArrow(list_digests, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node, the root included: conv_id (the smallest member), depth, parent_conv_id, n_convs (members),
    n_children, n_leaves, saved_tokens (bytes of turns that are there already, over the subtree) and ends_sha256."""
    ends, (own, info) = rebuilt(conversations)
    sequences = settle(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")), "sequences")
    spread = settle(prefixes(own, info, sequences.select("conv_id", "weight")), "prefixes")

    # Proper prefixes of another sequence are the nodes that some turn follows.
    inner = spread.select((F.col("depth") - 1).alias("depth"), F.col("a_before").alias("a"), F.col("b_before").alias("b")).distinct()
    leaves = settle(sequences.join(inner, NODE, "left_anti").select("conv_id", F.col("depth").alias("leaf_depth")), "leaves")
    counted = sequences.select("conv_id", "depth").join(leaves, "conv_id", "left").select("conv_id", F.col("leaf_depth").isNotNull().alias("leaf"), F.col("depth").alias("n"))
    spread = settle(lookup(spread, counted, ["conv_id"], ["leaf"], "n", "depth"), "marked")
    nodes = spread.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.max("bytes").alias("bytes"),
        F.max("a_before").alias("a_before"),
        F.max("b_before").alias("b_before"),
        F.count_if("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("owner"),
    )
    nodes = settle(nodes.withColumn("saving", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")

    paths = spread.filter("leaf").select("conv_id", *NODE)
    worth = nodes.select(*NODE, "owner", "saving", "n_leaves")
    paths = lookup(paths, worth, NODE, ["owner", "saving"], "n_leaves", "conv_id")
    mine = F.when(F.col("owner") == F.col("conv_id"), F.col("saving")).otherwise(0).alias("mine")
    paths = settle(paths.select("conv_id", *NODE, mine, F.floor(F.col("depth") / BLOCK).alias("block")), "paths")
    deeper = "PARTITION BY conv_id ORDER BY block DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    blocks = paths.groupBy("conv_id", "block").agg(F.sum("mine").alias("mine"))
    blocks = blocks.select("conv_id", "block", F.expr(f"coalesce(sum(mine) OVER ({deeper}), 0)").alias("below"))
    within = "PARTITION BY conv_id, block ORDER BY depth DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    saved = paths.join(blocks, ["conv_id", "block"]).withColumn("saved", F.expr(f"sum(mine) OVER ({within})") + F.col("below"))
    saved = saved.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"))

    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("a_before").alias("a"), F.col("b_before").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    children = settle(children, "children")
    digests = settle(end_digests(ends), "end-lists")
    whole = nodes.join(saved, NODE).join(children, NODE, "left").join(digests, NODE, "left")
    whole = settle(whole.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie")

    none = F.sha2(F.lit(""), 256)
    zero = F.lit(0).cast("long")
    # One row each: of all conversations, of the nodes below the root, of the conversations without turns.
    facts = [
        ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")),
        whole.filter(F.col("depth") == 1).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("under"), F.sum("saved_tokens").alias("saved_tokens")),
        digests.filter(F.col("depth") == 0).agg(F.first("ends_sha256").alias("ends_sha256")),
    ]
    names = [c for f in facts for c in f.columns]
    joined = facts[0].unionByName(facts[1], allowMissingColumns=True).unionByName(facts[2], allowMissingColumns=True)
    root = joined.agg(*[F.max(c).alias(c) for c in names]).filter(F.col("n_convs") > 0)
    root = root.select(
        "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("under", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    parents = whole.select(F.col("depth").alias("up"), F.col("a").alias("a_before"), F.col("b").alias("b_before"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    least = root.select(F.col("depth").alias("up"), zero.alias("a_before"), zero.alias("b_before"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = whole.withColumn("up", F.col("depth") - 1)
    below = lookup(below, parents.union(least).withColumnRenamed("n_children", "children"), ["up", "a_before", "b_before"], ["parent_conv_id"], "children", "conv_id")
    return root.unionByName(below.select(*root.columns[:-1], F.coalesce("ends_sha256", none).alias("ends_sha256")))
