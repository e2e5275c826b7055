"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Equal fingerprints are one entry. Entries are sorted by the rank of their bits in the Gray code, which places
fingerprints with few differing bits near each other, and cut into leaves of 64. A node keeps, of all fingerprints
below it, the bits that all of them share (as an AND and an OR); upper nodes group leaves by leading bits of the rank.
The index is joined with itself from the top down: the bits in which the shared patterns of two nodes differ are a
lower bound for all pairs below, and a pair of nodes whose bound passes the limit is dropped with everything under it.
Leaves that remain are compared in full; links are then joined to components by least labels with pointer jumping.

Words are runs of bytes other than white space, A-Z in lower case. Null, empty and blank texts have the fingerprint
zero and link like any other. A null doc_id links but is never the id of a component. An empty table gives no row; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from manyfold.llm.common import fresh, lookup
from manyfold.llm.textgrams import as_bytes
from manyfold.sources.settled import settle

SEED = 42
LEAF = 64
FANOUT_BITS = 4
CROWDED = 256
HASHES = 1 << 16


def fingerprint(text: bytes, size: int = 3) -> int:
    """The bits set in over half of the XXH64 hashes of the text's shingles of words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHES):
        part = words[at : at + HASHES + size - 1]
        runs = map(b" ".join, zip(*(part[k:] for k in range(size))))
        hashes = np.array([xxhash.xxh64_intdigest(run, SEED) for run in runs], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, also: str | None = None) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row; and the long column ``also`` as place."""
    more = [F.col(also).alias("place")] if also else []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t, size) for t in as_bytes(batch.column(1))], np.uint64)
            columns = [batch.column(0), pa.array(marks.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "place"][: len(columns)])

    schema = "doc_id long, fp long" + (", place long" if also else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *more).mapInArrow(rows, schema)


def gray_rank(code: Column) -> Column:
    """The place of a code in the Gray sequence, as a long that sorts in that order."""
    for shift in (32, 16, 8, 4, 2, 1):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def leaf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a sorted partition into leaves. The last is filled up with its last fingerprint."""

    def leaves(rank: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        table = code.reshape(-1, LEAF)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rank[::LEAF]),
                pa.FixedSizeListArray.from_arrays(pa.array(code), LEAF).cast(pa.list_(pa.int64())),
                pa.array(np.bitwise_and.reduce(table, axis=1)),
                pa.array(np.bitwise_or.reduce(table, axis=1)),
            ],
            ["id", "codes", "ones", "any"],
        )

    rank, code = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        rank = np.concatenate([rank, batch.column(0).to_numpy()])
        code = np.concatenate([code, batch.column(1).to_numpy()])
        whole = len(rank) // LEAF * LEAF
        if whole:
            yield leaves(rank[:whole], code[:whole])
            rank, code = rank[whole:], code[whole:]
    if len(rank):
        fill = LEAF - len(rank)
        yield leaves(np.pad(rank, (0, fill), mode="edge"), np.pad(code, (0, fill), mode="edge"))


def link_rows(limit: int):
    """Links within pairs of leaves, each once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.column(0).flatten().to_numpy().view(np.uint64).reshape(-1, LEAF)
            right = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, LEAF)
            found = []
            for at in range(0, len(left), 128):
                x, y = left[at : at + 128], right[at : at + 128]
                apart = np.bitwise_count(x[:, :, None] ^ y[:, None, :])
                k, i, j = np.nonzero((apart <= limit) & (apart > 0))
                found.append(np.stack([x[k, i], y[k, j]], axis=1).view(np.int64))
            links = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            links = np.unique(np.sort(links, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])

    return rows


def links(codes: DataFrame, limit: int = 2) -> DataFrame:
    """u < v: all pairs of the distinct longs of column ``fp`` that differ in 1 to ``limit`` bits."""
    ranked = codes.select(gray_rank(F.col("fp")).alias("rank"), "fp")
    leaves = settle(
        ranked.repartitionByRange("rank").sortWithinPartitions("rank").mapInArrow(leaf_rows, "id long, codes array<long>, ones long, any long"),
        "leaves",
    )
    place = F.col("id").bitwiseXOR(F.lit(-(1 << 63)))
    prefix = lambda level: F.shiftrightunsigned(place, 64 - FANOUT_BITS * level)
    nodes = leaves.select("id", "ones", "any", place.alias("place"))
    # The first level at which no node has many leaves; clusters of close fingerprints go deeper.
    crowds = [leaves.groupBy(prefix(k).alias("p")).count().agg(F.lit(k).alias("level"), F.max("count").alias("most")) for k in range(1, 16)]
    depth = 1
    for crowd in crowds:
        row = crowd.first()
        depth = row.level
        if (row.most or 0) <= CROWDED:
            break

    def level(k: int) -> DataFrame:
        """Nodes of a level; below the last come the leaves themselves."""
        if k > depth:
            return nodes.select("id", "ones", "any", prefix(depth).alias("parent"))
        ids = nodes.select(prefix(k).alias("id"), "ones", "any").groupBy("id")
        shared = ids.agg(F.bit_and("ones").alias("ones"), F.bit_or("any").alias("any"))
        return shared.withColumn("parent", F.shiftrightunsigned("id", FANOUT_BITS))

    def side(k: int, name: str) -> DataFrame:
        return level(k).select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", "ones", "any", "parent")])

    def bound(x: str, y: str) -> Column:
        """Bits that are one in all of one node and zero in all of the other."""
        only = lambda a, b: F.col(f"{a}_ones").bitwiseAND(F.bitwise_not(F.col(f"{b}_any")))
        return F.bit_count(only(x, y).bitwiseOR(only(y, x))) <= limit

    def kept(pairs: DataFrame) -> DataFrame:
        columns = ["x_id", "x_ones", "x_any", "y_id", "y_ones", "y_any"]
        return pairs.filter((F.col("x_id") <= F.col("y_id")) & bound("x", "y")).select(*columns)

    x, y = side(1, "x"), side(1, "y")
    pairs = kept(x.join(y, F.col("x_parent") == F.col("y_parent")))
    for k in range(2, depth + 2):
        old = pairs.toDF("px_id", "px_ones", "px_any", "py_id", "py_ones", "py_any")
        half = old.join(side(k, "x"), F.col("x_parent") == F.col("px_id")).filter(bound("x", "py"))
        # Two different nodes hold different ranges of ranks, so their children are in order as they are.
        pairs = kept(half.join(side(k, "y"), F.col("y_parent") == F.col("py_id")))
        if k <= depth:
            pairs = settle(pairs, "node-pairs")
    pairs = pairs.select("x_id", "y_id")
    with_x = pairs.join(leaves.select(F.col("id").alias("x_id"), F.col("codes").alias("x_codes")), "x_id")
    with_both = with_x.join(leaves.select(F.col("id").alias("y_id"), F.col("codes").alias("y_codes")), "y_id")
    return with_both.select("x_codes", "y_codes").mapInArrow(link_rows(limit), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node that it reaches, for every end of an edge.

    A round takes the least label among neighbours and then the label of that label; labels are settled every round.
    """
    edges = settle(edges, "links")
    both = edges.union(edges.select("v", "u"))
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root"))
    labels = settle(labels, "labels")
    while True:
        heard = both.join(labels, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "root")
        nearer = settle(labels.union(heard).groupBy("node").agg(F.min("root").alias("root")), "labels")
        asked = nearer.groupBy(F.col("root").alias("at")).agg(F.count(F.lit(1)).alias("n_"))
        answers = asked.join(nearer.select(F.col("node").alias("at"), F.col("root").alias("further")), "at")
        jumped = lookup(nearer.withColumn("at", F.col("root")), answers, ["at"], ["further"], "n_", "node")
        jumped = settle(jumped.select("node", F.coalesce("further", "root").alias("root")), "labels")
        old = labels.select("node", F.col("root").alias("before"))
        if jumped.join(old, "node").filter(F.col("root") != F.col("before")).isEmpty():
            return jumped
        labels = jumped


def rooted_prints(marks: DataFrame, limit: int) -> DataFrame:
    """fp, least (its smallest doc_id), n_ (its rows) and root, equal for all fingerprints of a component."""
    classes = marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_"))
    classes = settle(classes, "classes")
    roots = components(links(classes.select("fp"), limit))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left")
    return settle(rooted.select("fp", "least", "n_", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, text: str = "text", limit: int = 2) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of ``limit`` bits, for every row."""
    marks = settle(fingerprints(docs, text), "fingerprints")
    rooted = rooted_prints(marks, limit)
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m_"))
    named = lookup(rooted, groups, ["root"], ["component_id"], "m_", "fp").select("fp", "component_id", "n_")
    return lookup(marks, named, ["fp"], ["component_id"], "n_", "doc_id").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", limit: int = 2) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest doc_id, those without one last.

    Rows are told apart by doc_id and text, so rows of one doc_id with different texts are documents of their own; of
    rows with the same doc_id and text any one stays, as they differ in nothing that was compared.
    """
    place = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    doc_id = F.col("doc_id").cast("long")
    marks = settle(fingerprints(docs.withColumn(fresh(docs, "place"), place), text, also=fresh(docs, "place")), "fingerprints")
    rooted = rooted_prints(marks, limit)
    named = lookup(marks, rooted.select("fp", "root", "n_"), ["fp"], ["root"], "n_", "place")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "place")).alias("first")
    keep = named.groupBy("root").agg(first).select(F.col("first.bare").alias("bare_"), F.coalesce("first.doc_id", F.lit(0)).alias("key_"), F.col("first.place").alias("place_"))
    row = fresh(docs, "row")
    packed = docs.select(F.struct(*docs.columns).alias(row), doc_id.isNull().alias("bare_"), F.coalesce(doc_id, F.lit(0)).alias("key_"), place.alias("place_"))
    kept = packed.join(settle(keep, "kept"), ["bare_", "key_", "place_"], "left_semi")
    return kept.groupBy("bare_", "key_", "place_").agg(F.first(row).alias(row)).select(f"{row}.*")
