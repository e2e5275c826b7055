"""Mixing sources to target weights along a curriculum that changes over the training time.

Each source has a weight schedule, a piecewise linear function of the training time 0 to 1. Its integral is the weight
of the source in the whole mix; its running integral, as a share of that, is the cumulative demand for its words. The
documents of a source stand one after another in a fixed random order, pass after pass, and each takes its place in the
cumulative words of its source. Inverting the demand at that place gives the document's training position, and sorting
all documents by position, over ranges, gives the training order.

Targets: the mix has ``share`` times the words of all sources. No source gives more than ``repeats`` times its own
words; what it cannot give is shared by weight among the others, until none is above. The last document that a target
reaches is taken up to the word that fills it.

Null and empty texts have no words and are never taken. Null is a source of its own, the last. Repeated rows are
documents of their own. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from manyfold.llm.common import fresh

WEIGHTS = (5.0, 2.0, 1.0)
# How much a weight class gains from the begin to the end, relative to its weight: heavy sources fade, light ones grow.
DRIFT = (-1.0, 0.0, 1.0)
SHARE, REPEATS = 1.5, 2
# Documents of a source are summed within 16**3 sections of their random order, then over sections.
SECTION_DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def pick(values: tuple[float, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def with_areas(knots: Column) -> Column:
    """Knots (at, level) with the running integral up to each."""
    first = F.struct(knots[0]["at"].alias("at"), knots[0]["level"].alias("level"), F.lit(0.0).alias("area"))

    def step(done: Column, knot: Column) -> Column:
        last = F.element_at(done, -1)
        area = last["area"] + (knot["level"] + last["level"]) / 2 * (knot["at"] - last["at"])
        return F.concat(done, F.array(F.struct(knot["at"].alias("at"), knot["level"].alias("level"), area.alias("area"))))

    return F.aggregate(F.slice(knots, F.lit(2), F.size(knots)), F.array(first), step)


def inverted(share: Column, knots: Column) -> Column:
    """The time by which the running integral has reached a share of the whole."""
    want = share * F.element_at(knots, -1)["area"]
    at = F.least(F.size(F.filter(knots, lambda k: k["area"] <= want)), F.size(knots) - 1)
    a, b = F.element_at(knots, at), F.element_at(knots, at + 1)
    rest, slope = want - a["area"], (b["level"] - a["level"]) / (b["at"] - a["at"])
    root = F.sqrt(F.greatest(a["level"] * a["level"] + 2 * slope * rest, F.lit(0.0)))
    return F.when(rest <= 0, a["at"]).otherwise(F.least(a["at"] + 2 * rest / (a["level"] + root), b["at"]))


def default_schedules(sources: DataFrame) -> DataFrame:
    """Weights repeat over sources in code point order; each class drifts around its weight."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight, drift = pick(WEIGHTS, place), pick(DRIFT, place)
    level = lambda at, sign: F.struct(F.lit(at).alias("at"), (weight + sign * weight * drift / 2).alias("level"))
    return sources.withColumn("knots", F.array(level(0.0, -1), level(1.0, 1)))


def targets(sources: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Adds weight, target and the knots with areas to rows of (source, source_size, knots).

    There is a row for each component of the mix, a list that its owner writes; so it is ranked in one task.
    """
    known = sources.withColumn("knots", with_areas(F.col("knots"))).withColumn("weight", F.element_at("knots", -1)["area"])
    everything = W.partitionBy()
    known = known.withColumns({"total": share * F.sum("source_size").over(everything), "cap": repeats * F.col("source_size").cast("double")})
    # Sources are full in order of cap over weight: those before the first that is not.
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    known = known.withColumns(
        {
            "place": F.row_number().over(order),
            "given": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    known = known.withColumn("rate", (F.col("total") - F.col("given")) / F.col("left"))
    open_ = F.when(F.col("cap") > F.col("rate") * F.col("weight"), F.struct("place", "rate"))
    known = known.withColumn("first", F.min(open_).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap"))
    return known.withColumn("target", target.otherwise(F.col("first.rate") * F.col("weight"))).select(
        "source", "source_size", "weight", "target", "knots"
    )


def mix(docs: DataFrame, size: str | None = None, schedules=default_schedules, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The documents with source_size, target, taken, and for every pass that takes any of it (words, position).

    ``size`` names a column of word counts; without it words of ``text`` are counted. The input's columns stay, under
    one column ``row``, so that no names can clash.
    """
    counted = F.col(size) if size else word_count("text")
    # A null source must equal itself in a join.
    source = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    name = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col("doc_id").alias("id"),
        F.col("source").alias("source"),
        source.alias("source_key"),
        counted.cast("long").alias("size"),
        name.alias("order"),
        F.substring(name, 1, SECTION_DIGITS).alias("section"),
    )
    sections = rows.groupBy("source_key", "section").agg(F.min("source").alias("source"), F.sum("size").alias("words"))
    totals = sections.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("words").alias("source_size"))
    budgets = targets(schedules(totals), share, repeats).join(totals.select("source_key", F.col("source").alias("s_")), F.col("source").eqNullSafe(F.col("s_")))
    earlier = W.partitionBy("source_key").orderBy("section").rowsBetween(W.unboundedPreceding, -1)
    sections = sections.select("source_key", "section", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("begin"))
    sections = sections.join(budgets.select("source_key", "source_size", "target", "knots"), "source_key")

    own = W.partitionBy("source_key", "section").orderBy("order", "id", "size")
    placed = rows.withColumn("within", F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(sections, ["source_key", "section"])
    budget = F.round("target").cast("long")

    def one_pass(k: int) -> Column:
        begin = F.col("source_size") * k + F.col("begin") + F.col("within")
        words = F.greatest(F.least(F.col("size"), budget - begin), F.lit(0))
        return F.struct(words.alias("words"), inverted(begin / F.col("target"), F.col("knots")).alias("position"))

    passes = F.filter(F.array(*[one_pass(k) for k in range(repeats)]), lambda p: p["words"] > 0)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    return placed.withColumn("passes", passes).select("row", "size", "source_size", "target", taken.alias("taken"), "passes")


def training_order(docs: DataFrame, **settings) -> DataFrame:
    """One row for every time a document is taken: its columns, mix_copy, mix_words and mix_position, in training order."""
    mixed = mix(docs, **settings)
    copy, words, position = (fresh(docs, f"mix_{x}") for x in ("copy", "words", "position"))
    each = mixed.select("row", F.posexplode("passes").alias("copy", "p"))
    each = each.select("row.*", F.col("copy").alias(copy), F.col("p.words").alias(words), F.col("p.position").alias(position))
    return each.repartitionByRange(position, "doc_id").sortWithinPartitions(position, "doc_id", copy)
