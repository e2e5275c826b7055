from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import manyfold as mf
from manyfold.functions import trees
from manyfold.operators.linear import MODEL_JSON
from manyfold.operators.forest import ForestSettings
from manyfold.operators.split import split_rows
from tests.conftest import FEATURES, ROW_KEY


def frame(spark, rows, schema="k string, i long, x double, y double"):
    return spark.createDataFrame(rows, schema)


def sized(spark, sizes):
    return frame(spark, [(f"n{n}", i, float((i * 7) % 11), 3.0 * ((i * 7) % 11) + i % 3) for n in sizes for i in range(n)])


def by_key(models, key="k"):
    return {r[key]: r for r in models.collect()}


@pytest.mark.parametrize("estimator", ["linear", "ridge", "forest"])
def test_group_sizes(spark, estimator):
    models = mf.train(sized(spark, [1, 2, 9, 10, 11]), ["k"], "y", ["x"], estimator, ["k", "i"])
    found = by_key(models)
    for n in (1, 2, 9):
        row = found[f"n{n}"]
        assert row.status == "insufficient_data" and row.num_rows == n
        assert row.model_bytes is None and row.feature_names is None and row.rmse is None and row.mse is None
    for n in (10, 11):
        row = found[f"n{n}"]
        assert row.status == "success" and row.num_rows == n and row.feature_names == ["x"]
        assert row.rmse == pytest.approx(math.sqrt(row.mse))


def test_validation_size(spark):
    split = mf.holdout_split(sized(spark, [1, 5, 10, 11]), ["k"], "y", ["x"], ["k", "i"])
    held = {r.k: r.n for r in split.groupBy("k").agg(F.sum(F.col("is_validation").cast("int")).alias("n")).collect()}
    assert held == {"n1": 1, "n5": 1, "n10": 2, "n11": 3}


@pytest.mark.parametrize("estimator", ["linear", "forest"])
def test_missing_values(spark, estimator):
    nan = float("nan")
    rows = []
    for i in range(20):
        x = float(i % 7)
        rows.append(("good", i, x, 2 * x))
        rows.append(("gap", i, None if i == 3 else nan if i == 4 else x, 2 * x))
        rows.append(("zero", i, 0.0 if i in (3, 4) else x, 2 * x))
        rows.append(("lost", i, x, None if i == 5 else 2 * x))
        rows.append(("nan", i, x, nan if i == 5 else 2 * x))
        rows.append(("inf", i, float("inf") if i == 5 else x, 2 * x))
    found = by_key(mf.train(frame(spark, rows), ["k"], "y", ["x"], estimator, ["i"]))
    assert found["good"].status == found["gap"].status == found["zero"].status == "success"
    # A missing feature is a zero, in the fit and in the error alike.
    assert found["gap"].model_bytes == found["zero"].model_bytes and found["gap"].rmse == found["zero"].rmse
    assert found["lost"].status == found["nan"].status == "error: missing target"
    assert found["inf"].status == "error: value is not finite"
    assert all(found[k].num_rows == 20 for k in found)
    refused = by_key(mf.train(frame(spark, rows), ["k"], "y", ["x"], estimator, ["i"], fill=None))
    assert refused["gap"].status == "error: missing feature" and refused["good"].status == "success"


def test_constant_feature(spark):
    df = frame(spark, [("c", i, 5.0, float(i)) for i in range(20)])
    assert by_key(mf.train(df, ["k"], "y", ["x"], "linear", ["i"]))["c"].status == "error: singular matrix"
    assert by_key(mf.train(df, ["k"], "y", ["x"], "ridge", ["i"]))["c"].status == "success"
    assert by_key(mf.train(df, ["k"], "y", ["x"], "forest", ["i"]))["c"].status == "success"
    twice = df.withColumn("z", F.col("i") * 1.0).withColumn("x", F.col("i") * 2.0)
    assert by_key(mf.train(twice, ["k"], "y", ["x", "z"], "linear", ["i"]))["c"].status == "error: singular matrix"


@pytest.mark.parametrize("estimator", ["linear", "forest"])
def test_null_and_typed_keys(spark, estimator):
    rows = [(a, b, i, float(i % 5), float(i % 5) * w) for a, b, w in ((1, "u", 1), (1, None, 2), (None, "u", 3), (0, "u", 4))
            for i in range(15)]
    df = frame(spark, rows, "a long, b string, i long, x double, y double")
    models = mf.train(df, ["a", "b"], "y", ["x"], estimator, ["i"])
    assert models.schema["a"].dataType.simpleString() == "bigint"
    assert {(r.a, r.b) for r in models.collect()} == {(1, "u"), (1, None), (None, "u"), (0, "u")}
    scored = mf.score(df, models, ["a", "b"], estimator)
    assert scored.count() == 60
    assert scored.filter(F.abs(F.col("y") - F.col("prediction")) > 1.5).count() == 0


def test_bad_arguments(spark, synth):
    with pytest.raises(ValueError, match="missing column"):
        mf.train(synth, ["sku_id"], "sales", ["feat_9"], "linear")
    with pytest.raises(ValueError, match="not numeric"):
        mf.train(synth, ["sku_id"], "sales", ["sku_id"], "linear")
    with pytest.raises(ValueError, match="estimator"):
        mf.train(synth, ["sku_id"], "sales", FEATURES, "boost")
    with pytest.raises(ValueError, match="num_trials"):
        mf.tune(synth, ["sku_id"], "sales", FEATURES, num_trials=0)


def test_inferred_features(spark, synth):
    assert mf.infer_features(synth, ["sku_id"], "sales") == ["row_id", *FEATURES]
    models = mf.train(synth.drop("row_id"), ["sku_id"], "sales", estimator="linear")
    assert models.first().feature_names == FEATURES


@pytest.mark.parametrize("estimator", ["linear", "forest"])
def test_order_and_partitions_do_not_matter(spark, synth, estimator):
    def result(df):
        rows = mf.train(df, ["sku_id"], "sales", FEATURES, estimator, ROW_KEY, n_estimators=5).orderBy("sku_id").collect()
        return [(r.sku_id, round(r.rmse, 8), round(r.mae, 8), r.model_bytes if estimator == "forest" else 0) for r in rows]

    assert result(synth) == result(synth.orderBy(F.desc("feat_1")).repartition(5)) == result(synth.coalesce(1))


def test_linear_against_lstsq(spark, synth):
    split = mf.holdout_split(synth, ["sku_id"], "sales", FEATURES, ROW_KEY).toPandas()
    models = mf.train(synth, ["sku_id"], "sales", FEATURES, "linear", ROW_KEY)
    parsed = models.withColumn("m", F.from_json(F.decode("model_bytes", "UTF-8"), MODEL_JSON))
    for r in parsed.collect():
        mine = split[split.sku_id == r.sku_id]
        fit, held = mine[~mine.is_validation], mine[mine.is_validation]
        design = np.column_stack([np.ones(len(fit)), fit[FEATURES]])
        want = np.linalg.lstsq(design, fit["sales"].to_numpy(), rcond=None)[0]
        got = [r.m.intercept, *r.m.coefficients]
        assert np.allclose(got, want, rtol=1e-9)
        error = held["sales"] - np.column_stack([np.ones(len(held)), held[FEATURES]]) @ want
        assert r.mse == pytest.approx(float((error**2).mean())) and r.mae == pytest.approx(float(error.abs().mean()))


def test_linear_recovers_the_law(spark):
    models = mf.train(mf.synth_groups(spark, 3, 4000), ["sku_id"], "sales", FEATURES, "linear", ROW_KEY)
    parsed = models.withColumn("m", F.from_json(F.decode("model_bytes", "UTF-8"), MODEL_JSON)).collect()
    for r in parsed:
        assert np.allclose(r.m.coefficients, [2.5, 1.8, 3.2], atol=0.2)
        assert 18 < r.rmse < 22


def test_forest_beats_the_mean(spark, synth):
    models = by_key(mf.train(synth, ["sku_id"], "sales", FEATURES, "forest", ROW_KEY), "sku_id")
    split = mf.holdout_split(synth, ["sku_id"], "sales", FEATURES, ROW_KEY).toPandas()
    for key, mine in split.groupby("sku_id"):
        fit, held = mine[~mine.is_validation], mine[mine.is_validation]
        spread = math.sqrt(((held["sales"] - fit["sales"].mean()) ** 2).mean())
        assert models[key].rmse < 0.7 * spread


# Every group above the size of one task: the results must be those of whole groups.


@pytest.mark.parametrize("limit", [7, 30])
def test_split_of_hot_groups(spark, synth, limit):
    def split(rows_per_task):
        return mf.holdout_split(synth, ["sku_id"], "sales", FEATURES, ROW_KEY, rows_per_task=rows_per_task)

    whole, parted = split(1000), split(limit)
    assert whole.exceptAll(parted).count() == 0 and parted.exceptAll(whole).count() == 0


def test_split_of_copies(spark):
    """Rows with one row key across the cut: the counts are exact, and no copy is lost."""
    rows = [("hot", 1 if i < 300 else i, 1.0 if i < 300 else float(i), 2.0 if i < 300 else float(i)) for i in range(500)]
    rows += [("same", 1, 1.0, 2.0)] * 400 + [("cold", i, float(i), 1.0) for i in range(20)]
    df = frame(spark, rows)

    def split(rows_per_task):
        return mf.holdout_split(df, ["k"], "y", ["x"], ["i"], rows_per_task=rows_per_task)

    whole, parted = split(10_000), split(50)
    assert whole.exceptAll(parted).count() == 0 and parted.exceptAll(whole).count() == 0
    held = {r.k: r.n for r in parted.groupBy("k").agg(F.sum(F.col("is_validation").cast("int")).alias("n")).collect()}
    assert held == {"hot": 100, "same": 80, "cold": 4}


@pytest.mark.parametrize("estimator", ["linear", "ridge"])
def test_linear_on_hot_groups(spark, synth, estimator):
    def result(rows_per_task):
        models = mf.train(synth, ["sku_id"], "sales", FEATURES, estimator, ROW_KEY, rows_per_task=rows_per_task)
        return [(r.sku_id, r.num_rows, r.status, round(r.rmse, 8), round(r.mae, 8)) for r in models.orderBy("sku_id").collect()]

    assert result(1000) == result(20)


@pytest.mark.parametrize(("rows_per_task", "chunk"), [(50, 1 << 16), (8, 1 << 16), (20, 1)])
def test_forest_on_hot_groups(spark, monkeypatch, rows_per_task, chunk):
    """One hot key beside cold ones: the upper levels on the attribute lists, the rest by a task per node."""
    from manyfold.operators import forest_wide

    monkeypatch.setattr(forest_wide, "CHUNK", 16 if chunk == 1 else chunk)
    hot = mf.synth_groups(spark, 1, 120).withColumn("feat_2", F.round("feat_2", -1))
    cold = mf.synth_groups(spark, 3, 20).filter("sku_id <> 'SKU_001'")
    df = hot.union(cold)

    def result(size):
        models = mf.train(df, ["sku_id"], "sales", FEATURES, "forest", ROW_KEY, n_estimators=4, min_samples_leaf=2, rows_per_task=size)
        return {r.sku_id: (bytes(r.model_bytes), round(r.rmse, 8), round(r.mae, 8), r.num_rows) for r in models.collect()}

    assert result(1000) == result(rows_per_task)


def test_large_pure_nodes_stay_leaves(spark):
    """Nodes of equal targets or equal features are not gathered, however many rows they have."""
    rows = [("pure", i, float(i % 2), 5.0) for i in range(100)] + [("same", i, 1.0, float(i)) for i in range(100)]
    rows += [("half", i, float(i), float(i >= 50) * 3 + float(i > 98)) for i in range(100)]
    df = frame(spark, [(k, i, x, y) for k, i, x, y in rows])
    settings = dict(n_estimators=5, row_key=["i"])
    cold = by_key(mf.train(df, ["k"], "y", ["x"], "forest", **settings))
    hot = by_key(mf.train(df, ["k"], "y", ["x"], "forest", rows_per_task=10, **settings))
    assert {k: bytes(m.model_bytes) for k, m in cold.items()} == {k: bytes(m.model_bytes) for k, m in hot.items()}
    for k, m in cold.items():
        assert (m.rmse, m.mae) == pytest.approx((hot[k].rmse, hot[k].mae))


def test_no_row_is_repeated_per_tree(spark):
    """What leaves the scan of a hot group are its rows once per feature, blocks of rows, and sums."""
    from manyfold.operators import forest_wide

    df = mf.synth_groups(spark, 1, 2000)
    split = split_rows(df, ["sku_id"], "sales", FEATURES, ROW_KEY, rows_per_task=500, bucketed=True)
    fit = forest_wide.WideFit(split, 3, ForestSettings(n_estimators=20), None, 10, 42, 500)
    told, grown, _, _ = fit.rounds[0]
    rows = fit.rows
    blocks = rows.mapInArrow(forest_wide.node_blocks(3, told, 1 << 22), "g int, node long, x0 array<double>, x1 array<double>, x2 array<double>, " + forest_wide.ROW_ARRAYS)
    local = (told.value.nodes["state"] == forest_wide.LOCAL).sum()
    assert blocks.count() <= local * rows.rdd.getNumPartitions() < 2000
    assert forest_wide.attribute_lists(rows.filter(~F.col("_held")), 3).count() <= 3 * 8 + 8


def test_a_grown_node_is_told_by_its_feature_and_a_number(spark):
    """Where all trials have the same limits no more is stored, and the truth once."""
    from manyfold.operators import forest_wide

    df = mf.synth_groups(spark, 1, 600)
    split = split_rows(df, ["sku_id"], "sales", FEATURES, ROW_KEY, rows_per_task=100, bucketed=True)
    fit = forest_wide.WideFit(split, 3, ForestSettings(n_estimators=6), None, 10, 42, 100)
    told, grown, _, _ = fit.rounds[0]
    nodes = grown.filter("feature is not null")
    assert {"threshold", "left", "depth"}.isdisjoint(grown.columns) and nodes.filter("size(feature) <> size(number)").count() == 0
    assert nodes.filter("value is not null or count is not null").count() == 0
    assert grown.filter("y is not null").select(F.sum(F.size("y"))).first()[0] == 120
    assert told.value.tree[[r.unit for r in grown.filter("y is not null").select("unit").distinct().collect()]].tolist() == [0]
    feature = np.array([0, 1, -1, 2, -1, -1, 0, -1, -1])
    assert forest_wide.left_of(feature).tolist() == [1, 3, -1, 5, -1, -1, 7, -1, -1]
    assert forest_wide.depth_of(feature, 4).tolist() == [4, 5, 5, 6, 6, 7, 7, 8, 8]


def test_a_group_that_cannot_be_fitted_stands_alone(spark):
    rows = [(k, i, float(i % 7), float((i * 13) % 11)) for k in "abcdefg" for i in range(40)]
    rows += [("x", i, float(i % 7), (-1.0) ** i * 1.7e308) for i in range(40)]
    df = frame(spark, rows)
    for size in (1000, 10):
        found = by_key(mf.train(df, ["k"], "y", ["x"], "forest", ["i"], n_estimators=3, rows_per_task=size))
        assert found.pop("x").status == "error: the span of the target is not finite"
        assert len(found) == 7 and {m.status for m in found.values()} == {"success"}


def test_faults_of_hot_groups(spark):
    rows = [("lost", i, float(i), None if i == 5 else 1.0) for i in range(60)]
    rows += [("good", i, float(i % 9), float(i % 9)) for i in range(60)]
    df = frame(spark, rows)
    for estimator in ("linear", "forest"):
        found = by_key(mf.train(df, ["k"], "y", ["x"], estimator, ["i"], n_estimators=3, rows_per_task=20))
        assert found["lost"].status == "error: missing target" and found["lost"].num_rows == 60
        assert found["good"].status == "success"


def test_bucket_holds_whole_groups(spark, synth):
    split = split_rows(synth, ["sku_id"], "sales", FEATURES, ROW_KEY, rows_per_task=50_000, bucketed=True)
    assert split.cold.groupBy("_k0").agg(F.countDistinct("_bucket").alias("n")).filter("n > 1").count() == 0


def test_split_with_a_row_key_that_tells_nothing_apart(spark, synth):
    """All rows of a hot group share one hash; their order is then that of their values."""
    one = synth.withColumn("nothing", F.lit(1))

    def split(rows_per_task):
        return mf.holdout_split(one, ["sku_id"], "sales", FEATURES, ["nothing"], rows_per_task=rows_per_task)

    whole, parted = split(1000), split(20)
    assert whole.exceptAll(parted).count() == 0 and parted.exceptAll(whole).count() == 0
    assert parted.filter("is_validation").count() == 6 * 16


def test_every_forest_has_all_its_trees(spark):
    """Groups of one to three training rows, of which a bootstrap often draws none."""
    rows = [(k, i, float(7 * k + i * i), float(i)) for k in range(6) for i in range(2 + k % 3)]
    df = spark.createDataFrame(rows, "k long, i long, y double, x double")
    settings = dict(n_estimators=12, min_rows=2)
    cold = by_key(mf.train(df, ["k"], "y", ["x"], "forest", ["i"], **settings))
    hot = by_key(mf.train(df, ["k"], "y", ["x"], "forest", ["i"], rows_per_task=1, **settings))
    assert {len(trees.unpack(m.model_bytes)[3]) for m in cold.values()} == {12}
    assert {k: bytes(m.model_bytes) for k, m in cold.items()} == {k: bytes(m.model_bytes) for k, m in hot.items()}


def test_a_larger_group_has_no_more_levels(spark, monkeypatch):
    """On noise the best cut takes few rows off, so a level per cut down to ``rows_per_task`` rows had no end."""
    from manyfold.operators import forest_wide
    from manyfold.operators.forest import ForestSettings

    levels = []
    whole = forest_wide.apply_cuts
    monkeypatch.setattr(forest_wide, "apply_cuts", lambda *args: (levels.append(1), whole(*args)))
    noise = F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double")
    rows = spark.range(6000).select(F.lit("a").alias("k"), "id", noise.alias("y"), (F.col("id") % 997).cast("double").alias("x"))
    split = mf.operators.split.split_rows(rows, ["k"], "y", ["x"], ["id"], rows_per_task=20, bucketed=True)
    fit = forest_wide.WideFit(split, 1, ForestSettings(n_estimators=4), None, 10, 42, 20)
    tops = fit.rounds[0][0].value
    assert (tops.local == 2400).all() and (tops.nodes["state"] == forest_wide.LOCAL).sum() >= 4
    assert len(levels) <= 12


def test_a_bucket_keeps_little_beside_its_forests():
    """What is kept of a grown tree until it is packed is four numbers of 32 bits and one of 64 per node."""
    from manyfold.operators.forest import BucketFit

    kept = []

    class Watched(BucketFit):
        def _packed(self, grown, owner):
            kept.extend([[a.itemsize for a in part[-5:]] for part in grown])
            return super()._packed(grown, owner)

    rng, n = np.random.default_rng(3), 4000
    group = np.repeat(np.arange(200), 20)
    work = Watched(group, rng.random((2, n)), rng.random(n), rng.integers(0, 1 << 60, n), np.tile(np.arange(20) < 4, 200), 42, 200)
    plan = pd.DataFrame({"group": np.arange(200), "trial": 0, "n_estimators": 60, "max_depth": np.nan, "min_samples_split": 2, "min_samples_leaf": 1})
    models = work.run(plan, True)[2]
    assert len(kept) > 1 and {sum(sizes) for sizes in kept} == {24}
    assert all(len(trees.unpack(m)[3]) == 60 for m in models)


def test_a_large_forest_is_made_in_pieces(spark, monkeypatch):
    """A task packed the whole forest of a key, in one cell that grows with the rows of the key."""
    from manyfold.operators import forest_wide
    from manyfold.sources.pieces import PIECE, pieces_of

    rows = [(k, i, float((i * 37) % 101), float((i * 53) % 97)) for k in "abc" for i in range(200)]
    rows += [("few", i, 1.0, 1.0) for i in range(3)] + [("lost", i, float(i), None) for i in range(80)]
    df = frame(spark, rows)
    settings = dict(n_estimators=6, row_key=["i"])
    cold = mf.train(df, ["k"], "y", ["x"], "forest", **settings)
    monkeypatch.setattr(forest_wide, "PIECE_ROWS", 450)
    hot = mf.train(df, ["k"], "y", ["x"], "forest", rows_per_task=50, **settings)
    assert pieces_of(cold) is None
    pieces = pieces_of(hot).pieces.collect()
    assert sorted((r.k, r[PIECE]) for r in pieces) == [(k, n) for k in "abc" for n in (0, 2, 4)]
    assert {len(trees.unpack(r.model_bytes)[3]) for r in pieces} == {2}
    cell, whole = by_key(cold), by_key(hot)
    assert {k: (m.status, m.model_bytes, m.feature_names, m.num_rows) for k, m in whole.items()} == {
        k: (m.status, m.model_bytes, m.feature_names, m.num_rows) for k, m in cell.items()
    }
    listing = hot.select("k", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert "packed_forest" not in listing and "forest(" in listing and "joined" not in listing and "joined" in hot._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.undo()
    assert {r[PIECE] for r in pieces_of(mf.train(df, ["k"], "y", ["x"], "forest", rows_per_task=50, **settings)).pieces.collect()} == {0}


def test_pieces_of_a_search_are_those_of_the_winner(spark, monkeypatch):
    from manyfold.operators import forest_wide
    from manyfold.sources.pieces import pieces_of

    monkeypatch.setattr(forest_wide, "PIECE_ROWS", 300)
    df = frame(spark, [(k, i, float((i * 37) % 101), float((i * 53) % 97)) for k in "ab" for i in range(150)])
    space = {"n_estimators": mf.IntRange(3, 9), "max_depth": mf.Choice(3, None), "min_samples_split": mf.Choice(2, 5), "min_samples_leaf": mf.Choice(1, 2)}
    made = [mf.tune(df, ["k"], "y", ["x"], space, 4, "forest", row_key=["i"], rows_per_task=n) for n in (1000, 50)]
    cold, hot = map(by_key, made)
    assert {k: (bytes(m.model_bytes), m.n_estimators) for k, m in cold.items()} == {k: (bytes(m.model_bytes), m.n_estimators) for k, m in hot.items()}
    sizes = [len(trees.unpack(r.model_bytes)[3]) for r in pieces_of(made[1]).pieces.collect()]
    assert max(sizes) <= 2 and sum(sizes) == sum(m.n_estimators for m in hot.values())


def test_forests_are_joined_tree_after_tree():
    one = trees.pack(np.array([0, -1, -1]), np.array([0.5, 1.0, 2.0]), np.array([1, -1, -1]), [0])
    leaf = trees.pack(np.array([-1]), np.array([7.0]), np.array([-1]), [0])
    feature, number, left, roots = trees.unpack(trees.join([one, leaf, one]))
    assert feature.tolist() == [0, -1, -1, -1, 0, -1, -1] and roots.tolist() == [0, 3, 4]
    assert left.tolist() == [1, -1, -1, -1, 5, -1, -1] and number.tolist() == [0.5, 1.0, 2.0, 7.0, 0.5, 1.0, 2.0]
    assert bytes(trees.join([one])) == one
