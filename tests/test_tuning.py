from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

import manyfold as mf
from manyfold.functions import guided
from manyfold.functions.keys import KeyCode
from manyfold.operators.forest_tune import guided_plan
from tests.conftest import FEATURES, ROW_KEY

SPACE = {
    "n_estimators": mf.IntRange(3, 9),
    "max_depth": mf.Choice(2, 4, None),
    "min_samples_split": mf.Choice(2, 5, 10),
    "min_samples_leaf": mf.Choice(1, 2, 4),
}


def test_plan_covers_the_space(spark, synth):
    keys = synth.select("sku_id").distinct()
    plan = mf.trial_plan(keys, ["sku_id"], mf.FOREST_SPACE, 200)
    assert plan.count() == 1200
    assert plan.agg(F.min("n_estimators"), F.max("n_estimators")).first() == (50, 300)
    depths = {r.max_depth for r in plan.select("max_depth").distinct().collect()}
    assert depths == {5, 10, 15, 20, None}
    again = mf.trial_plan(keys.repartition(3), ["sku_id"], mf.FOREST_SPACE, 200)
    assert plan.exceptAll(again).count() == 0
    # A longer plan begins with the shorter one.
    assert mf.trial_plan(keys, ["sku_id"], mf.FOREST_SPACE, 3).exceptAll(plan).count() == 0
    with pytest.raises(ValueError):
        mf.trial_plan(keys, ["sku_id"], mf.FOREST_SPACE, 0)


def test_best_trial(spark):
    nan = float("nan")
    rows = [("equal", 0, 2.0), ("equal", 1, 1.0), ("equal", 2, 1.0), ("nan", 0, nan), ("nan", 1, 9.0), ("none", 0, None),
            ("none", 1, 5.0), ("all", 0, None)]
    best = mf.best_trial(spark.createDataFrame(rows, "k string, trial long, rmse double"), ["k"])
    assert {r.k: r.trial for r in best.collect()} == {"equal": 1, "nan": 1, "none": 1, "all": 0}


@pytest.mark.parametrize("rows_per_task", [1000, 30])
def test_ridge_picks_the_best_of_its_trials(spark, synth, rows_per_task):
    arguments = dict(estimator="ridge", row_key=ROW_KEY, rows_per_task=rows_per_task)
    trials = mf.evaluate_trials(synth, ["sku_id"], "sales", FEATURES, **arguments)
    tuned = {r.sku_id: r for r in mf.tune(synth, ["sku_id"], "sales", FEATURES, **arguments).collect()}
    least = {r.sku_id: r for r in trials.groupBy("sku_id").agg(F.min("rmse").alias("rmse")).collect()}
    assert len(tuned) == 6
    for key, row in tuned.items():
        assert row.status == "success" and row.alpha is not None
        # Errors from sums and errors from rows are the same numbers.
        assert row.rmse == pytest.approx(least[key].rmse, rel=1e-9)


def test_ridge_shrinks(spark, synth):
    space = {"alpha": mf.Choice(1e9)}
    tuned = mf.tune(synth, ["sku_id"], "sales", FEATURES, space, 1, "ridge", row_key=ROW_KEY)
    flat = mf.score(synth, tuned, ["sku_id"], "ridge").groupBy("sku_id").agg(F.stddev("prediction").alias("s"))
    assert flat.filter("s > 0.1").count() == 0


@pytest.mark.parametrize("rows_per_task", [50_000, 30])
def test_forest_picks_the_best_of_its_trials(spark, synth, rows_per_task):
    df = synth.filter("sku_id < 'SKU_003'")
    arguments = dict(space=SPACE, num_trials=4, estimator="forest", row_key=ROW_KEY)
    trials = mf.evaluate_trials(df, ["sku_id"], "sales", FEATURES, rows_per_task=rows_per_task, **arguments).collect()
    tuned = mf.tune(df, ["sku_id"], "sales", FEATURES, rows_per_task=rows_per_task, **arguments).collect()
    for row in tuned:
        mine = [t for t in trials if t.sku_id == row.sku_id]
        best = min(mine, key=lambda t: (t.rmse, t.trial))
        assert len(mine) == 4 and row.status == "success"
        assert row.rmse == pytest.approx(best.rmse, rel=1e-12)
        assert all(row[p] == best[p] for p in SPACE)


@pytest.mark.parametrize("search", ["random", "tpe"])
def test_winners_of_hot_groups_come_out_of_the_search(spark, synth, search):
    """A hot key's winner is cut out of the trees of all trials, and is the forest that the same settings train alone."""
    df = synth.filter("sku_id < 'SKU_004'")
    arguments = dict(space=SPACE, num_trials=12 if search == "tpe" else 6, search=search, row_key=ROW_KEY)
    cold = mf.tune(df, ["sku_id"], "sales", FEATURES, **arguments).collect()
    hot = mf.tune(df, ["sku_id"], "sales", FEATURES, rows_per_task=25, **arguments).collect()
    told = lambda rows: {r.sku_id: (bytes(r.model_bytes), *(r[p] for p in SPACE), round(r.rmse, 8), r.status) for r in rows}
    assert told(hot) == told(cold) and len(hot) == 3


def test_shared_trees_give_the_error_of_each_trial(spark, synth):
    """Trials read one set of trees under their own limits; training each alone gives the same errors."""
    df = synth.filter("sku_id = 'SKU_001'")
    trials = mf.evaluate_trials(df, ["sku_id"], "sales", FEATURES, SPACE, 5, "forest", row_key=ROW_KEY).collect()
    for t in trials:
        alone = mf.train(
            df, ["sku_id"], "sales", FEATURES, "forest", ROW_KEY, n_estimators=t.n_estimators, max_depth=t.max_depth,
            min_samples_split=t.min_samples_split, min_samples_leaf=t.min_samples_leaf,
        ).first()
        assert alone.rmse == pytest.approx(t.rmse, rel=1e-12)


def test_small_groups_and_faults_keep_their_row(spark):
    rows = [("few", i, float(i), 1.0) for i in range(4)] + [("lost", i, float(i), None) for i in range(20)]
    df = spark.createDataFrame(rows + [("good", i, float(i), float(i)) for i in range(20)], "k string, i long, x double, y double")
    for estimator, space in (("forest", SPACE), ("ridge", None)):
        tuned = {r.k: r for r in mf.tune(df, ["k"], "y", ["x"], space, 3, estimator, row_key=["i"]).collect()}
        assert {k: r.status for k, r in tuned.items()} == {
            "few": "insufficient_data", "lost": "error: missing target", "good": "success"
        }
        parameter = "alpha" if estimator == "ridge" else "n_estimators"
        assert tuned["few"][parameter] is None and tuned["good"][parameter] is not None


def test_guided_search(spark, synth):
    df = synth.filter("sku_id < 'SKU_003'")
    arguments = dict(space=SPACE, estimator="forest", row_key=ROW_KEY)

    def errors(search, num_trials):
        models = mf.tune(df, ["sku_id"], "sales", FEATURES, num_trials=num_trials, search=search, **arguments)
        return {r.sku_id: r.rmse for r in models.collect()}

    start, guided = errors("random", 10), errors("tpe", 12)
    assert all(guided[k] <= start[k] for k in start)
    assert errors("tpe", 12) == guided
    with pytest.raises(ValueError):
        mf.tune(df, ["sku_id"], "sales", FEATURES, estimator="ridge", search="tpe", row_key=ROW_KEY)


def test_guided_proposals_follow_the_good_trials(spark):
    """Where few trees are always best, the proposals gather there."""
    space = {**SPACE, "n_estimators": mf.IntRange(1, 1000)}
    keys = spark.range(40).select(F.format_string("k%d", "id").alias("k"))
    code = KeyCode(keys.schema, ["k"])
    history = mf.trial_plan(keys, ["k"], space, 30).withColumn("rmse", F.col("n_estimators").cast("double"))
    coded = history.select(*code.coded(), "trial", *space, "rmse")
    plan = guided_plan(coded, code, space, 30, 42)
    assert plan.count() == 40 and plan.columns == [*code.names, "trial", *space]
    assert plan.agg(F.min("n_estimators"), F.max("n_estimators")).first()[0] >= 1
    assert plan.agg(F.avg("n_estimators")).first()[0] < 0.5 * history.agg(F.avg("n_estimators")).first()[0]


def test_proposals_in_a_task_are_those_of_the_table(spark):
    """The rule for one key, and the expressions over all keys: equal proposals, missing errors and ties included."""
    space = {**SPACE, "n_estimators": mf.IntRange(50, 300)}
    keys = spark.range(30).select(F.format_string("k%d", "id").alias("k"))
    code = KeyCode(keys.schema, ["k"])
    error = F.when(F.col("trial") % 7 != 3, F.round(F.abs(F.col("n_estimators") - 120) / 40.0))
    history = mf.trial_plan(keys, ["k"], space, 33).withColumn("rmse", error)
    past = history.orderBy("k", "trial").toPandas()
    for trial in (10, 21, 33):
        search = guided.Search(space, range(0))
        so_far = history.filter(F.col("trial") < trial)
        table = {r._k0: r for r in guided_plan(so_far.select(*code.coded(), "trial", *space, "rmse"), code, space, trial, 42).collect()}
        assert len(table) == 30
        for key, rows in past[past["trial"] < trial].groupby("k"):
            tried = {n: rows[n].map(lambda v, n=n: search.code(n, v)).to_numpy() for n in space}
            chosen = search.propose(tried, rows["rmse"].to_numpy(float), key, trial, 42)
            assert {n: None if v != v else v for n, v in chosen.items()} == {n: table[key][n] for n in space}


def test_guided_search_is_the_sequential_one_in_one_job(spark, synth):
    """Trial after trial over the whole table gives the same winners; the search itself needs no job per trial."""
    df = synth.filter("sku_id < 'SKU_003'")
    keys = df.select("sku_id").distinct()
    code = KeyCode(keys.schema, ["sku_id"])
    history = mf.evaluate_trials(df, ["sku_id"], "sales", FEATURES, SPACE, 10, "forest", row_key=ROW_KEY)
    history = history.select(*code.coded(), "trial", *SPACE, "rmse").collect()
    schema = "_k0 string, _kn int, trial long, " + ", ".join(f"{p} long" for p in SPACE) + ", rmse double"
    for trial in (10, 11, 12):
        for r in guided_plan(spark.createDataFrame(history, schema), code, SPACE, trial, 42).collect():
            alone = mf.train(
                df.filter(F.col("sku_id") == r._k0), ["sku_id"], "sales", FEATURES, "forest", ROW_KEY, **{p: r[p] for p in SPACE}
            ).first()
            history.append((r._k0, r._kn, trial, *(r[p] for p in SPACE), alone.rmse))
    best = mf.best_trial(spark.createDataFrame(history, schema), ["_k0"]).collect()

    def search(num_trials):
        spark.sparkContext.setJobGroup(f"trials-{num_trials}", "")
        try:
            models = mf.tune(df, ["sku_id"], "sales", FEATURES, SPACE, num_trials, search="tpe", row_key=ROW_KEY).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return models, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trials-{num_trials}"))

    few, jobs = search(13)
    assert {(r.sku_id, *(r[p] for p in SPACE)) for r in few} == {(r._k0, *(r[p] for p in SPACE)) for r in best}
    assert {r.sku_id: r.rmse for r in few} == pytest.approx({r._k0: r.rmse for r in best}, rel=1e-12)
    assert search(16)[1] == jobs


@pytest.mark.parametrize("rows_per_task", [1000, 30])
def test_many_features(spark, synth, monkeypatch, rows_per_task):
    """Streamed sums give the models that one aggregate per pair of features gives."""
    from manyfold.operators import linear

    def results():
        arguments = dict(row_key=ROW_KEY, rows_per_task=rows_per_task)
        plain = mf.train(synth, ["sku_id"], "sales", FEATURES, "linear", **arguments)
        tuned = mf.tune(synth, ["sku_id"], "sales", FEATURES, estimator="ridge", **arguments)
        return [
            [(r.sku_id, r.status, r.num_rows, round(r.rmse, 8), round(r.mae, 8)) for r in m.orderBy("sku_id").collect()]
            for m in (plain, tuned)
        ]

    pairs = results()
    monkeypatch.setattr(linear, "MANY_FEATURES", 2)
    monkeypatch.setattr("manyfold.operators.tune.MANY_FEATURES", 2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        assert results() == pairs
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("name", ["search_forest", "search_forest_hot"])
def test_whole_searches_against_single_trainings(spark, name):
    """The registered searches over the whole space: what each key won with is in its plan, and trained alone gives the same error."""
    import __spark_entry__ as registered
    from tests.conftest import SMALL

    found = registered.queries()[name](spark, SMALL).collect()
    if name == "search_forest":
        rows, key, target, features, row_key = spark.read.parquet(f"{SMALL}/lineitem.parquet"), "l_partkey", registered.PRICE, registered.LINE_FEATURES, registered.LINE_KEY
    else:
        rows, key, target, features, row_key = registered.events(spark, SMALL), "event_type", "value", ["user_id", "k"], ["event_id"]
    keys = rows.select(key).distinct()
    plan = {(r[key], r.n_estimators, str(r.max_depth or "unlimited"), r.min_samples_split, r.min_samples_leaf) for r in mf.trial_plan(keys, [key], mf.FOREST_SPACE, 10).collect()}
    assert len(found) == keys.count() and {r.status for r in found} == {"success"}
    assert {(r[key], r.n_estimators, r.max_depth, r.min_samples_split, r.min_samples_leaf) for r in found} <= plan
    for won in sorted(found, key=lambda r: str(r[key]))[:3]:
        mine = rows.filter(F.col(key) == F.lit(won[key]))
        errors = {}
        for trial in (t for t in plan if t[0] == won[key]):
            depth = None if trial[2] == "unlimited" else int(trial[2])
            alone = mf.train(mine, [key], target, features, "forest", row_key, n_estimators=trial[1], max_depth=depth, min_samples_split=trial[3], min_samples_leaf=trial[4])
            errors[trial] = alone.first().rmse
        best = min(errors, key=errors.get)
        assert errors[best] == pytest.approx(won.rmse, abs=0.006)
        assert errors[won[key], won.n_estimators, won.max_depth, won.min_samples_split, won.min_samples_leaf] == pytest.approx(errors[best], rel=1e-12)


def test_a_search_grows_no_tree_twice(monkeypatch):
    """Trials, guided rounds and the winner read one set of trees; the result is that of growing them each time."""
    from manyfold.operators import forest

    rng, groups = np.random.default_rng(4), 12
    group = np.repeat(np.arange(groups), 30)
    x = rng.integers(0, 9, (2, len(group))).astype(float)
    y, order_hash = rng.random(len(group)), rng.integers(0, 1 << 60, len(group))
    held = np.tile(np.arange(30) < 6, groups)
    plan = pd.DataFrame(
        {
            "group": np.repeat(np.arange(groups), 10),
            "trial": np.tile(np.arange(10), groups),
            "n_estimators": rng.integers(3, 20, 10 * groups),
            "max_depth": rng.choice([2.0, 4.0, np.nan], 10 * groups),
            "min_samples_split": rng.choice([2, 6], 10 * groups),
            "min_samples_leaf": rng.choice([1, 3], 10 * groups),
            forest.LABEL: np.repeat([f"k{g}" for g in range(groups)], 10),
        }
    )
    space = {
        "n_estimators": mf.IntRange(3, 20),
        "max_depth": mf.Choice(2, 4, None),
        "min_samples_split": mf.Choice(2, 6),
        "min_samples_leaf": mf.Choice(1, 3),
    }
    grown = []
    whole = forest.trees.grow
    monkeypatch.setattr(forest.trees, "grow", lambda unit, *rest: (grown.append(len(np.unique(unit))), whole(unit, *rest))[1])
    for rounds in (range(0), range(10, 14)):
        search, told = guided.Search(space, rounds), []
        for keep in (True, False):
            grown.clear()
            work = forest.BucketFit(group, x, y, order_hash, held, 42, groups)
            if keep:
                work.keep(len(rounds) > 0)
            best, (mse, mae, models) = work.search(plan, search)
            told.append((best.to_dict("list"), list(mse), list(mae), list(models)))
            if keep:
                assert sum(grown) <= 2 * 20 * groups
        np.testing.assert_equal(*told)
    assert sum(grown) > 2 * 20 * groups


def test_a_bucket_keeps_the_trees_of_its_search(monkeypatch):
    """Also a bucket of more groups than fit together is searched without growing a tree twice."""
    import pyarrow as pa

    from manyfold.operators import forest
    from manyfold.operators.tune import FOREST_SPACE

    rng, groups = np.random.default_rng(5), 40
    group = np.repeat(np.arange(groups), 20)
    table = pa.table(
        {
            "k": group, "x0": rng.random(len(group)), "y": rng.random(len(group)),
            forest.ORDER: rng.integers(0, 1 << 60, len(group)), forest.HELD: np.tile(np.arange(20) < 4, groups),
        }
    )
    plan = pa.table(
        {
            "k": np.repeat(np.arange(groups), 2), "trial": np.tile([0, 1], groups), "n_estimators": np.tile([60, 50], groups),
            "max_depth": np.tile([5.0, 10.0], groups), "min_samples_split": np.tile([2, 5], groups),
            "min_samples_leaf": np.tile([1, 1], groups), forest.LABEL: np.repeat([f"k{g}" for g in range(groups)], 2),
        }
    )
    grown = []
    whole = forest.trees.grow
    monkeypatch.setattr(forest.trees, "grow", lambda unit, *rest: (grown.append(len(np.unique(unit))), whole(unit, *rest))[1])

    class Code:
        names = ["k"]

        def fields(self):
            return [T.StructField("k", T.LongType())]

    out = forest.fit_bucket(
        table, plan, ["k"], 1, None, 10, 42, True, forest.result_schema(Code()), guided.Search(FOREST_SPACE, range(0))
    )
    assert out.column("status").to_pylist() == ["success"] * groups
    assert len(grown) > 1 and sum(grown) == 60 * groups


def test_a_proposal_draws_no_more_candidates_than_it_needs(monkeypatch):
    """Of a choice, drawing ends with the first candidate that no value can beat; the proposal is that of all candidates."""
    import hashlib


    drawn, whole = [], guided._number
    monkeypatch.setattr(guided, "_number", lambda *args: drawn.append(1) or whole(*args))
    param, rng = mf.Choice(5, 10, 15, 20, None), np.random.default_rng(1)
    search = guided.Search(mf.FOREST_SPACE, range(10, 15))
    for key in range(60):
        good, rest = (sorted(rng.integers(0, 5, n).tolist()) for n in (1 + key % 3, key % 13))
        head = hashlib.md5(f"42|{key}|12|max_depth".encode())
        share = lambda v, seen: ((np.array(seen) == v).sum() + 1.0 / 5.0) / (len(seen) + 1.0)
        picks = [int(whole(head, f"|{k}|pick".encode()) * (len(good) + 1.0)) for k in range(24)]
        values = [good[p] if p < len(good) else int(whole(head, f"|{k}|any".encode()) * 5.0) for k, p in enumerate(picks)]
        want = values[int(np.argmax([share(v, good) / share(v, rest) for v in values]))]
        assert search._best_choice(param, good, rest, head) == want
    drawn.clear()
    tried = {"n_estimators": rng.integers(50, 300, 12), "max_depth": rng.integers(0, 5, 12), "min_samples_split": rng.integers(0, 3, 12), "min_samples_leaf": rng.integers(0, 3, 12)}
    for key in range(30):
        search.propose({k: v.astype(float) for k, v in tried.items()}, rng.random(12), str(key), 12, 42)
    assert len(drawn) < 30 * 100
