from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

import manyfold as mf
from manyfold.sources.registry import latest_versions, runs, versions
from manyfold.sources.settled import settle, shared_folder
from tests.conftest import FEATURES, ROW_KEY


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    made = mf.init_namespace(spark, "forecasts", str(tmp_path_factory.mktemp("forecasts")))
    yield made
    spark.sql("USE default")


@pytest.fixture(scope="module")
def trained(spark, synth):
    few = spark.createDataFrame([("few", i, 1.0, 1.0, 1.0, 1.0) for i in range(3)], synth.schema)
    return mf.train(synth.unionByName(few), ["sku_id"], "sales", FEATURES, "linear", ROW_KEY).persist()


def test_model_table(spark, space, trained):
    table = space.table("models")
    mf.write_models(trained, table)
    stored = mf.read_models(spark, table)
    assert stored.drop("model_size_bytes").exceptAll(trained).count() == 0 and stored.count() == 7
    review = mf.review_models(stored, ["sku_id"])
    plan = review._jdf.queryExecution().executedPlan().toString()
    assert "model_bytes" not in plan.split("ReadSchema")[1]  # the size is read, the models are not
    good = mf.successful(stored)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,success)" in good
    # A second write replaces the first, also with other columns.
    mf.write_models(trained.withColumn("alpha", F.lit(1.0)), table, ["sku_id"], buckets=4)
    assert "alpha" in mf.read_models(spark, table).columns and mf.read_models(spark, table).count() == 7


def test_outcome(trained):
    assert {r.outcome: (r.num_models, r.num_rows) for r in mf.status_summary(trained).collect()} == {
        "success": (6, 480),
        "insufficient_data": (1, 3),
    }
    averages = mf.run_metrics(trained, 10).first()
    assert averages.num_keys == 6 and averages.num_failed == 1 and averages.trials_per_key == 10
    none = mf.run_metrics(trained.filter("status <> 'success'")).first()
    assert none.avg_rmse is None and none.num_keys == 0 and none.num_failed == 1


def test_bundle(spark, space, synth, trained):
    path = space.artifact("bundle")
    kept = mf.bundle(trained, ["sku_id"], path)
    assert kept.count() == 6
    stats = mf.bundle_stats(kept).first()
    assert stats.num_models == 6 and stats.size_bytes == kept.agg(F.sum(F.length("model_bytes"))).first()[0]
    loaded = mf.load_bundle(spark, path)
    assert mf.score(synth, loaded, ["sku_id"], "linear").exceptAll(mf.score(synth, trained, ["sku_id"], "linear")).count() == 0
    assert mf.bundle_stats(kept.limit(0)).first().size_bytes == 0


def test_a_bundle_keeps_large_forests_in_pieces(spark, space, synth, monkeypatch):
    """A bundle wrote the forest of a large group as one cell; now the cell is made only for who reads it."""
    from manyfold.operators import forest_wide

    monkeypatch.setattr(forest_wide, "PIECE_ROWS", 160)
    few = spark.createDataFrame([("few", i, 1.0, 1.0, 1.0, 1.0) for i in range(3)], synth.schema)
    null = synth.filter("sku_id = 'SKU_001'").withColumn("sku_id", F.lit(None).cast("string"))
    some = synth.filter("sku_id <> 'SKU_002' or row_id < 30").unionByName(few).unionByName(null)
    cold, hot = (mf.train(some, ["sku_id"], "sales", FEATURES, "forest", ROW_KEY, n_estimators=6, rows_per_task=n) for n in (1000, 50))
    path = space.artifact("pieces")
    told = lambda bundled: {r.sku_id: tuple(r) for r in bundled.select("sku_id", F.col("model_bytes"), "feature_names", "model_size_bytes").collect()}
    want = told(mf.bundle(cold, ["sku_id"], space.artifact("cells")))
    kept = mf.bundle(hot, ["sku_id"], path)
    stored = spark.read.parquet(path)
    assert {r.sku_id for r in stored.filter("model_bytes is not null").collect()} == {"SKU_002"}
    assert {r.sku_id: r.model_size_bytes for r in stored.collect()} == {k: v[3] for k, v in want.items()}
    assert spark.read.parquet(f"{path}/_pieces").count() == 6 * 3
    loaded = mf.load_bundle(spark, path)
    assert told(kept) == told(loaded) == want and len(want) == 7
    assert mf.bundle_stats(kept).first() == mf.bundle_stats(loaded).first() and mf.bundle_stats(kept).first().num_models == 7
    rows = some.filter("sku_id is null or sku_id <> 'few'").drop("sales")
    expected = mf.score(rows, cold, ["sku_id"])
    for models in (loaded, hot):
        got = mf.score(rows, models, ["sku_id"])
        assert got.count() == rows.count() and got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0
    mf.bundle(cold, ["sku_id"], path)
    assert told(mf.load_bundle(spark, path)) == want


def test_metrics_file(spark, space, trained):
    path = space.artifact("metrics")
    mf.write_metrics(trained, ["sku_id"], path)
    back = spark.read.csv(path, header=True, inferSchema=True)
    assert back.columns == ["sku_id", "rmse", "mse", "mae", "num_rows"]
    want = {r.sku_id: (r.rmse, r.mse, r.mae, r.num_rows) for r in mf.successful(trained).collect()}
    assert {r.sku_id: (r.rmse, r.mse, r.mae, r.num_rows) for r in back.collect()} == want


def test_runs_and_versions(spark, space, synth):
    first = mf.train_and_publish(space, "sales_model", synth, ["sku_id"], "sales", ROW_KEY, features=FEATURES, estimator="linear")
    space_of = {"alpha": mf.Choice(0.1, 1.0)}
    second = mf.tune_and_publish(
        space, "sales_model", synth, ["sku_id"], "sales", ROW_KEY, 4, features=FEATURES, estimator="ridge", space=space_of
    )
    forest = mf.train_and_publish(space, "sales_forest", synth, ["sku_id"], "sales", ROW_KEY, features=FEATURES, n_estimators=3)
    assert (first.version, second.version, forest.version) == (1, 2, 1)
    assert versions(spark, space).count() == 3
    newest = {r.name: (r.version, r.run_id) for r in latest_versions(spark, space).collect()}
    assert newest == {"sales_model": (2, second.run_id), "sales_forest": (1, forest.run_id)}
    run = runs(spark, space).filter(F.col("run_id") == second.run_id).first()
    assert run.metrics["trials_per_key"] == 4 and run.metrics["num_keys"] == 6 and len(run.input_example) == 5
    assert all("sales" not in json.loads(row) for row in run.input_example)
    # An old version stays what it was.
    again = mf.load_version(spark, space, "sales_model", 1)
    assert again.run_id == first.run_id and again.estimator == "linear"
    assert mf.load_version(spark, space, "sales_model").version == 2
    assert again.score(synth).exceptAll(first.score(synth)).count() == 0
    assert mf.load_version(spark, space, "sales_forest").score(synth).filter("prediction is null").count() == 0
    with pytest.raises(KeyError):
        mf.load_version(spark, space, "sales_model", 9)
    with pytest.raises(KeyError):
        mf.register(spark, space, "sales_model", "no such run")


def test_read_features(spark, space, synth):
    synth.write.mode("overwrite").saveAsTable(space.table("features"))
    assert mf.read_features(spark, space.table("features"), ["sku_id", "feat_1"]).columns == ["sku_id", "feat_1"]
    with pytest.raises(ValueError):
        mf.read_features(spark, space.table("features"), ["feat_9"])


def test_settled_tables_lie_in_the_shared_folder(spark, synth):
    kept = settle(synth, "here")
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert kept.inputFiles()[0].removeprefix("file:").removeprefix("//").startswith(shared_folder(spark))
    assert kept.exceptAll(synth).count() == 0


def test_a_settled_step_keeps_no_shuffle(spark, synth):
    """Shuffle files of every step stayed until the driver collected its garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    before, turned = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    frame = synth.repartition(5, "row_id").groupBy("row_id").agg(F.max("sales").alias("top"))
    once, again = settle(frame), settle(frame)
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == turned
    assert once.exceptAll(again).count() == 0 and once.count() == frame.count()


def test_schemas(spark, trained, synth):
    schema = mf.model_schema(synth.schema, ["sku_id"])
    assert [f.name for f in schema] == ["sku_id", "model_bytes", "feature_names", "rmse", "mse", "mae", "num_rows", "status"]
    assert all(f.nullable for f in schema) and [f.dataType for f in trained.schema] == [f.dataType for f in schema]
    tuned = mf.tuned_schema(synth.schema, ["sku_id"])
    assert [f.name for f in tuned][7:] == ["n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "status"]
    mixed = trained.select("status", "num_rows", *[c for c in trained.columns if c not in ("status", "num_rows")])
    assert mf.conform(mixed, schema).columns == schema.names


def test_synthetic_groups(spark):
    df = mf.synth_groups(spark, 10, 100)
    assert df.count() == 1000 and df.select("sku_id").distinct().count() == 10
    low, high = df.agg(F.min("feat_2"), F.max("feat_2")).first()
    assert 5 <= low < 6 and 49 < high <= 50 and df.filter("sales < 0").count() == 0
    noise = df.select((F.col("sales") - 2.5 * F.col("feat_1") - 1.8 * F.col("feat_2") - 3.2 * F.col("feat_3")).alias("e"))
    mean, spread = noise.agg(F.avg("e"), F.stddev("e")).first()
    assert abs(mean) < 2.5 and 18.5 < spread < 21.5
    assert df.exceptAll(mf.synth_groups(spark, 10, 100).repartition(3)).count() == 0


@pytest.mark.parametrize("estimator", ["linear", "forest"])
def test_stream_equals_batch(spark, synth, tmp_path, estimator):
    models = mf.train(synth, ["sku_id"], "sales", FEATURES, estimator, ROW_KEY, n_estimators=3).persist()
    rows = synth.withColumn("sku_id", F.when(F.col("row_id") == 0, "new").otherwise(F.col("sku_id")))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    mf.write_scores(stream, models, ["sku_id"], out, state, estimator, once=True).awaitTermination()
    got = spark.read.schema(mf.score(rows, models, ["sku_id"], estimator, "null").schema).parquet(
        out if estimator == "linear" else f"{out}/*"
    )
    want = mf.score(rows, models, ["sku_id"], estimator, "null")
    assert got.count() == want.count() == 480
    assert want.exceptAll(got).count() == 0 and got.filter("prediction is null").count() == 6
    with pytest.raises(ValueError):
        mf.score_stream(rows, models, ["sku_id"])


def test_a_stream_takes_large_forests_in_pieces(spark, synth, tmp_path, monkeypatch):
    """The stored models of a stream had the forest of a large group as one cell."""
    from manyfold.operators import forest_score, forest_wide
    from manyfold.sources.pieces import PIECE

    monkeypatch.setattr(forest_wide, "PIECE_ROWS", 80)
    taken, whole = [], forest_score.route_shares
    monkeypatch.setattr(forest_score, "route_shares", lambda rows, pieces, *a: taken.append(pieces.filter(f"{PIECE} > 0").count()) or whole(rows, pieces, *a))
    hot = mf.train(synth, ["sku_id"], "sales", FEATURES, "forest", ROW_KEY, n_estimators=3, rows_per_task=50)
    rows = synth.withColumn("sku_id", F.when(F.col("row_id") == 0, "new").otherwise(F.col("sku_id"))).drop("sales")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    mf.write_scores(stream, hot, ["sku_id"], out, state, "forest", once=True).awaitTermination()
    assert len(taken) == 3 and set(taken) == {12}
    want = mf.score(rows, mf.train(synth, ["sku_id"], "sales", FEATURES, "forest", ROW_KEY, n_estimators=3), ["sku_id"], "forest", "null")
    got = spark.read.schema(want.schema).parquet(f"{out}/*")
    assert got.count() == 480 and want.exceptAll(got).count() == got.exceptAll(want).count() == 0


def test_several_writers_get_a_number_each(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from manyfold.sources import registry

    space = mf.init_namespace(spark, "writers", str(tmp_path / "writers"))
    spark.catalog.setCurrentDatabase("default")
    models = spark.createDataFrame([("a", 1.0, 1.0, 1.0, "success")], "k string, rmse double, mse double, mae double, status string")
    run_id = registry.log_run(space, "run", models, ["k"], "linear", "nowhere", "nowhere")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: registry.register(spark, space, "a/b c", run_id), range(8)))
    assert sorted(numbers) == list(range(1, 9))
    assert registry.register(spark, space, "other", run_id) == 1
    newest = {r.name: r.version for r in registry.latest_versions(spark, space).collect()}
    assert newest == {"a/b c": 8, "other": 1}
