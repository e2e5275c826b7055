from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import manyfold as mf
from manyfold.functions import trees
from tests.conftest import FEATURES, ROW_KEY, SMALL


@pytest.fixture(scope="module")
def models(spark, synth):
    made = {
        e: mf.train(synth, ["sku_id"], "sales", FEATURES, e, ROW_KEY, n_estimators=8).persist() for e in ("linear", "forest")
    }
    return made


def test_small_batch(spark):
    df = mf.synth_groups(spark, 10, 400)
    rows = spark.createDataFrame(
        [("SKU_001", 50.0, 25.0, 10.0), ("SKU_005", 75.0, 30.0, 15.0), ("SKU_010", 90.0, 40.0, 18.0)],
        ["sku_id", *FEATURES],
    )
    want = {"SKU_001": 202.0, "SKU_005": 289.5, "SKU_010": 354.6}
    for estimator, near in (("linear", 12), ("forest", 40)):
        made = mf.train(df, ["sku_id"], "sales", FEATURES, estimator, ROW_KEY)
        scored = mf.score(rows, made, ["sku_id"], estimator).collect()
        assert len(scored) == 3
        for r in scored:
            assert abs(r.prediction - want[r.sku_id]) < near


@pytest.mark.parametrize("estimator", ["linear", "forest"])
def test_hold_out_error_is_the_error_of_scores(spark, synth, models, estimator):
    split = mf.holdout_split(synth, ["sku_id"], "sales", FEATURES, ROW_KEY).filter("is_validation")
    errors = mf.evaluate(mf.score(split, models[estimator], ["sku_id"], estimator), ["sku_id"], "sales")
    found = {r.sku_id: r for r in errors.collect()}
    for r in models[estimator].collect():
        assert found[r.sku_id].rmse == pytest.approx(r.rmse, rel=1e-10)
        assert found[r.sku_id].mae == pytest.approx(r.mae, rel=1e-10)


@pytest.mark.parametrize("estimator", ["linear", "forest"])
def test_columns_and_counts(spark, synth, models, estimator):
    rows = synth.drop("sales").withColumn("other", F.lit("z")).select("other", "feat_3", "sku_id", "feat_1", "feat_2", "row_id")
    scored = mf.score(rows, models[estimator], ["sku_id"], estimator)
    assert scored.columns == [*rows.columns, "prediction"]
    assert scored.count() == rows.count() and scored.filter("prediction is null").count() == 0
    assert scored.drop("prediction").exceptAll(rows).count() == 0


@pytest.mark.parametrize("estimator", ["linear", "forest"])
def test_unknown_keys(spark, synth, models, estimator):
    rows = synth.withColumn("sku_id", F.when(F.col("row_id") == 3, F.lit(None)).when(F.col("row_id") == 4, "new").otherwise(F.col("sku_id")))
    with pytest.raises(Exception, match="no successful model"):
        mf.score(rows, models[estimator], ["sku_id"], estimator).collect()
    scored = mf.score(rows, models[estimator], ["sku_id"], estimator, "null")
    assert scored.count() == rows.count()
    assert scored.filter("prediction is null").count() == 12
    assert {r.sku_id for r in mf.unknown_keys(rows, models[estimator], ["sku_id"]).collect()} == {None, "new"}


def test_failed_models_are_unknown(spark):
    df = spark.createDataFrame([("few", i, float(i), 1.0) for i in range(3)], "k string, i long, x double, y double")
    made = mf.train(df, ["k"], "y", ["x"], "linear", ["i"])
    assert mf.unknown_keys(df, made, ["k"]).count() == 1


def test_missing_column_stops_before_any_row(spark, synth, models):
    with pytest.raises(ValueError, match="feat_2"):
        mf.score(synth.drop("feat_2"), models["linear"], ["sku_id"], "linear")
    with pytest.raises(ValueError, match="is bigint in the rows"):
        mf.score(synth.withColumn("sku_id", F.lit(1).cast("long")), models["linear"], ["sku_id"], "linear")


@pytest.mark.parametrize("estimator", ["linear", "forest"])
def test_missing_values_score_as_zero(spark, models, estimator):
    rows = [("SKU_001", None, 20.0, 5.0), ("SKU_001", float("nan"), 20.0, 5.0), ("SKU_001", 0.0, 20.0, 5.0)]
    df = spark.createDataFrame(rows, "sku_id string, feat_1 double, feat_2 double, feat_3 double")
    values = {r.prediction for r in mf.score(df, models[estimator], ["sku_id"], estimator).collect()}
    assert len(values) == 1


@pytest.mark.parametrize("estimator", ["linear", "forest"])
def test_models_keep_their_own_feature_order(spark, synth, models, estimator):
    """Half of the models were trained on other features in another order."""
    other = mf.train(synth, ["sku_id"], "sales", ["feat_3", "feat_1"], estimator, ROW_KEY, n_estimators=8)
    early = F.col("sku_id") < "SKU_004"
    mixed = models[estimator].filter(early).unionByName(other.filter(~early))
    scored = mf.score(synth, mixed, ["sku_id"], estimator)
    alone = mf.score(synth, models[estimator], ["sku_id"], estimator).filter(early).unionByName(
        mf.score(synth, other, ["sku_id"], estimator).filter(~early)
    )
    for frame in (scored, alone):
        assert frame.count() == synth.count()
    joined = scored.join(alone.select(*ROW_KEY, F.col("prediction").alias("want")), ROW_KEY)
    assert joined.filter(F.abs(F.col("prediction") - F.col("want")) > 1e-9).count() == 0


def test_forest_scores_by_hand(spark, synth, models):
    row = synth.filter("sku_id = 'SKU_002'").first()
    feature, number, left, roots = trees.unpack(models["forest"].filter("sku_id = 'SKU_002'").first().model_bytes)
    values = []
    for at in roots:
        while feature[at] >= 0:
            at = left[at] + int(row[FEATURES[feature[at]]] > number[at])
        values.append(number[at])
    scored = mf.score(synth, models["forest"], ["sku_id"]).filter(
        (F.col("sku_id") == "SKU_002") & (F.col("row_id") == row.row_id)
    )
    assert scored.first().prediction == pytest.approx(np.mean(values), rel=1e-12)


def test_hot_rows_and_copies(spark, synth, models):
    """A key with a third of the rows, most of them equal, is scored by many tasks; no copy is lost."""
    copies = synth.filter("sku_id = 'SKU_001' and row_id = 1").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n")
    rows = synth.unionByName(copies)
    for estimator in ("linear", "forest"):
        whole = mf.score(rows, models[estimator], ["sku_id"], estimator)
        dealt = mf.score(rows, models[estimator], ["sku_id"], estimator, rows_per_task=50)
        assert whole.count() == rows.count() == dealt.count()
        assert whole.exceptAll(dealt).count() == 0


def test_many_batches_of_one_key(spark, synth, models):
    """A group longer than an Arrow batch goes on with the model of the batch before."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = mf.score(synth, models["forest"], ["sku_id"]).orderBy(*ROW_KEY).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert mf.score(synth, models["forest"], ["sku_id"]).orderBy(*ROW_KEY).collect() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_evaluate_skips_rows_without_truth(spark):
    rows = [("a", 1.0, 2.0), ("a", None, 2.0), ("a", 3.0, None)]
    errors = mf.evaluate(spark.createDataFrame(rows, "k string, y double, prediction double"), ["k"], "y").first()
    assert errors.num_scored == 1 and errors.mse == 1.0


def test_any_column_passes_through_a_hot_key(spark, synth, models):
    rows = synth.withColumns(
        {
            "tags": F.create_map(F.lit("a"), F.col("row_id")),
            "list": F.array("feat_1"),
            "when": F.lit("2024-01-01").cast("timestamp"),
            "a name": F.lit(1),
        }
    )
    scored = mf.score(rows, models["forest"], ["sku_id"], rows_per_task=30)
    assert [f.dataType for f in scored.schema.fields[:-1]] == [f.dataType for f in rows.schema.fields]
    assert scored.count() == rows.count() and scored.filter("tags['a'] <> row_id").count() == 0


@pytest.mark.parametrize("estimator", ["linear", "forest"])
def test_contracts_hold_without_a_look_at_the_prediction(spark, synth, models, estimator):
    """They hold when features are named, and when nothing but a count is asked for."""
    made = models[estimator]
    with pytest.raises(Exception, match="feat_3"):
        mf.score(synth, made, ["sku_id"], estimator, features=FEATURES[:2]).count()
    with pytest.raises(Exception, match="no successful model"):
        mf.score(synth.withColumn("sku_id", F.lit("new")), made, ["sku_id"], estimator, features=FEATURES).count()
    with pytest.raises(Exception, match="more than one model"):
        mf.score(synth, made.union(made), ["sku_id"], estimator, features=FEATURES).count()
    gap = synth.withColumn("feat_1", F.when(F.col("row_id") > 2, F.col("feat_1")))
    empty = mf.score(gap, made, ["sku_id"], estimator, fill=None).filter("prediction is null")
    assert empty.count() == gap.filter("feat_1 is null").count() > 0


def skewed(spark, synth):
    """One key in nine of ten rows, a null key and one without a model among the others."""
    some = synth.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("sku_id") == "SKU_003", 45).otherwise(1))))
    key = F.when((F.col("row_id") == 3) & (F.col("sku_id") == "SKU_001"), F.lit(None)).when((F.col("row_id") == 4) & (F.col("sku_id") == "SKU_002"), "new")
    return some.withColumn("sku_id", F.coalesce(key, F.when(~((F.col("row_id") == 3) & (F.col("sku_id") == "SKU_001")), F.col("sku_id"))))


@pytest.fixture
def by_shuffle(spark):
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_keys_are_salted(spark, synth, models, by_shuffle):
    rows = skewed(spark, synth)
    plain = mf.score(rows, models["linear"], ["sku_id"], "linear", "null")
    salted = mf.score(rows, models["linear"], ["sku_id"], "linear", "null", salt_hot=True)
    assert salted.columns == plain.columns and salted.count() == rows.count()
    assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()
    with pytest.raises(Exception, match="no successful model"):
        mf.score(rows, models["linear"], ["sku_id"], "linear", salt_hot=True).collect()
    sizes = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    assert sizes(plain)[-1] > 0.9 * rows.count()
    assert len(sizes(salted)) == 8 and sizes(salted)[-1] <= 2 * sizes(salted)[4]


def test_zeros_of_both_signs_and_nan_are_salted_alike(spark, by_shuffle):
    schema = "k double, i long, x double, y double"
    train = [(k, i, float(i % 7), 2.0 * (i % 7) + b) for b, k in ((1, 0.0), (5, float("nan"))) for i in range(40)]
    made = mf.train(spark.createDataFrame(train, schema), ["k"], "y", ["x"], "linear", ["i"])
    rows = spark.createDataFrame([(k, i, 1.0, None) for k in (0.0, -0.0, float("nan")) for i in range(50)], schema)
    got = mf.score(rows, made, ["k"], "linear", salt_hot=True).groupBy(F.round("prediction", 6).alias("p")).count().collect()
    assert {(r.p, r["count"]) for r in got} == {(3.0, 100), (7.0, 50)}


def test_a_stream_with_a_hot_key(spark, synth, models, tmp_path):
    rows = skewed(spark, synth)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    mf.write_scores(stream, models["linear"], ["sku_id"], str(tmp_path / "out"), str(tmp_path / "log"), once=True, salt_hot=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = mf.score(rows, models["linear"], ["sku_id"], "linear", "null")
    assert got.count() == want.count() and want.exceptAll(got.select(want.columns)).isEmpty()


@pytest.mark.parametrize("name", ["score_linear", "evaluate_scores", "score_checked", "score_forest", "score_small_batch"])
def test_a_part_too_small_for_a_model_does_not_stop_a_query(spark, tmp_path, name):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").filter("l_partkey <= 4")
    example = mf.input_example(lines, registered.PRICE, registered.LINE_KEY, 5).select("l_partkey").first().l_partkey
    few = lines.filter(F.col("l_partkey") == example).orderBy(*registered.LINE_KEY).limit(4)
    lines.filter(F.col("l_partkey") != example).unionByName(few).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    result = registered.queries()[name](spark, str(tmp_path))
    got = result.collect()
    answer = duck.execute(registered.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    want = answer.fetchall()
    assert want and sorted(map(repr, (tuple(r[c] for c in columns) for r in got))) == sorted(map(repr, want))


@pytest.mark.parametrize("estimator", ["linear", "forest"])
def test_unseen_keys_stop_a_job_that_small_ones_do_not(spark, synth, estimator):
    few = synth.filter((F.col("sku_id") != "SKU_002") | (F.col("row_id") < 5))
    made = mf.train(few, ["sku_id"], "sales", FEATURES, estimator, ROW_KEY, n_estimators=3).persist()
    scored = mf.score(few, made, ["sku_id"], estimator, "unseen")
    assert scored.count() == few.count()
    assert {r.sku_id for r in scored.filter("prediction is null").collect()} == {"SKU_002"}
    assert scored.filter("prediction is null").count() == 5
    new = few.withColumn("sku_id", F.when(F.col("row_id") == 4, "new").otherwise(F.col("sku_id")))
    with pytest.raises(Exception, match="model"):
        mf.score(new, made, ["sku_id"], estimator, "unseen").collect()


def test_a_model_is_copied_to_few_shares_and_read_in_pieces(spark, synth, models, monkeypatch):
    """The copies of a hot key's model depend on the cores, not on how small ``rows_per_task`` is."""
    from manyfold.operators import forest_score

    copies, whole = [], forest_score.replicated
    monkeypatch.setattr(forest_score, "replicated", lambda told, parts: copies.append(whole(told, parts).select("_salt").distinct().count()) or whole(told, parts))
    rows = spark.range(40).crossJoin(synth).drop("id", "sales")
    want = mf.score(rows, models["forest"], ["sku_id"])
    got = mf.score(rows, models["forest"], ["sku_id"], rows_per_task=5)
    assert copies[0] <= 2 * spark.sparkContext.defaultParallelism
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 40 * synth.count()
    schema = models["forest"].select("model_bytes").withColumn("piece", F.lit(0)).schema
    monkeypatch.setattr(forest_score, "PIECE_NODES", 40)
    body = models["forest"].first().model_bytes
    parts = list(forest_score.model_pieces("model_bytes", "piece", schema)([pa.RecordBatch.from_pydict({"model_bytes": [bytes(body)]})]))
    forests = [trees.unpack(p.column(0)[0].as_py()) for p in parts]
    assert len(parts) > 1 and sum(len(f[3]) for f in forests) == 8
    assert np.array_equal(np.concatenate([f[1] for f in forests]), trees.unpack(bytes(body))[1])


def test_shares_of_a_hot_key_have_one_model_between_them(spark, monkeypatch):
    """A share had a whole copy of a model that grows with the rows, as the number of shares does."""
    from manyfold.operators import forest_score

    copied, whole = [], forest_score.replicated

    def watched(told, shares):
        copies = whole(told, shares)
        copied.append(copies.agg(F.sum(F.length("model_bytes"))).first()[0])
        return copies

    monkeypatch.setattr(forest_score, "replicated", watched)
    noise = F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double")
    rows = spark.range(4000).select(F.lit("a").alias("k"), "id", noise.alias("y"), (F.col("id") % 1999).cast("double").alias("u"), F.pmod(F.hash("id"), F.lit(50)).cast("double").alias("v"))
    models = mf.train(rows, ["k"], "y", ["u", "v"], "forest", ["id"], n_estimators=6).persist()
    asked = rows.withColumn("u", F.when(F.col("id") % 997 != 0, F.col("u")).when(F.col("id") % 2 == 0, F.lit(float("nan")))).drop("y")
    for fill in (0.0, None):
        want = mf.score(asked, models, ["k"], fill=fill)
        got = mf.score(asked, models, ["k"], fill=fill, rows_per_task=500)
        assert got.count() == 4000 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    size = len(models.first().model_bytes)
    assert len(copied) == 2 and max(copied) < 1.5 * size


def test_equal_rows_and_one_value_make_whole_shares(spark):
    """Features that tell no rows apart leave the content to deal them, and each copy a leaf per tree."""
    rows = spark.range(600).select(F.lit("a").alias("k"), "id", (F.col("id") % 7).cast("double").alias("y"), F.lit(3.0).alias("x"))
    learned = rows.withColumn("x", F.col("id").cast("double"))
    models = mf.train(learned, ["k"], "y", ["x"], "forest", ["id"], n_estimators=4).persist()
    for asked in (rows.drop("y"), rows.select("k", "x")):
        want = mf.score(asked, models, ["k"])
        got = mf.score(asked, models, ["k"], rows_per_task=20)
        assert got.count() == 600 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_a_copy_of_a_model_ends_its_rows_in_the_same_leaves():
    from manyfold.operators.forest_score import shipped, unshipped, within

    # Two trees over two features: the first splits on both, the second is one leaf.
    feature, left, roots = np.array([0, -1, 1, -1, -1, -1]), np.array([1, -1, 3, -1, -1, -1]), np.array([0, 5])
    number = np.array([2.0, 10.0, 0.5, 20.0, 30.0, 7.0])
    for low, high in (([0, 0], [5, 1]), ([3, 0], [5, 0.2]), ([0, 0], [2, 1]), ([4, 1], [4, 1])):
        x = np.array([np.linspace(a, b, 9) for a, b in zip(low, high)])
        ours = unshipped(shipped(*within(feature, number, left, roots, np.array(low), np.array(high)), 2))
        for tree in range(2):
            rows = np.arange(9)
            want = number[trees.walk(feature, number, left, np.full(9, roots[tree]), rows, x)]
            assert (ours[1][trees.walk(*ours[:3], np.full(9, ours[3][tree]), rows, x)] == want).all()
    assert len(ours[0]) == 2 and ours[1].tolist() == [30.0, 7.0]


def test_a_forest_in_pieces_is_scored_as_it_is(spark, monkeypatch):
    """Scoring needs no cell of a large forest, wherever its rows are many or few, and knows keys without a model."""
    from manyfold.operators import forest_wide
    from manyfold.sources import pieces

    noise = F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double")
    rows = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.lit("a")).when(F.col("id") < 540, F.lit("b")).otherwise(F.lit("c")).alias("k"), "id", noise.alias("y"), (F.col("id") % 199).cast("double").alias("x"))
    rows = rows.withColumn("y", F.when(F.col("k") != "c", F.col("y")))
    monkeypatch.setattr(forest_wide, "PIECE_ROWS", 400)
    cold, hot = (mf.train(rows, ["k"], "y", ["x"], "forest", ["id"], n_estimators=5, rows_per_task=n) for n in (1000, 190))
    monkeypatch.setattr(pieces.trees, "join", None)
    for on_unknown, asked in (("error", rows.filter("k <> 'c'")), ("unseen", rows), ("null", rows.unionByName(rows.limit(3).withColumn("k", F.lit("new"))))):
        asked = asked.drop("y").unionByName(asked.drop("y").filter("id < 9"))
        want = mf.score(asked, cold, ["k"], "forest", on_unknown)
        for size in (1_000_000, 150)[: 1 + (on_unknown == "unseen")]:
            got = mf.score(asked, hot, ["k"], "forest", on_unknown, rows_per_task=size)
            assert got.count() == asked.count() and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    with pytest.raises(Exception, match="model"):
        mf.score(rows.drop("y").withColumn("k", F.lit("new")), hot, ["k"], "forest", "unseen").collect()


def test_a_forest_travels_with_each_number_once(spark, synth, models, monkeypatch):
    """Models were shuffled as they are stored, with 16 bytes a node."""
    from manyfold.operators import forest_score
    from manyfold.operators.forest_score import closed, opened

    noise = F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double")
    rows = spark.range(600).select((F.col("id") % 20).alias("k"), "id", noise.alias("y"), (F.col("id") % 17).cast("double").alias("x"))
    small = mf.train(rows, ["k"], "y", ["x"], "forest", ["id"], n_estimators=50)
    bodies = [bytes(r.model_bytes) for r in small.collect()]
    assert sum(len(closed(b)) for b in bodies) < sum(map(len, bodies)) / 5
    odd = [
        trees.pack(np.array([0, -1, -1]), np.array([0.5, -0.0, 0.0]), np.array([1, -1, -1]), [0]),
        trees.pack(np.array([-1, 0, -1, -1]), np.array([np.nan, 1.0, np.inf, -np.inf]), np.array([-1, 2, -1, -1]), [0, 1]),
        trees.pack(np.array([-1, -1, 0]), np.array([1.0, 2.0, 0.5]), np.array([-1, -1, 0]), [2]),
        trees.pack(np.array([300, -1, -1]), np.array([0.5, 1.0, 2.0]), np.array([1, -1, -1]), [0]),
        trees.pack(np.zeros(0), np.zeros(0), np.zeros(0), []),
        trees.pack(np.full(70_000, -1), np.arange(70_000) / 7, np.full(70_000, -1), np.arange(70_000)),
    ]
    for data in [*bodies, *odd]:
        assert trees.pack(*opened(closed(data))) == data
    monkeypatch.setattr(forest_score, "LISTED_NODES", 2)
    assert all(trees.pack(*opened(closed(data))) == data for data in [bodies[0], *odd])
    monkeypatch.undo()
    plan = mf.score(synth.drop("sales"), models["forest"], ["sku_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
