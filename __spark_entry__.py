"""The registered queries of the engine and the SQL each of them must agree with."""

from __future__ import annotations

import functools
import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import manyfold as mf  # noqa: E402
import oracles as o  # noqa: E402
from manyfold.functions.keys import KeyCode  # noqa: E402
from manyfold.operators.forest_tune import guided_plan  # noqa: E402
from manyfold.operators.linear import MODEL_JSON  # noqa: E402
from manyfold.functions.features import infer_features  # noqa: E402
from manyfold.sources.registry import latest_versions, runs  # noqa: E402
from manyfold.sources.settled import settle, shared_folder  # noqa: E402
from manyfold.sources.shipping import ship  # noqa: E402

try:
    import corpus_pipeline
    from manyfold.llm import queries as text_queries
except ImportError as missing:
    # Only the absence of the subpackage itself is passed over.
    if not (missing.name or "").startswith(("manyfold.llm", "corpus_pipeline")):
        raise
    text_queries = None

LINE_KEY = ["l_orderkey", "l_linenumber", "l_suppkey"]
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]
PRICE = "l_extendedprice"
# A mean of few absolute errors can end in a five exactly, so it is rounded where that cannot matter.
MAE_PLACES = 5
# Errors of forests are such means of whole cents throughout, so they are moved off the fives before they are rounded.
OFF_FIVES = 3.7e-8
ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]
SMALL_FOREST = {
    "n_estimators": mf.IntRange(5, 12),
    "max_depth": mf.Choice(3, 5, None),
    "min_samples_split": mf.Choice(2, 5, 10),
    "min_samples_leaf": mf.Choice(1, 2, 4),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with two numeric features: the day of the order and its priority."""
    return table(spark, folder, "orders").withColumns(
        {
            "order_day": F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double"),
            "priority": F.substring("o_orderpriority", 1, 1).cast("double"),
        }
    )


ORDERS_SQL = (
    "(SELECT *, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS order_day, "
    "substr(o_orderpriority, 1, 1)::DOUBLE AS priority FROM orders)"
)


def with_props(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("double"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return with_props(table(spark, folder, "events"))


EVENTS_SQL = "(SELECT *, regexp_extract(props, '[0-9]+')::DOUBLE AS k FROM events)"


def places(column, n: int):
    return F.round(column, n) + F.lit(0.0)


def listing(models: DataFrame, keys: list[str], features: list[str], chosen: list[str] = ()) -> DataFrame:
    """A linear model table in readable numbers."""
    body = F.from_json(F.decode("model_bytes", "UTF-8"), MODEL_JSON)
    parsed = models.withColumn("m", body)
    return parsed.select(
        *keys,
        "num_rows",
        "status",
        places(F.col("rmse"), 2).alias("rmse"),
        places(F.col("mse"), 0).alias("mse"),
        places(F.col("mae"), MAE_PLACES).alias("mae"),
        places(F.col("m.intercept"), 2).alias("intercept"),
        *[places(F.col("m.coefficients")[i], 4).alias(f"w{i}") for i in range(len(features))],
        *chosen,
    )


def line_models(spark, folder, features=None, **settings) -> DataFrame:
    settings.setdefault("estimator", "linear")
    lines = table(spark, folder, "lineitem")
    return mf.train(lines, ["l_partkey"], PRICE, features or LINE_FEATURES, row_key=LINE_KEY, **settings)


def customer_models(spark, folder) -> DataFrame:
    """Nearly half of the customers have fewer than ten orders."""
    return mf.train(orders(spark, folder), ["o_custkey"], "o_totalprice", ["order_day"], "linear", ["o_orderkey"])


def train_linear_1f(spark, folder):
    return listing(line_models(spark, folder, ["l_quantity"]), ["l_partkey"], ["l_quantity"])


def train_linear_3f(spark, folder):
    return listing(line_models(spark, folder), ["l_partkey"], LINE_FEATURES)


def group_profile(spark, folder):
    return mf.profile_groups(table(spark, folder, "lineitem"), ["l_partkey"])


def group_profile_small(spark, folder):
    return mf.profile_groups(table(spark, folder, "orders"), ["o_custkey"])


def group_size_histogram(spark, folder):
    return mf.group_size_histogram(table(spark, folder, "orders"), ["o_custkey"])


def holdout_split(spark, folder):
    return mf.holdout_split(table(spark, folder, "lineitem"), ["l_partkey"], PRICE, LINE_FEATURES, LINE_KEY)


def holdout_split_hot(spark, folder):
    """Every group is above the size of one task, so no window ranks its rows."""
    return mf.holdout_split(events(spark, folder), ["event_type"], "value", ["user_id", "k"], ["event_id"], rows_per_task=400)


def null_fill(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("l_discount", F.expr("nullif(l_discount, 0)"))
    kept = lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_tax")
    return mf.prepare_features(kept, ["l_discount", "l_tax"])


def train_small_groups(spark, folder):
    return listing(customer_models(spark, folder), ["o_custkey"], ["order_day"])


def train_composite_key(spark, folder):
    keys = ["l_returnflag", "l_linestatus"]
    lines = table(spark, folder, "lineitem")
    return listing(mf.train(lines, keys, PRICE, LINE_FEATURES, "linear", [*LINE_KEY, "l_partkey"]), keys, LINE_FEATURES)


def train_null_key(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("flag", F.expr("nullif(l_returnflag, 'R')"))
    keys = ["flag", "l_linestatus"]
    return listing(mf.train(lines, keys, PRICE, LINE_FEATURES, "linear", [*LINE_KEY, "l_partkey"]), keys, LINE_FEATURES)


def train_missing_target(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("wanted", F.expr("nullif(l_quantity, 50)"))
    models = mf.train(lines, ["l_partkey"], "wanted", ["l_discount"], "linear", LINE_KEY)
    return listing(models, ["l_partkey"], ["l_discount"])


def train_linear_hot(spark, folder):
    """Every group is above the size of one task: threshold split, map-side sums, broadcast fits."""
    models = mf.train(
        events(spark, folder), ["event_type"], "value", ["user_id"], "linear", ["event_id"], rows_per_task=400
    )
    return listing(models, ["event_type"], ["user_id"])


def status_summary(spark, folder):
    return mf.status_summary(customer_models(spark, folder))


def run_metrics(spark, folder):
    averages = mf.run_metrics(customer_models(spark, folder))
    rounded = {"avg_rmse": 2, "avg_mse": 0, "avg_mae": 2}
    return averages.withColumns({c: places(F.col(c), n) for c, n in rounded.items()})


def review_models(spark, folder):
    review = mf.review_models(customer_models(spark, folder), ["o_custkey"])
    return review.select(
        "o_custkey",
        *[places(F.col(c), n).alias(c) for c, n in (("rmse", 2), ("mse", 0), ("mae", MAE_PLACES))],
        "num_rows",
        "status",
    )


def successful_models(spark, folder):
    return mf.successful(customer_models(spark, folder)).select("o_custkey", "num_rows", "feature_names")


def score_linear(spark, folder):
    """A part that is too small for a model, or cannot be fitted, predicts null; one that was never trained stops the job."""
    lines = table(spark, folder, "lineitem")
    scored = mf.score(lines.drop(PRICE), line_models(spark, folder), ["l_partkey"], "linear", "unseen", features=LINE_FEATURES)
    return scored.select(*LINE_KEY, "l_partkey", *LINE_FEATURES, places(F.col("prediction"), 2).alias("prediction"))


def evaluate_scores(spark, folder):
    """The rows that went through scoring are counted, those of a part without a model too; such a part has no errors."""
    lines = table(spark, folder, "lineitem")
    scored = mf.score(lines, line_models(spark, folder), ["l_partkey"], "linear", "unseen", features=LINE_FEATURES)
    errors = mf.evaluate(scored, ["l_partkey"], PRICE).drop("num_scored")
    counts = lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("num_scored"))
    return errors.join(counts, "l_partkey").select(
        "l_partkey",
        "num_scored",
        *[places(F.col(c), n).alias(c) for c, n in (("rmse", 2), ("mse", 0), ("mae", MAE_PLACES))],
    )


def score_unknown_null(spark, folder):
    rows = orders(spark, folder).select("o_orderkey", "o_custkey", "order_day")
    scored = mf.score(rows, customer_models(spark, folder), ["o_custkey"], "linear", "null", features=["order_day"])
    return scored.withColumn("prediction", places(F.col("prediction"), 2))


def unknown_keys(spark, folder):
    return mf.unknown_keys(orders(spark, folder), customer_models(spark, folder), ["o_custkey"])


def score_small_batch(spark, folder):
    """A few rows against all models: only the models of their keys are needed."""
    rows = mf.input_example(table(spark, folder, "lineitem"), PRICE, LINE_KEY, 5)
    scored = mf.score(rows, line_models(spark, folder), ["l_partkey"], "linear", "unseen", features=LINE_FEATURES)
    return scored.select(*LINE_KEY, "l_partkey", places(F.col("prediction"), 2).alias("prediction"))


def depth_label(trials: DataFrame) -> DataFrame:
    """In a plan a null depth means unlimited; say so."""
    return trials.withColumn("max_depth", F.coalesce(F.col("max_depth").cast("string"), F.lit("unlimited")))


def trial_plan(spark, folder):
    parts = table(spark, folder, "lineitem").select("l_partkey").distinct()
    return depth_label(mf.trial_plan(parts, ["l_partkey"], mf.FOREST_SPACE, 10))


def ridge_trials(spark, folder):
    lines = table(spark, folder, "lineitem")
    trials = mf.evaluate_trials(lines, ["l_suppkey"], PRICE, LINE_FEATURES, row_key=[*LINE_KEY, "l_partkey"])
    return trials.select("l_suppkey", "trial", "alpha", places(F.col("rmse"), 2).alias("rmse"))


def best_trial(spark, folder):
    lines = table(spark, folder, "lineitem")
    trials = mf.evaluate_trials(lines, ["l_suppkey"], PRICE, LINE_FEATURES, row_key=[*LINE_KEY, "l_partkey"])
    # Trials are told apart by rounded errors, so that equals are equal in any engine.
    best = mf.best_trial(trials.withColumn("rmse", places(F.col("rmse"), 2)), ["l_suppkey"])
    return best.select("l_suppkey", "trial", "alpha", "rmse")


def tune_ridge(spark, folder):
    lines = table(spark, folder, "lineitem")
    row_key = [*LINE_KEY, "l_partkey"]
    models = mf.tune(lines, ["l_suppkey"], PRICE, LINE_FEATURES, estimator="ridge", row_key=row_key)
    return listing(models, ["l_suppkey"], LINE_FEATURES, ["alpha"])


def train_ridge(spark, folder):
    return listing(line_models(spark, folder, estimator="ridge", alpha=2.5), ["l_partkey"], LINE_FEATURES)


def tune_ridge_hot(spark, folder):
    models = mf.tune(
        events(spark, folder), ["event_type"], "value", ["user_id", "k", "event_id"],
        {"alpha": mf.Choice(1e3, 1e5, 1e7)}, 10, "ridge", row_key=["event_id"], rows_per_task=400,
    )
    return listing(models, ["event_type"], ["user_id", "k", "event_id"], ["alpha"])


def input_example(spark, folder):
    return mf.input_example(table(spark, folder, "lineitem").drop("l_shipdate"), PRICE, LINE_KEY, 5)


def preview(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey", *LINE_KEY, "l_quantity", PRICE)
    return mf.preview(lines, ["l_partkey", *LINE_KEY, PRICE], 10)


def key_label(spark, folder):
    lines = table(spark, folder, "lineitem")
    label = mf.key_label(["l_returnflag", "l_linestatus", "l_linenumber"]).alias("label")
    return lines.groupBy(label).agg(F.count(F.lit(1)).alias("num_rows"))


def conform(spark, folder):
    """Columns in stored order and types, whatever the frame looked like."""
    lines = table(spark, folder, "lineitem")
    schema = lines.select("l_partkey", "l_quantity", "l_linenumber").schema
    loose = lines.select(F.col("l_linenumber").cast("long"), "l_partkey", F.col("l_quantity").cast("float"))
    return mf.conform(loose, schema)


def synth_rows(spark, folder):
    parts = table(spark, folder, "part")
    rows = mf.synth_rows(parts, ["p_partkey"], 20)
    numbers = ["feat_1", "feat_2", "feat_3", "sales"]
    return rows.select("p_partkey", "row_id", *[places(F.col(c), 6).alias(c) for c in numbers])


def train_synth(spark, folder):
    rows = mf.synth_rows(table(spark, folder, "part"), ["p_partkey"], 50)
    features = ["feat_1", "feat_2", "feat_3"]
    models = mf.train(rows, ["p_partkey"], "sales", features, "linear", ["p_partkey", "row_id"])
    return listing(models, ["p_partkey"], features)


def forest_listing(models: DataFrame, keys: list[str], chosen: list[str] = ()) -> DataFrame:
    return models.select(
        *keys,
        "num_rows",
        "status",
        *forest_errors(),
        *chosen,
    )


def forest_errors() -> list:
    mae = places(F.col("mae") + F.lit(OFF_FIVES), MAE_PLACES).alias("mae")
    return [places(F.col("rmse"), 2).alias("rmse"), places(F.col("mse"), 0).alias("mse"), mae]


def train_forest(spark, folder):
    return forest_listing(line_models(spark, folder, estimator="forest"), ["l_partkey"])


def train_forest_small_groups(spark, folder):
    models = mf.train(
        orders(spark, folder), ["o_custkey"], "o_totalprice", ["order_day", "priority"], "forest", ["o_orderkey"]
    )
    return forest_listing(models, ["o_custkey"])


def train_forest_hot(spark, folder):
    """Every group is above the size of one task, so its trees are grown level by level on the cluster."""
    models = mf.train(
        events(spark, folder),
        ["event_type"],
        "value",
        ["user_id", "k"],
        "forest",
        ["event_id"],
        rows_per_task=400,
    )
    return forest_listing(models, ["event_type"])


def score_forest(spark, folder):
    """Rows whose part has a forest, as in the SQL; a part that was never trained stops the job."""
    lines = table(spark, folder, "lineitem")
    models = line_models(spark, folder, estimator="forest")
    scored = mf.score(lines.drop(PRICE), models, ["l_partkey"], "forest", "unseen", features=LINE_FEATURES)
    scored = scored.filter(F.col("prediction").isNotNull())
    return scored.select(*LINE_KEY, "l_partkey", *LINE_FEATURES, places(F.col("prediction"), 6).alias("prediction"))


def score_forest_hot(spark, folder):
    """Every group is above the size of one task: its rows are dealt to several, each with the model."""
    rows = events(spark, folder).select("event_id", "event_type", "user_id", "k", "value")
    features = ["user_id", "k"]
    models = mf.train(rows, ["event_type"], "value", features, "forest", ["event_id"])
    scored = mf.score(rows.drop("value"), models, ["event_type"], features=features, rows_per_task=400)
    return scored.select("event_id", "event_type", places(F.col("prediction"), 6).alias("prediction"))


def forest_trials(spark, folder):
    lines = table(spark, folder, "lineitem")
    trials = mf.evaluate_trials(
        lines, ["l_partkey"], PRICE, LINE_FEATURES, SMALL_FOREST, 4, "forest", row_key=LINE_KEY
    )
    return depth_label(trials.select("l_partkey", "trial", *SMALL_FOREST, places(F.col("rmse"), 2).alias("rmse")))


def tune_forest(spark, folder):
    lines = table(spark, folder, "lineitem")
    models = mf.tune(lines, ["l_partkey"], PRICE, LINE_FEATURES, SMALL_FOREST, 4, "forest", row_key=LINE_KEY)
    return depth_label(forest_listing(models, ["l_partkey"], mf.FOREST_SPACE))


def search_forest(spark, folder):
    """The whole search space, ten trials of 50 to 300 trees for every part."""
    models = mf.tune(table(spark, folder, "lineitem"), ["l_partkey"], PRICE, LINE_FEATURES, num_trials=10, row_key=LINE_KEY)
    return depth_label(forest_listing(models, ["l_partkey"], mf.FOREST_SPACE))


def search_forest_guided(spark, folder):
    """The whole space with five guided trials after ten drawn ones, for every customer."""
    rows, features = orders(spark, folder), ["order_day", "priority"]
    models = mf.tune(rows, ["o_custkey"], "o_totalprice", features, num_trials=15, search="tpe", row_key=["o_orderkey"])
    return depth_label(forest_listing(models, ["o_custkey"], mf.FOREST_SPACE))


def search_forest_hot(spark, folder):
    """The same search over groups above the size of one task: the trees of a key are grown once for all trials."""
    models = mf.tune(
        events(spark, folder), ["event_type"], "value", ["user_id", "k"], num_trials=10, row_key=["event_id"], rows_per_task=1000
    )
    return depth_label(forest_listing(models, ["event_type"], mf.FOREST_SPACE))


def forest_sizes(spark, folder):
    """The size of every stored forest, and of the bundle they would make."""
    space = ["event_type"]
    models = mf.train(events(spark, folder), space, "value", ["user_id", "k"], "forest", ["event_id"], rows_per_task=1000)
    path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    stats = mf.bundle_stats(mf.bundle(models, space, path))
    each = spark.read.parquet(path).select("event_type", "model_size_bytes")
    whole = stats.select(F.lit("all").alias("event_type"), F.col("size_bytes").alias("model_size_bytes"))
    return each.unionByName(whole)


def train_forest_faults(spark, folder):
    """One event type has targets whose span is beyond a double; it gets a status and leaves the others alone."""
    huge = F.col("value") * F.pow(F.lit(10.0), F.lit(306.0)) * F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)
    rows = events(spark, folder).withColumn("value", F.when(F.col("event_type") == "click", F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), huge * 1e6))).otherwise(F.col("value")))
    models = mf.train(rows, ["event_type"], "value", ["user_id", "k"], "forest", ["event_id"], rows_per_task=1000)
    return forest_listing(models, ["event_type"])


def catalog_features(spark, folder):
    """A feature table of the catalog, of which only the named columns are read."""
    before, name = spark.catalog.currentDatabase(), f"features_{uuid.uuid4().hex}"
    space = mf.init_namespace(spark, name, f"{shared_folder(spark)}/{name}")
    spark.catalog.setCurrentDatabase(before)
    orders(spark, folder).write.format("parquet").saveAsTable(space.table("orders"))
    rows = mf.read_features(spark, space.table("orders"), ["o_orderkey", "o_custkey", "order_day", "o_totalprice"])
    return listing(mf.train(rows, ["o_custkey"], "o_totalprice", ["order_day"], "linear", ["o_orderkey"]), ["o_custkey"], ["order_day"])


def tuned_metrics_file(spark, folder):
    """The metrics of a search with its hyperparameters, written as CSV and read back."""
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    lines = table(spark, folder, "lineitem")
    mf.write_metrics(mf.tune(lines, ["l_partkey"], PRICE, LINE_FEATURES, SMALL_FOREST, 4, "forest", row_key=LINE_KEY), ["l_partkey"], path)
    schema = "l_partkey long, rmse double, mse double, mae double, num_rows long, " + ", ".join(f"{c} long" for c in mf.FOREST_SPACE)
    back = spark.read.csv(path, schema, header=True)
    return depth_label(back.select("l_partkey", "num_rows", *forest_errors(), *mf.FOREST_SPACE))


def tune_forest_guided(spark, folder):
    rows = orders(spark, folder)
    return mf.tune(
        rows, ["o_custkey"], "o_totalprice", ["order_day", "priority"], SMALL_FOREST, 12, "forest", "tpe", ["o_orderkey"]
    ).drop("model_bytes")


def guided_proposals(spark, folder):
    """What the guided search tries next, after ten trials of every customer."""
    trials = mf.evaluate_trials(
        orders(spark, folder), ["o_custkey"], "o_totalprice", ["order_day", "priority"], SMALL_FOREST, 10, "forest",
        row_key=["o_orderkey"],
    )
    code = KeyCode(trials.schema, ["o_custkey"])
    history = trials.filter(F.col("rmse").isNotNull()).select(
        *code.coded(), "trial", *SMALL_FOREST, places(F.col("rmse"), 2).alias("rmse")
    )
    plan = guided_plan(history, code, SMALL_FOREST, 10, 42)
    return depth_label(plan.select(*code.restored(), "trial", *SMALL_FOREST))


def score_stream(spark, folder):
    """The events as a stream, each scored by the model of its type."""
    keys, features = ["event_type"], ["user_id", "k"]
    past = events(spark, folder)
    models = mf.train(past, keys, "value", ["user_id"], "linear", ["event_id"])
    schema = table(spark, folder, "events").schema
    stream = with_props(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder))
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = stream.select("event_id", *keys, *features)
    query = mf.write_scores(rows, models, keys, f"{out}/rows", f"{out}/state", once=True)
    query.awaitTermination()
    scored = spark.read.parquet(f"{out}/rows")
    return scored.select("event_id", "event_type", places(F.col("prediction"), 4).alias("prediction"))


def bundle_scores(spark, folder):
    """Models stored as a bundle, read back and used."""
    path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    mf.bundle(customer_models(spark, folder), ["o_custkey"], path)
    rows = orders(spark, folder).select("o_orderkey", "o_custkey", "order_day")
    scored = mf.score(rows, mf.load_bundle(spark, path), ["o_custkey"], "linear", "null")
    return scored.withColumn("prediction", places(F.col("prediction"), 2))


def metrics_file(spark, folder):
    """The metrics of the successful models, written as CSV and read back."""
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    mf.write_metrics(customer_models(spark, folder), ["o_custkey"], path)
    schema = "o_custkey long, rmse double, mse double, mae double, num_rows long"
    back = spark.read.csv(path, schema, header=True)
    rounded = {"rmse": 2, "mse": 0, "mae": MAE_PLACES}
    return back.withColumns({c: places(F.col(c), n) for c, n in rounded.items()})


def score_checked(spark, folder):
    """Strict scoring that looks up in the models which features it needs; a part that was never trained stops it."""
    lines = table(spark, folder, "lineitem")
    scored = mf.score(lines.drop(PRICE), settle(line_models(spark, folder), "models"), ["l_partkey"], "linear", "unseen")
    return scored.select(*LINE_KEY, "l_partkey", *LINE_FEATURES, places(F.col("prediction"), 2).alias("prediction"))


def train_inferred(spark, folder):
    """Features are the columns that are left when keys and target are taken away."""
    lines = table(spark, folder, "lineitem").select("l_partkey", *LINE_KEY, *LINE_FEATURES, PRICE)
    features = infer_features(lines, ["l_partkey"], PRICE, exclude=LINE_KEY)
    models = mf.train(lines, ["l_partkey"], PRICE, features, "linear", LINE_KEY)
    return listing(models, ["l_partkey"], LINE_FEATURES)


def score_forest_stream(spark, folder):
    """The events as a stream, each scored by the forest of its type."""
    keys, features = ["event_type"], ["user_id", "k"]
    past = events(spark, folder).select("event_id", *keys, *features, "value")
    models = mf.train(past, keys, "value", features, "forest", ["event_id"])
    schema = table(spark, folder, "events").schema
    stream = with_props(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder))
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = stream.select("event_id", *keys, *features)
    mf.write_scores(rows, models, keys, f"{out}/rows", f"{out}/state", "forest", once=True).awaitTermination()
    scored = spark.read.parquet(f"{out}/rows")
    return scored.select("event_id", "event_type", places(F.col("prediction"), 6).alias("prediction"))


def published(spark, folder):
    """Customer models, trained, stored, bundled, recorded and registered in a namespace of their own."""
    name, before = f"published_{uuid.uuid4().hex}", spark.catalog.currentDatabase()
    space = mf.init_namespace(spark, name, f"{shared_folder(spark)}/{name}")
    spark.catalog.setCurrentDatabase(before)
    known = orders(spark, folder).select("o_orderkey", "o_custkey", "order_day", "o_totalprice")
    settings = {"features": ["order_day"], "estimator": "linear"}
    mf.train_and_publish(space, "customers", known, ["o_custkey"], "o_totalprice", ["o_orderkey"], **settings)
    return space


def published_scores(spark, folder):
    """The newest version of a registered model, loaded and used."""
    space = published(spark, folder)
    rows = orders(spark, folder).select("o_orderkey", "o_custkey", "order_day")
    scored = mf.load_version(spark, space, "customers").score(rows, on_unknown="null")
    return scored.withColumn("prediction", places(F.col("prediction"), 2))


def recorded_run(spark, folder):
    """What the run of the newest version recorded."""
    space = published(spark, folder)
    newest = latest_versions(spark, space).join(runs(spark, space), "run_id")
    metrics = {"avg_rmse": 2, "avg_mse": 0, "avg_mae": 2, "num_keys": 0, "num_failed": 0}
    return newest.select("name", "version", *[places(F.col("metrics")[m], n).alias(m) for m, n in metrics.items()])


def bundle_size(spark, folder):
    """Number of models in a bundle, and whether their sizes were kept."""
    path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    stats = mf.bundle_stats(mf.bundle(customer_models(spark, folder), ["o_custkey"], path))
    return stats.select("num_models", (F.col("size_bytes") > F.col("num_models")).alias("has_sizes"))


def entry(spark: SparkSession) -> DataFrame:
    """One linear model per part, with its hold-out error."""
    return train_linear_1f(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = [
        group_profile, group_profile_small, group_size_histogram, holdout_split, holdout_split_hot, null_fill,
        train_linear_1f, train_linear_3f, train_small_groups, train_composite_key, train_null_key,
        train_missing_target, train_linear_hot, status_summary, run_metrics, review_models, successful_models,
        score_linear, evaluate_scores, score_unknown_null, unknown_keys, score_small_batch, trial_plan, ridge_trials,
        best_trial, tune_ridge, train_ridge, tune_ridge_hot, input_example, preview, key_label, conform, synth_rows, train_synth, train_forest,
        train_forest_small_groups, train_forest_hot, score_forest, score_forest_hot, forest_trials, tune_forest, guided_proposals,
        search_forest, search_forest_guided, search_forest_hot, forest_sizes, train_forest_faults, catalog_features, tuned_metrics_file,
        tune_forest_guided,
        score_stream, bundle_scores, metrics_file, score_checked, train_inferred, score_forest_stream, published_scores,
        recorded_run, bundle_size,
    ]
    named = {q.__name__: q for q in registered}
    if text_queries:
        named |= {**text_queries.QUERIES, "pipeline": corpus_pipeline.run}
    return {name: shipped(query) for name, query in named.items()}


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, run after the package was given to the executors, wherever they and the driver were started."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


def oracle_sql() -> dict[str, str]:
    return table_sql() | (text_queries.SQL if text_queries else {})


def table_sql() -> dict[str, str]:
    line = ("lineitem", ["l_partkey"], PRICE, LINE_FEATURES, LINE_KEY)
    supply = ("lineitem", ["l_suppkey"], PRICE, LINE_FEATURES, [*LINE_KEY, "l_partkey"])
    customers = (ORDERS_SQL, ["o_custkey"], "o_totalprice", ["order_day"], ["o_orderkey"])
    line_models_sql = o.linear_ctes(*line, carry=[*LINE_KEY, "l_partkey", *LINE_FEATURES])
    customer_models_sql = o.linear_ctes(*customers)
    r = o.rounded
    rows_sql = ", ".join([*LINE_KEY, "l_partkey", *LINE_FEATURES])
    customer_scores = f"""{customer_models_sql}
SELECT r.o_orderkey, r.o_custkey, r.order_day, {r('m.b + m.w0 * r.order_day', 2)} AS prediction
FROM {ORDERS_SQL} r LEFT JOIN models m ON m.k0 = r.o_custkey AND m.status = 'success'"""
    dot3 = "m.b + m.w0 * o.x0 + m.w1 * o.x1 + m.w2 * o.x2"
    forest_space = [
        ("n_estimators", 50, 300),
        ("max_depth", [5, 10, 15, 20, None]),
        ("min_samples_split", [2, 5, 10]),
        ("min_samples_leaf", [1, 2, 4]),
    ]
    small_space = [
        ("n_estimators", 5, 12),
        ("max_depth", [3, 5, None]),
        ("min_samples_split", [2, 5, 10]),
        ("min_samples_leaf", [1, 2, 4]),
    ]
    split_listing = "SELECT k0 AS {}, {}, y AS {}, held AS is_validation FROM obs"
    example = f"""SELECT * FROM lineitem ORDER BY {o.text_hash(LINE_KEY, 15)}, l_orderkey, l_linenumber, l_suppkey LIMIT 5"""
    tried = o.ridge_trials(*supply, ALPHAS, 10)
    hot_tried = o.ridge_trials(
        EVENTS_SQL, ["event_type"], "value", ["user_id", "k", "event_id"], ["event_id"], [1e3, 1e5, 1e7], 10
    )

    def tuned_ridge(trials, key):
        return f"""{trials},
best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY k0 ORDER BY sqrt(mse), trial) = 1)
SELECT k0 AS {key}, n AS num_rows, 'success' AS status, {r('sqrt(mse)', 2)} AS rmse, {r('mse', 0)} AS mse,
  {r('mae', MAE_PLACES)} AS mae, {r('b', 2)} AS intercept, {r('w0', 4)} AS w0, {r('w1', 4)} AS w1, {r('w2', 4)} AS w2, alpha
FROM best"""

    unit = "p_partkey, row_id"
    synth = f"""WITH numbered AS (SELECT p_partkey, unnest(range({{n}})) AS row_id FROM part),
drawn AS (SELECT {unit}, 10.0::DOUBLE + 90.0::DOUBLE * {o.uniform('p_partkey', 'row_id', "'feat_1'")} AS feat_1,
  5.0::DOUBLE + 45.0::DOUBLE * {o.uniform('p_partkey', 'row_id', "'feat_2'")} AS feat_2,
  1.0::DOUBLE + 19.0::DOUBLE * {o.uniform('p_partkey', 'row_id', "'feat_3'")} AS feat_3,
  sqrt(-2.0 * ln(1.0 - {o.uniform('p_partkey', 'row_id', "'noise'", "'r'")}))
    * cos(6.283185307179586 * {o.uniform('p_partkey', 'row_id', "'noise'", "'a'")}) AS z FROM numbered),
synth AS (SELECT {unit}, feat_1, feat_2, feat_3,
  greatest(0.0::DOUBLE, 2.5::DOUBLE * feat_1 + 1.8::DOUBLE * feat_2 + 3.2::DOUBLE * feat_3 + 20.0::DOUBLE * z) AS sales FROM drawn)"""
    trained_synth = o.train_linear(
        "synth", ["p_partkey"], "sales", ["feat_1", "feat_2", "feat_3"], ["p_partkey", "row_id"]
    )
    line_forest = dict(
        source="lineitem", target=PRICE, features=LINE_FEATURES, row_key=LINE_KEY,
    )
    trial_errors = f"""{o.forest(key=['l_partkey'], trees=12, space=small_space, trials=4, **line_forest)},
tried AS (SELECT k0, trial, avg((y - prediction) * (y - prediction)) AS mse, avg(abs(y - prediction)) AS mae
  FROM votes JOIN scored USING (k0, rid) GROUP BY k0, trial)"""
    event_forest = dict(key=["event_type"], target="value", features=["user_id", "k"], row_key=["event_id"], trees=50)
    settings = "n_estimators, coalesce(max_depth::VARCHAR, 'unlimited') AS max_depth, min_samples_split, min_samples_leaf"
    metric_columns = f"{r('rmse', 2)} AS rmse, {r('mse', 0)} AS mse, {r('mae', MAE_PLACES)} AS mae"
    checked = {
        "train_inferred": o.train_linear(*line),
        "published_scores": customer_scores,
        "bundle_size": f"{customer_models_sql} SELECT count(*) AS num_models, true AS has_sizes FROM models WHERE status = 'success'",
    }
    tables = {
        "group_profile": """SELECT sum(n)::BIGINT AS num_rows, count(*) AS num_groups, min(n) AS min_rows,
  median(n) AS median_rows, max(n) AS max_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)""",
        "group_profile_small": """SELECT sum(n)::BIGINT AS num_rows, count(*) AS num_groups, min(n) AS min_rows,
  median(n) AS median_rows, max(n) AS max_rows FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""",
        "group_size_histogram": """SELECT n AS group_rows, count(*) AS num_groups
FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n""",
        "holdout_split": f"WITH {o.observations(*line)} "
        + split_listing.format("l_partkey", "x0 AS l_quantity, x1 AS l_discount, x2 AS l_tax", PRICE),
        "holdout_split_hot": f"WITH {o.observations(EVENTS_SQL, ['event_type'], 'value', ['user_id', 'k'], ['event_id'])} "
        + split_listing.format("event_type", "x0 AS user_id, x1 AS k", "value"),
        "null_fill": """SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(nullif(l_discount, 0), 0.0) AS l_discount,
  coalesce(l_tax, 0.0) AS l_tax FROM lineitem""",
        "train_linear_1f": o.train_linear("lineitem", ["l_partkey"], PRICE, ["l_quantity"], LINE_KEY),
        "train_linear_3f": o.train_linear(*line),
        "train_small_groups": o.train_linear(*customers),
        "train_composite_key": o.train_linear(
            "lineitem", ["l_returnflag", "l_linestatus"], PRICE, LINE_FEATURES, [*LINE_KEY, "l_partkey"]
        ),
        "train_null_key": o.train_linear(
            "(SELECT *, nullif(l_returnflag, 'R') AS flag FROM lineitem)",
            ["flag", "l_linestatus"],
            PRICE,
            LINE_FEATURES,
            [*LINE_KEY, "l_partkey"],
        ),
        "train_missing_target": o.train_linear(
            "(SELECT *, nullif(l_quantity, 50) AS wanted FROM lineitem)",
            ["l_partkey"],
            "wanted",
            ["l_discount"],
            LINE_KEY,
        ),
        "train_linear_hot": o.train_linear(EVENTS_SQL, ["event_type"], "value", ["user_id"], ["event_id"]),
        "status_summary": f"""{customer_models_sql}
SELECT split_part(status, ': ', 1) AS outcome, count(*) AS num_models, sum(n)::BIGINT AS num_rows FROM models GROUP BY 1""",
        "run_metrics": f"""{customer_models_sql}
SELECT {r('avg(rmse)', 2)} AS avg_rmse, {r('avg(mse)', 0)} AS avg_mse, {r('avg(mae)', 2)} AS avg_mae,
  (count(*) FILTER (WHERE status = 'success'))::DOUBLE AS num_keys,
  (count(*) FILTER (WHERE status <> 'success'))::DOUBLE AS num_failed FROM models""",
        "review_models": f"{customer_models_sql}\nSELECT k0 AS o_custkey, {metric_columns}, n AS num_rows, status FROM models",
        "successful_models": f"""{customer_models_sql}
SELECT k0 AS o_custkey, n AS num_rows, ['order_day'] AS feature_names FROM models WHERE status = 'success'""",
        "score_linear": f"""{line_models_sql}
SELECT {rows_sql}, {r(dot3, 2)} AS prediction FROM obs o JOIN models m ON m.k0 = o.k0""",
        "evaluate_scores": f"""{line_models_sql},
scored AS (SELECT o.k0, o.y - ({dot3}) AS e FROM obs o JOIN models m ON m.k0 = o.k0)
SELECT k0 AS l_partkey, count(*) AS num_scored, {r('sqrt(avg(e * e))', 2)} AS rmse, {r('avg(e * e)', 0)} AS mse,
  {r('avg(abs(e))', MAE_PLACES)} AS mae FROM scored GROUP BY k0""",
        "score_unknown_null": customer_scores,
        "unknown_keys": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) < 10",
        "score_small_batch": f"""{line_models_sql}
SELECT e.l_orderkey, e.l_linenumber, e.l_suppkey, e.l_partkey,
  {r('m.b + m.w0 * e.l_quantity + m.w1 * e.l_discount + m.w2 * e.l_tax', 2)} AS prediction
FROM ({example}) e JOIN models m ON m.k0 = e.l_partkey""",
        "trial_plan": "SELECT * REPLACE (coalesce(max_depth::VARCHAR, 'unlimited') AS max_depth) FROM ("
        + o.trial_draws(forest_space, "l_partkey", "(SELECT DISTINCT l_partkey FROM lineitem)", 10)
        + ")",
        "ridge_trials": f"{tried} SELECT k0 AS l_suppkey, trial, alpha, {r('sqrt(mse)', 2)} AS rmse FROM tried",
        "best_trial": f"""{tried}, rounded AS (SELECT *, {r('sqrt(mse)', 2)} AS rmse FROM tried)
SELECT k0 AS l_suppkey, trial, alpha, rmse FROM rounded
QUALIFY row_number() OVER (PARTITION BY k0 ORDER BY rmse, trial) = 1""",
        "tune_ridge": tuned_ridge(tried, "l_suppkey"),
        "train_ridge": o.train_ridge(*line, 2.5),
        "tune_ridge_hot": tuned_ridge(hot_tried, "event_type"),
        "input_example": f"SELECT * EXCLUDE (l_extendedprice, l_shipdate) FROM ({example})",
        "preview": """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice FROM lineitem
ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice LIMIT 10""",
        "key_label": """SELECT concat_ws('|', l_returnflag, l_linestatus, l_linenumber) AS label, count(*) AS num_rows
FROM lineitem GROUP BY 1""",
        "conform": "SELECT l_partkey, l_quantity, l_linenumber FROM lineitem",
        "synth_rows": synth.format(n=20) + f""" SELECT {unit}, {r('feat_1', 6)} AS feat_1, {r('feat_2', 6)} AS feat_2,
  {r('feat_3', 6)} AS feat_3, {r('sales', 6)} AS sales FROM synth""",
        "train_synth": synth.format(n=50) + ",\n" + trained_synth.removeprefix("WITH "),
        "train_forest": o.forest_models(["l_partkey"], trees=50, **line_forest),
        "train_forest_small_groups": o.forest_models(
            ["o_custkey"],
            source=ORDERS_SQL,
            target="o_totalprice",
            features=["order_day", "priority"],
            row_key=["o_orderkey"],
            trees=50,
        ),
        "train_forest_hot": o.forest_models(
            ["event_type"],
            source=EVENTS_SQL,
            target="value",
            features=["user_id", "k"],
            row_key=["event_id"],
            trees=50,
        ),
        "score_forest": o.forest(
            key=["l_partkey"], trees=50, score_all=True, carry=[*LINE_KEY, "l_partkey", *LINE_FEATURES], **line_forest
        )
        + f" SELECT {rows_sql}, {r('prediction', 6)} AS prediction FROM votes JOIN scored USING (k0, rid)",
        "score_forest_hot": o.forest(
            key=["event_type"],
            source=EVENTS_SQL,
            target="value",
            features=["user_id", "k"],
            row_key=["event_id"],
            trees=50,
            score_all=True,
            carry=["event_id", "event_type"],
        )
        + f" SELECT event_id, event_type, {r('prediction', 6)} AS prediction FROM votes JOIN scored USING (k0, rid)",
        "forest_trials": f"""{trial_errors} SELECT k0 AS l_partkey, trial, n_estimators,
  coalesce(max_depth::VARCHAR, 'unlimited') AS max_depth, min_samples_split,
  min_samples_leaf, {r('sqrt(mse)', 2)} AS rmse FROM tried JOIN plan USING (k0, trial)""",
        "tune_forest": f"""{trial_errors},
best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY k0 ORDER BY round(sqrt(mse), 6), trial) = 1)
SELECT k0 AS l_partkey, n AS num_rows, 'success' AS status, {r('sqrt(mse)', 2)} AS rmse, {r('mse', 0)} AS mse,
  {r(f'mae + {OFF_FIVES}', MAE_PLACES)} AS mae, {settings} FROM best JOIN sizes USING (k0) JOIN plan USING (k0, trial)""",
        "tuned_metrics_file": f"""{trial_errors},
best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY k0 ORDER BY round(sqrt(mse), 6), trial) = 1)
SELECT k0 AS l_partkey, n AS num_rows, {r('sqrt(mse)', 2)} AS rmse, {r('mse', 0)} AS mse,
  {r(f'mae + {OFF_FIVES}', MAE_PLACES)} AS mae, {settings} FROM best JOIN sizes USING (k0) JOIN plan USING (k0, trial)""",
        "catalog_features": o.train_linear(*customers),
        "forest_sizes": f"""{o.forest(**event_forest, source=EVENTS_SQL)},
nodes AS (SELECT k0, count(*) AS nodes FROM (SELECT DISTINCT k0, t, node FROM walk WHERE w > 0) GROUP BY k0),
models AS (SELECT k0 AS event_type, (12 + 4 * 50 + 16 * nodes)::BIGINT AS model_size_bytes FROM nodes)
SELECT * FROM models UNION ALL SELECT 'all', sum(model_size_bytes)::BIGINT FROM models""",
        "train_forest_faults": f"""SELECT event_type, num_rows,
  CASE event_type WHEN 'click' THEN 'error: the span of the target is not finite' ELSE status END AS status,
  CASE WHEN event_type <> 'click' THEN rmse END AS rmse, CASE WHEN event_type <> 'click' THEN mse END AS mse,
  CASE WHEN event_type <> 'click' THEN mae END AS mae FROM ({o.forest_models(**event_forest, source=EVENTS_SQL)})""",
        "guided_proposals": o.guided_proposals(
            o.forest(
                key=["o_custkey"],
                source=ORDERS_SQL,
                target="o_totalprice",
                features=["order_day", "priority"],
                row_key=["o_orderkey"],
                trees=12,
                space=small_space,
                trials=10,
            ),
            "o_custkey",
            small_space,
            10,
        ),
        "score_stream": f"""{o.linear_ctes(EVENTS_SQL, ['event_type'], 'value', ['user_id'], ['event_id'], ['event_id', 'event_type'])}
SELECT event_id, event_type, {r('m.b + m.w0 * o.x0', 4)} AS prediction FROM obs o JOIN models m ON m.k0 = o.k0""",
        "bundle_scores": customer_scores,
        "metrics_file": f"""{customer_models_sql}
SELECT k0 AS o_custkey, {metric_columns}, n AS num_rows FROM models WHERE status = 'success'""",
    }
    checked["score_checked"] = tables["score_linear"]
    checked["score_forest_stream"] = tables["score_forest_hot"]
    checked["recorded_run"] = "SELECT 'customers' AS name, 1 AS version, * FROM (" + tables["run_metrics"] + ")"
    return tables | checked
