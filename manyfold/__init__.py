"""One model per group of a table: training, search, storage and scoring on Spark."""

from manyfold.functions.draws import Choice, IntRange
from manyfold.functions.features import infer_features, key_label, prepare_features
from manyfold.operators.profile import (
    group_size_histogram,
    input_example,
    preview,
    profile_groups,
    review_models,
    run_metrics,
    status_summary,
    successful,
)
from manyfold.operators.score import check_features, evaluate, score, unknown_keys
from manyfold.operators.split import bucket_by_key, holdout_split
from manyfold.operators.train import train
from manyfold.operators.tune import FOREST_SPACE, RIDGE_SPACE, best_trial, evaluate_trials, trial_plan, tune
from manyfold.plans.lifecycle import publish, train_and_publish, tune_and_publish
from manyfold.schema import conform, model_schema, tuned_schema
from manyfold.sources.registry import load_version, log_run, register
from manyfold.sources.synthetic import synth_groups, synth_rows
from manyfold.sources.tables import (
    bundle,
    bundle_stats,
    init_namespace,
    load_bundle,
    read_features,
    read_models,
    write_metrics,
    write_models,
)
from manyfold.streaming.scoring import score_stream, write_scores

__all__ = [name for name in dir() if not name.startswith("_")]
