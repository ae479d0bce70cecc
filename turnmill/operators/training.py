"""Training run histories: last losses, loss curves and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def final_losses(history: DataFrame) -> DataFrame:
    """Last recorded loss and eval_loss of each run; NULL when a run has none."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("step")))
    return history.groupBy("run_id").agg(
        last("loss").alias("final_train_loss"), last("eval_loss").alias("final_eval_loss")
    )


def loss_points(history: DataFrame, metric: str = "loss") -> DataFrame:
    """Curve of one metric: rows where it was recorded."""
    return history.filter(F.col(metric).isNotNull()).select("run_id", "step", metric)


def run_log(history: DataFrame, runs: DataFrame, timestamp: str | None = None) -> DataFrame:
    """One row per run. ``runs`` has run_id, model_key, train_samples, eval_samples, duration_sec
    and status, and may have hf_model_id, epochs and checkpoint_dir, which are NULL otherwise.
    A run without history has NULL losses; ``timestamp`` is the time of the query if not given."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    given = lambda c, kind: (F.col(c) if c in runs.columns else F.lit(None).cast(kind)).alias(c)
    return runs.join(final_losses(history), "run_id", "left").select(
        (F.lit(timestamp) if timestamp else now).alias("timestamp"),
        "run_id",
        "model_key",
        given("hf_model_id", "string"),
        "train_samples",
        "eval_samples",
        given("epochs", "int"),
        F.round("final_train_loss", 4).alias("final_train_loss"),
        F.round("final_eval_loss", 4).alias("final_eval_loss"),
        F.round(F.col("duration_sec") / 60, 1).alias("duration_min"),
        given("checkpoint_dir", "string"),
        "status",
    )


def sweep_failures(runs: DataFrame) -> DataFrame:
    """The failed runs of a sweep: run_id, model_key."""
    return runs.filter("status = 'failed'").select("run_id", "model_key")


def sweep_summary(runs: DataFrame) -> DataFrame:
    """Runs, successes and failures per model."""
    return runs.groupBy("model_key").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.expr("status = 'success'")).alias("n_success"),
        F.count_if(F.expr("status = 'failed'")).alias("n_failed"),
    )
