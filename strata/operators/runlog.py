"""Run-log analytics over ``experiment_log`` tables (survey 2.L).

The log has one row per (run_id, round_num).  Per-run results (baseline,
best round, summary) are plain aggregations (``min_by`` over a struct), so a
run with a huge number of rounds is combined map-side.  The running best
before each round uses chunks of rounds: chunk minima (a table 1/CHUNK the
size of the log) get their own prefix minimum, and the window inside a
chunk covers at most CHUNK rows — no task ever holds a whole run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import stats as S
from strata.functions.joins import join_small

CHUNK = 1024
FLAT = 0.001
INF = float("inf")


def _usable(log: DataFrame) -> Column:
    """Rounds that count as completed: status complete, or the baseline."""
    return (F.col("status") == "complete") | (F.col("round_num") == 0)


def _loss_for_best() -> Column:
    return F.coalesce(F.col("cv_loss"), F.lit(INF))


def baselines(log: DataFrame) -> DataFrame:
    """Round 0 of each run (L1)."""
    return log.where(F.col("round_num") == 0)


def best_rounds(log: DataFrame) -> DataFrame:
    """Lowest cv_loss among completed rounds, ties to the earliest round (L2).

    Selection is by loss for classification and regression alike.
    """
    cols = [c for c in log.columns if c != "run_id"]
    best = (log.where(_usable(log))
            .groupBy("run_id")
            .agg(F.min_by(F.struct(*cols), F.struct(_loss_for_best().alias("l"), F.col("round_num"))).alias("b")))
    return best.select("run_id", *[F.col(f"b.{c}").alias(c) for c in cols])


def running_best_before(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``best_before``: min loss of the earlier rounds of the run (failed rounds count as +inf)."""
    loss = F.when(_usable(log), _loss_for_best()).otherwise(F.lit(INF))
    ch = log.withColumn("__loss", loss).withColumn("__c", F.floor(F.col("round_num") / chunk))
    mins = ch.groupBy("run_id", "__c").agg(F.min("__loss").alias("__cmin"))
    wprev = Window.partitionBy("run_id").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    prefix = mins.select("run_id", "__c", F.min("__cmin").over(wprev).alias("__pmin"))
    win = Window.partitionBy("run_id", "__c").orderBy("round_num").rowsBetween(Window.unboundedPreceding, -1)
    within = ch.withColumn("__wmin", F.min("__loss").over(win))
    joined = join_small(within, prefix, ["run_id", "__c"], "left")
    return joined.withColumn("best_before", F.least("__pmin", "__wmin")).drop("__loss", "__c", "__pmin", "__wmin")


def progression(log: DataFrame) -> DataFrame:
    """Score progression with status baseline / best / no improvement.

    Output: run_id, round_num, label, cv_score, delta_text, status.
    """
    rb = running_best_before(log)
    loss = F.when(_usable(rb), _loss_for_best()).otherwise(F.lit(INF))
    status = (F.when(F.col("round_num") == 0, F.lit("baseline"))
              .when(loss < F.coalesce(F.col("best_before"), F.lit(INF)), F.lit("best"))
              .otherwise(F.lit("no improvement")))
    label = F.when(F.col("round_num") == 0, F.lit("baseline")).otherwise(
        F.concat(F.lit("round "), F.col("round_num").cast("string")))
    arrow = F.when(F.col("round_num") == 0, F.lit("—")).otherwise(delta_text(F.col("delta")))
    return rb.select("run_id", "round_num", label.alias("label"), S.rnd(F.col("cv_score"), 4).alias("cv_score"),
                     arrow.alias("delta_text"), status.alias("status"))


def _fmt4(c: Column) -> Column:
    return F.regexp_replace(F.format_number(c, 4), ",", "")


def delta_text(delta: Column) -> Column:
    """▲ +d above 0.001, ▼ d below -0.001, otherwise the signed value (L4)."""
    signed = F.when(F.startswith(_fmt4(delta), F.lit("-")), _fmt4(delta)).otherwise(F.concat(F.lit("+"), _fmt4(delta)))
    return (F.when(delta > FLAT, F.concat(F.lit("▲ +"), _fmt4(delta)))
            .when(delta < -FLAT, F.concat(F.lit("▼ "), _fmt4(delta)))
            .otherwise(F.concat(F.lit("  "), signed)))


def summary(log: DataFrame) -> DataFrame:
    """Per run: baseline, best round, improvement in loss and %, rounds run.

    improvement = baseline loss - best loss (positive = better);
    improvement_pct = improvement / max(baseline loss, 1e-9) * 100.
    """
    base = baselines(log).select("run_id", F.col("cv_score").alias("baseline_score"),
                                 F.col("cv_loss").alias("baseline_loss"))
    best = best_rounds(log).select("run_id", F.col("round_num").alias("best_round"),
                                   F.col("cv_score").alias("best_score"), F.col("cv_loss").alias("best_loss"),
                                   F.col("best_model"))
    counts = log.groupBy("run_id").agg(F.count_if(F.col("round_num") > 0).alias("rounds_run"))
    imp = F.col("baseline_loss") - F.col("best_loss")
    return (base.join(best, "run_id", "left").join(counts, "run_id", "left")
            .select("run_id", S.rnd(F.col("baseline_score"), 4).alias("baseline_score"),
                    F.col("best_round"), S.rnd(F.col("best_score"), 4).alias("best_score"),
                    S.rnd(imp, 4).alias("improvement"),
                    S.rnd(imp / F.greatest(F.col("baseline_loss"), F.lit(1e-9)) * 100, 1).alias("improvement_pct"),
                    F.col("rounds_run").cast("bigint").alias("rounds_run"), "best_model"))


def recommendation(log: DataFrame) -> DataFrame:
    """'static' when the best is round 0 or gains < 0.001, else the winning round."""
    s = summary(log)
    static = (F.col("best_round") == 0) | (F.col("improvement") < FLAT)
    return s.select("run_id",
                    F.when(static, F.lit("static")).otherwise(
                        F.concat(F.lit("round "), F.col("best_round").cast("string"))).alias("recommendation"),
                    F.when(static, F.lit(0)).otherwise(F.col("best_round")).alias("use_round"),
                    "best_model")


def best_features(log: DataFrame) -> DataFrame:
    """Ranked top features of each run's best round."""
    b = best_rounds(log)
    return b.select("run_id", F.posexplode(F.coalesce("shap_top", F.array().cast("array<string>")))
                    .alias("pos", "feature")).select("run_id", (F.col("pos") + 1).cast("int").alias("rank"), "feature")


def round_details(log: DataFrame, error_chars: int = 500, top: int = 5) -> DataFrame:
    """Per FE round: status, error cut to 500 chars, top 5 features."""
    return log.where(F.col("round_num") > 0).select(
        "run_id", "round_num", F.when(F.col("improved"), F.lit("✓")).otherwise(F.lit("✗")).alias("mark"),
        F.substring(F.coalesce("executor_error", F.lit("")), 1, error_chars).alias("error"),
        F.slice(F.coalesce("shap_top", F.array().cast("array<string>")), 1, top).alias("top_features"))


def best_code(log: DataFrame) -> DataFrame:
    """Definition of each run's winning candidate."""
    return best_rounds(log).select("run_id", "round_num", F.coalesce("fe_code", F.lit("")).alias("fe_code"))


def output_rounds(log: DataFrame) -> DataFrame:
    """Rows per FE round for the result contract."""
    return log.where(F.col("round_num") > 0).select(
        "run_id", F.col("round_num").alias("round"), S.rnd(F.col("cv_score"), 4).alias("cv_score"),
        S.rnd(F.col("delta"), 4).alias("delta"), "improved", F.coalesce("fe_code", F.lit("")).alias("fe_code"),
        F.slice(F.coalesce("shap_top", F.array().cast("array<string>")), 1, 5).alias("top_features"),
        F.coalesce("executor_error", F.lit("")).alias("executor_error"))


def best_accepted(log: DataFrame) -> DataFrame:
    """Best accepted (improved) round per run by loss, its new features and gain."""
    acc = (log.where(F.col("improved"))
           .groupBy("run_id")
           .agg(F.min_by(F.struct("round_num", "cv_loss", "new_features"),
                         F.struct(_loss_for_best().alias("l"), F.col("round_num"))).alias("b")))
    base = baselines(log).select("run_id", F.col("cv_loss").alias("baseline_loss"))
    return acc.join(base, "run_id", "left").select(
        "run_id", F.col("b.round_num").alias("round_num"),
        F.slice(F.coalesce("b.new_features", F.array().cast("array<string>")), 1, 6).alias("new_features"),
        S.rnd(F.col("baseline_loss") - F.col("b.cv_loss"), 4).alias("gain"))


def result_facts(log: DataFrame, task: str = "classification") -> DataFrame:
    """Facts for a result narrative: scores in %, improvement points, model, top 8."""
    s = summary(log)
    feats = best_rounds(log).select("run_id", F.slice(F.transform(
        F.coalesce("shap_top", F.array().cast("array<string>")),
        lambda x: F.regexp_replace(x, r"^(num|cat)__", "")), 1, 8).alias("top_features"))
    pct = (lambda c: S.rnd(F.col(c) * 100, 1)) if task == "classification" else (lambda c: F.col(c))
    return s.join(feats, "run_id", "left").select(
        "run_id", pct("best_score").alias("score"), pct("baseline_score").alias("baseline"),
        S.rnd(F.col("improvement") * (100 if task == "classification" else 1), 2).alias("improvement_pts"),
        "best_model", "top_features", "rounds_run")
