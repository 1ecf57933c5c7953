"""Queries for run-log analytics (2.L) and the result contract.

The experiment log analysed here is a stand-in derived from the
``conversations`` table (one run per conversation, one round per turn), so
its size grows with the data; the columns are filled by fixed rules that
the oracle SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import runlog as L
from strata.plans.catalog import register, table
from strata.plans.sqlgen import R
from strata.sources.sinks import result_contract

LOG_SQL = """(SELECT run_id, round_num, fe_code, 1 - cv_loss AS cv_score, cv_loss,
  delta, delta >= 0.005 AND status = 'complete' AS improved, status, executor_error, shap_top, shap_dead,
  best_model, shap_top AS new_features
FROM (SELECT 'conv_' || CAST(conv_id AS VARCHAR) AS run_id, CAST(turn AS INTEGER) AS round_num,
  'role=' || role AS fe_code, (length(text) % 97) / CAST(100 AS DOUBLE) AS cv_loss,
  CASE WHEN turn = 0 THEN NULL ELSE ((length(text) % 13) - 6) / CAST(1000 AS DOUBLE) END AS delta,
  CASE WHEN role = 'system' THEN 'failed' ELSE 'complete' END AS status,
  CASE WHEN role = 'system' THEN text END AS executor_error,
  regexp_extract_all(text, '[A-Za-z]{9,}', 0) AS shap_top,
  regexp_extract_all(text, '[A-Z][a-z]{6,}', 0) AS shap_dead,
  CASE WHEN length(text) % 2 = 0 THEN 'Random Forest' ELSE 'Logistic Regression' END AS best_model
  FROM conversations)) lg"""


def stand_in_log(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    delta = F.when(F.col("turn") == 0, F.lit(None).cast("double")).otherwise(((n % 13) - 6) / 1000.0)
    status = F.when(F.col("role") == "system", F.lit("failed")).otherwise(F.lit("complete"))
    loss = (n % 97) / 100.0
    return c.select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("run_id"),
        F.col("turn").cast("int").alias("round_num"),
        F.concat(F.lit("role="), F.col("role")).alias("fe_code"),
        (1 - loss).alias("cv_score"), loss.alias("cv_loss"), delta.alias("delta"),
        ((delta >= 0.005) & (status == "complete")).alias("improved"), status.alias("status"),
        F.when(F.col("role") == "system", F.col("text")).alias("executor_error"),
        F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), 0).alias("shap_top"),
        F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), 0).alias("shap_dead"),
        F.when(n % 2 == 0, F.lit("Random Forest")).otherwise(F.lit("Logistic Regression")).alias("best_model"),
        F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), 0).alias("new_features"))


BEST_SQL = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id
   ORDER BY coalesce(cv_loss, CAST('inf' AS DOUBLE)), round_num) AS rn
 FROM {LOG_SQL} WHERE status = 'complete' OR round_num = 0) WHERE rn = 1) b"""


@register("l_best_round", f"SELECT run_id, round_num, {R('cv_loss')} AS cv_loss FROM {BEST_SQL}")
def l_best_round(spark, sf_dir):
    """Best round per run: lowest loss among completed rounds, ties to the earliest (L1, L2)."""
    return L.best_rounds(stand_in_log(spark, sf_dir)).select(
        "run_id", "round_num", L.S.rnd(F.col("cv_loss"), 4).alias("cv_loss"))


_DELTA_SQL = ("CASE WHEN round_num = 0 THEN '—' WHEN delta > 0.001 THEN '▲ +' || printf('%.4f', delta) "
              "WHEN delta < -0.001 THEN '▼ ' || printf('%.4f', delta) ELSE '  ' || printf('%+.4f', delta) END")


@register("l_progression", f"""
SELECT run_id, round_num, CASE WHEN round_num = 0 THEN 'baseline' ELSE 'round ' || CAST(round_num AS VARCHAR) END AS label,
  {R('cv_score')} AS cv_score, {_DELTA_SQL} AS delta_text,
  CASE WHEN round_num = 0 THEN 'baseline'
       WHEN eff < coalesce(best_before, CAST('inf' AS DOUBLE)) THEN 'best' ELSE 'no improvement' END AS status
FROM (SELECT *, min(eff) OVER (PARTITION BY run_id ORDER BY round_num
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
      FROM (SELECT *, CASE WHEN status = 'complete' OR round_num = 0 THEN coalesce(cv_loss, CAST('inf' AS DOUBLE))
                 ELSE CAST('inf' AS DOUBLE) END AS eff FROM {LOG_SQL}))
""")
def l_progression(spark, sf_dir):
    """Score progression with running best and status per round."""
    return L.progression(stand_in_log(spark, sf_dir))


SUMMARY_SQL = f"""(SELECT base.run_id, {R('base.cv_score')} AS baseline_score, b.round_num AS best_round,
  {R('b.cv_score')} AS best_score, {R('base.cv_loss - b.cv_loss')} AS improvement,
  {R('(base.cv_loss - b.cv_loss) / greatest(base.cv_loss, 1e-9) * 100', 1)} AS improvement_pct,
  CAST(cnt.rounds_run AS BIGINT) AS rounds_run, b.best_model
FROM (SELECT * FROM {LOG_SQL} WHERE round_num = 0) base
LEFT JOIN {BEST_SQL} ON base.run_id = b.run_id
LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE round_num > 0) AS rounds_run FROM {LOG_SQL} GROUP BY run_id) cnt
  ON base.run_id = cnt.run_id) s"""


@register("l_summary", f"SELECT * FROM {SUMMARY_SQL}")
def l_summary(spark, sf_dir):
    """Baseline, best round, improvement and rounds per run."""
    return L.summary(stand_in_log(spark, sf_dir))


@register("l_recommendation", f"""
SELECT run_id, CASE WHEN best_round = 0 OR improvement < 0.001 THEN 'static' ELSE 'round ' || CAST(best_round AS VARCHAR) END AS recommendation,
  CASE WHEN best_round = 0 OR improvement < 0.001 THEN 0 ELSE best_round END AS use_round, best_model
FROM {SUMMARY_SQL}
""")
def l_recommendation(spark, sf_dir):
    """Static pipeline or the winning round, per run."""
    return L.recommendation(stand_in_log(spark, sf_dir))


@register("l_best_features", f"""
SELECT run_id, CAST(pos AS INTEGER) AS rank, feature FROM (
  SELECT run_id, unnest(shap_top) AS feature, generate_subscripts(shap_top, 1) AS pos FROM {BEST_SQL})
""")
def l_best_features(spark, sf_dir):
    """Ranked feature list of each run's best round."""
    return L.best_features(stand_in_log(spark, sf_dir))


@register("l_round_details", f"""
SELECT run_id, round_num, CASE WHEN improved THEN '✓' ELSE '✗' END AS mark,
  substring(coalesce(executor_error, ''), 1, 500) AS error, shap_top[1:5] AS top_features
FROM {LOG_SQL} WHERE round_num > 0
""")
def l_round_details(spark, sf_dir):
    """Round table: mark, error cut to 500 chars, top 5 features."""
    return L.round_details(stand_in_log(spark, sf_dir))


@register("l_best_code", f"SELECT run_id, round_num, coalesce(fe_code, '') AS fe_code FROM {BEST_SQL}")
def l_best_code(spark, sf_dir):
    """Definition of the winning candidate per run."""
    return L.best_code(stand_in_log(spark, sf_dir))


@register("l_output_rounds", f"""
SELECT run_id, round_num AS round, {R('cv_score')} AS cv_score, {R('delta')} AS delta, improved,
  coalesce(fe_code, '') AS fe_code, shap_top[1:5] AS top_features, coalesce(executor_error, '') AS executor_error
FROM {LOG_SQL} WHERE round_num > 0
""")
def l_output_rounds(spark, sf_dir):
    """Per-round rows of the result contract."""
    return L.output_rounds(stand_in_log(spark, sf_dir))


@register("l_best_accepted", f"""
SELECT a.run_id, a.round_num, a.new_features[1:6] AS new_features, {R('base.cv_loss - a.cv_loss')} AS gain
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(cv_loss, CAST('inf' AS DOUBLE)), round_num) AS rn
      FROM {LOG_SQL} WHERE improved) WHERE rn = 1) a
LEFT JOIN (SELECT run_id, cv_loss FROM {LOG_SQL} WHERE round_num = 0) base ON a.run_id = base.run_id
""")
def l_best_accepted(spark, sf_dir):
    """Best accepted round, its first six new features and its gain."""
    return L.best_accepted(stand_in_log(spark, sf_dir))


@register("l_result_facts", f"""
SELECT s.run_id, {R('s.best_score * 100', 1)} AS score, {R('s.baseline_score * 100', 1)} AS baseline,
  {R('s.improvement * 100', 2)} AS improvement_pts, s.best_model,
  list_transform(b.shap_top, lambda x: regexp_replace(x, '^(num|cat)__', ''))[1:8] AS top_features, s.rounds_run
FROM {SUMMARY_SQL} LEFT JOIN {BEST_SQL} ON s.run_id = b.run_id
""")
def l_result_facts(spark, sf_dir):
    """Fact table of a run: scores in %, improvement points, model, top 8 features."""
    return L.result_facts(stand_in_log(spark, sf_dir))


@register("a_result_contract")
def a_result_contract(spark, sf_dir):
    """JSON result document per run from the experiment log."""
    return result_contract(stand_in_log(spark, sf_dir))


@register("a_result_facts", f"""
WITH base AS (SELECT run_id, cv_score, cv_loss FROM {LOG_SQL} WHERE round_num = 0),
best AS (SELECT run_id, round_num, cv_score, cv_loss FROM {BEST_SQL}),
n AS (SELECT run_id, count(*) FILTER (round_num > 0) AS n_rounds, count(*) FILTER (round_num > 0 AND improved) AS n_improved FROM {LOG_SQL} GROUP BY run_id)
SELECT n.run_id, CASE WHEN coalesce(best.round_num, 0) > 0 OR coalesce(base.cv_score, 0) > 0 THEN 'complete' ELSE 'failed' END AS status,
  coalesce(best.round_num, 0) AS best_round, round(coalesce(best.cv_score, base.cv_score, 0), 4) AS cv_score, round(coalesce(base.cv_score, 0), 4) AS baseline_score,
  round(coalesce(best.cv_score, base.cv_score, 0) - coalesce(base.cv_score, 0), 4) AS delta, round(base.cv_loss, 4) AS baseline_loss, round(best.cv_loss, 4) AS best_loss,
  n_rounds, n_improved, CASE WHEN best.round_num IS NOT NULL THEN 'out/' || n.run_id || '/model' END AS model_path,
  'out/' || n.run_id || '/report.md' AS report_path, 'out/' || n.run_id AS output_dir
FROM n LEFT JOIN base USING (run_id) LEFT JOIN best USING (run_id)""")
def a_result_facts(spark, sf_dir):
    """The result document of every run, parsed again into columns."""
    docs = result_contract(stand_in_log(spark, sf_dir), "out", "report.md", "model")
    shape = ("status string, best_round int, cv_score double, baseline_score double, delta double, baseline_loss double, best_loss double, "
             "model_path string, rounds array<struct<round:int,improved:boolean>>, report_path string, output_dir string")
    d = docs.select("run_id", F.from_json("result_json", shape).alias("d"))
    fields = ["status", "best_round", "cv_score", "baseline_score", "delta", "baseline_loss", "best_loss", "model_path", "report_path", "output_dir"]
    return d.select("run_id", *[F.col(f"d.{c}").alias(c) for c in fields], F.size("d.rounds").cast("long").alias("n_rounds"),
                    F.size(F.filter("d.rounds", lambda r: r["improved"])).cast("long").alias("n_improved"))
