"""Cross-validation: folds, strata, out-of-fold metrics, leaderboard (survey 2.H).

Fold assignment is ``row_number() over (partition by stratum order by
md5(seed|key)) - 1`` modulo k, computed without one task per stratum: the
first hex digits of the hash split each stratum into ordered buckets, a
small table of bucket sizes gives each bucket's offset, and the row number
inside a bucket plus its offset equals the global row number.  A stratum
holding a third of the table is therefore spread over thousands of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import stats as S
from strata.functions.joins import join_small

PREFIX_HEX = 3          # 16^3 = 4096 ordered buckets per stratum to begin with
MAX_HEX = 7             # more digits are taken while buckets are large, up to 16^7
HOT_BUCKET_ROWS = 2_000_000   # a bucket above this holds many copies of one key: use the tie path
TIE_SALTS = 256
TIE_ROWS = 1_000_000          # rows per salted sub-partition of a hot group
NARROW_ROWS = 500_000         # above it rows go through the shuffle without key text, hashes and bucket offset
MAX_REG_STRATA = 10
# Rows above which the strata's edges take the bracketing plan (same values): the plain
# percentile merges a value -> count map of the whole column in one task.
EXACT_ROW_LIMIT = 500_000


def key_string(df: DataFrame, key_cols: list[str] | None) -> Column:
    """Row identity as text: the key columns, or the md5 of the whole row."""
    if key_cols:
        return F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns])))


def fold_hash(df: DataFrame, key_cols: list[str] | None, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key_string(df, key_cols)))


def assign_folds(df: DataFrame, k: int = 5, strata_col: str | None = None,
                 key_cols: list[str] | None = None, seed: int = 42, fold_col: str = "fold",
                 hot_bucket_rows: int = HOT_BUCKET_ROWS, narrow_rows: int | None = None) -> DataFrame:
    """Stratified, shuffled, seeded k-fold assignment (H1).

    Per stratum, rows ordered by md5(seed|key) are dealt round-robin into k
    folds, so per-stratum fold sizes differ by at most one.  Raises when k
    exceeds the size of every stratum (as scikit-learn does).  When a hash
    bucket is hot (many rows share one key, e.g. copies of one row), the
    copies are numbered through salted sub-partitions instead of one task.
    """
    # NULL is a stratum like any other
    st = F.coalesce(F.concat(F.lit("v"), F.col(strata_col).cast("string")), F.lit("n")) if strata_col else F.lit("v")
    hashable = [F.col(c) for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]

    def named(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("__key", key_string(df, key_cols))
                .withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__key"))))
                .withColumn("__row", F.xxhash64(*hashable)))

    plain = named(df.withColumn("__st", st))
    digits, before = PREFIX_HEX, None
    while True:
        keyed = plain.withColumn("__b", F.conv(F.substring("__h", 1, digits), 16, 10).cast("long"))
        counts = keyed.groupBy("__st", "__b").agg(F.count(F.lit(1)).alias("__cnt"))
        # one statistics job: largest stratum (validity), offsets table size (broadcast bound), largest bucket
        facts = (counts.groupBy("__st").agg(F.sum("__cnt").alias("n"), F.count(F.lit(1)).alias("nb"),
                                            F.max("__cnt").alias("mb"))
                 .agg(F.max("n").alias("largest"), F.sum("nb").alias("rows"), F.max("mb").alias("hot"), F.sum("n").alias("all")).first())
        hot = facts["hot"] or 0
        # more digits while that makes buckets smaller; a bucket that stays large holds copies of one key
        if hot <= hot_bucket_rows or digits >= MAX_HEX or (before is not None and hot > before / 2):
            break
        digits, before = digits + 1, hot
    w = Window.partitionBy("__st").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__st", "__b", F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__off"))
    if facts["largest"] is not None and facts["largest"] < k:
        raise ValueError(f"n_splits={k} cannot be greater than the number of members in each class")
    if hot > hot_bucket_rows:
        rn = _row_numbers_with_ties(keyed, offsets, facts["rows"] or 0, facts["hot"])
        return (rn.withColumn(fold_col, ((F.col("__rn") - 1) % k).cast("int"))
                .drop("__st", "__key", "__h", "__b", "__rn", "__row"))
    if (facts["all"] or 0) > (NARROW_ROWS if narrow_rows is None else narrow_rows):
        # a row's key and hashes follow from it: they are made again behind the shuffle, which is the window's own
        keyed = named(keyed.drop("__key", "__h", "__row").repartition("__st", "__b"))
    joined = join_small(keyed, offsets, ["__st", "__b"], "inner", rows=facts["rows"] or 0)
    wb = Window.partitionBy("__st", "__b").orderBy("__h", "__key", "__row")
    rn = F.col("__off") + F.row_number().over(wb)
    return (joined.withColumn(fold_col, ((rn - 1) % k).cast("int"))
            .drop("__st", "__key", "__h", "__b", "__off", "__row"))


def _row_numbers_with_ties(keyed: DataFrame, offsets: DataFrame, offset_rows: int, hot: int) -> DataFrame:
    """Global row numbers when one key (or one repeated row) fills a bucket.

    Distinct (key, row content) groups are ranked with the bucketed window —
    copies collapse map-side, so a hot group is one row there; the copies of
    a group are interchangeable and take consecutive numbers dealt over
    salted sub-partitions of about ``TIE_ROWS`` rows (a prefix table of at
    most groups x salts rows gives each sub-partition its start).  The salted
    rows are written to the shared checkpoint folder first, so every branch
    (and any recomputation after an executor loss) sees the same salts.
    """
    from strata.session import cut_lineage
    salts_n = max(TIE_SALTS, -(-hot // TIE_ROWS))
    row_hash = F.md5(F.to_json(F.struct(*[F.col(c) for c in keyed.columns
                                           if c not in ("__st", "__key", "__h", "__b", "__row")])))
    rows = cut_lineage(keyed.withColumn("__rh", row_hash)
                       .withColumn("__mono", F.monotonically_increasing_id())
                       .withColumn("__salt", F.pmod(F.xxhash64("__mono"), F.lit(salts_n)).cast("int")))
    gkeys = ["__st", "__b", "__h", "__key", "__rh"]
    groups = rows.groupBy(*gkeys).agg(F.count(F.lit(1)).alias("__g"))
    wg = Window.partitionBy("__st", "__b").orderBy("__h", "__key", "__rh").rowsBetween(Window.unboundedPreceding, -1)
    base = (join_small(groups, offsets, ["__st", "__b"], "inner", rows=offset_rows)
            .withColumn("__base", F.col("__off") + F.coalesce(F.sum("__g").over(wg), F.lit(0)))
            .select(*gkeys, "__base"))
    salts = rows.groupBy(*gkeys, "__salt").agg(F.count(F.lit(1)).alias("__sc"))
    ws = Window.partitionBy(*gkeys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    salt_off = salts.withColumn("__so", F.coalesce(F.sum("__sc").over(ws), F.lit(0))).drop("__sc")
    wr = Window.partitionBy(*gkeys, "__salt").orderBy("__mono")
    # the group's start goes to each of its salts first, so the rows of a hot group meet it in as many tasks
    starts = salt_off.join(base, gkeys)
    out = (rows.join(starts, gkeys + ["__salt"])
           .withColumn("__rn", F.col("__base") + F.col("__so") + F.row_number().over(wr)))
    return out.drop("__rh", "__salt", "__mono", "__base", "__so")


def regression_strata(df: DataFrame, target: str, k: int = 5, out_col: str = "stratum",
                      key_cols: list[str] | None = None, seed: int = 42,
                      exact: bool | str = "auto") -> DataFrame:
    """Quantile strata of a numeric target for stratified CV (H2-H4).

    q = max(2, min(10, n // k)) quantile bins with duplicate edges dropped,
    right-closed with the lowest value included (``pandas.qcut``).  Fewer
    than two strata -> two equal-width bins; still fewer -> hash parity.
    Edges are exact: in one aggregate up to ``EXACT_ROW_LIMIT`` rows, by
    bracketing above, also for ``exact=True`` (``exact=False`` asks for sketch
    edges instead).
    """
    y = F.col(target).cast("double")
    n = df.count()
    q = max(2, min(MAX_REG_STRATA, n // k))
    probs = [i / q for i in range(q + 1)]
    if exact is not False and n <= EXACT_ROW_LIMIT:
        row = df.agg(S.quantiles(y, probs, exact=True).alias("e"), F.min(y).alias("mn"),
                     F.max(y).alias("mx")).first()
        qs = row["e"]
    elif exact is not False:
        # large table: exact edges by bracketing (bounded memory)
        from strata.functions.quantiles import exact_quantiles
        qs = exact_quantiles(df.select(y.alias("__y")), ["__y"], probs)["__y"]
        row = {"mn": qs[0], "mx": qs[-1]}
    else:
        row = df.agg(S.quantiles(y, probs, exact=False).alias("e"), F.min(y).alias("mn"),
                     F.max(y).alias("mx")).first()
        qs = row["e"]
    edges = sorted(set(v for v in (qs or []) if v is not None))
    if len(edges) >= 3:
        inner = edges[1:-1]
        stratum = sum((F.when(y > F.lit(e), 1).otherwise(0) for e in inner), F.lit(0))
        return df.withColumn(out_col, F.when(y.isNotNull(), stratum.cast("int")))
    mn, mx = row["mn"], row["mx"]
    if mn is not None and mn != mx:
        mid = (mx - mn) / 2 + mn
        return df.withColumn(out_col, F.when(y.isNotNull(), F.when(y > F.lit(mid), 1).otherwise(0)))
    parity = F.conv(F.substring(fold_hash(df, key_cols, seed), 32, 1), 16, 10).cast("int") % 2
    return df.withColumn(out_col, parity)


# ---------------------------------------------------------------------------
# Metrics on an out-of-fold table (key, fold, y, prediction); ``by`` groups
# several models (or runs) so that all of them are scored in one job.
# ---------------------------------------------------------------------------

def fold_losses(oof: DataFrame, task: str, y: str = "y", pred: str = "prediction",
                by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Loss per fold (H7): 1 - accuracy, or RMSE. Output: *by, fold, loss.

    ``weight``, for classes: a column with the number of rows that each row stands for.
    """
    by = by or []
    if task == "classification":
        hit = F.col(y).eqNullSafe(F.col(pred))
        loss = 1.0 - (F.avg(hit.cast("double")) if weight is None else F.sum(F.when(hit, F.col(weight)).otherwise(0)) / F.sum(weight))
    else:
        loss = F.sqrt(F.avg(F.pow(F.col(y).cast("double") - F.col(pred).cast("double"), 2)))
    return oof.groupBy(*by, "fold").agg(loss.alias("loss"))


def cv_summary(losses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and population std of the fold losses (H8)."""
    by = by or []
    return losses.groupBy(*by).agg(F.avg("loss").alias("cv_loss_mean"),
                                   F.stddev_pop("loss").alias("cv_loss_std"))


def classification_metrics(oof: DataFrame, y: str = "y", pred: str = "prediction",
                           digits: int | None = 4, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """accuracy and support-weighted precision / recall / F1, 0/0 -> 0.

    The confusion counts are aggregated once; each confusion cell is then
    emitted twice (as its true class and as its predicted class) and summed
    per class, so per-class tp / support / predicted come from one
    ``groupBy`` over a table of at most classes^2 rows per group.
    """
    by = by or []
    conf = (oof.where(F.col(y).isNotNull())
            .groupBy(*by, F.col(y).cast("string").alias("t"), F.col(pred).cast("string").alias("p"))
            .agg((F.count(F.lit(1)) if weight is None else F.sum(weight).cast("bigint")).alias("n")))
    hit = F.col("t").eqNullSafe(F.col("p"))
    zero = F.lit(0).cast("bigint")
    roles = conf.select(*by, F.explode(F.array(
        F.struct(F.col("t").alias("c"), F.col("n").alias("support"),
                 F.when(hit, F.col("n")).otherwise(zero).alias("tp"), zero.alias("predicted")),
        F.struct(F.col("p").alias("c"), zero.alias("support"), zero.alias("tp"),
                 F.col("n").alias("predicted")))).alias("r"))
    per = roles.groupBy(*by, "r.c").agg(F.sum("r.support").alias("support"), F.sum("r.tp").alias("tp"),
                                        F.sum("r.predicted").alias("predicted"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    tot = F.sum("support")
    out = per.groupBy(*by).agg(
        F.try_divide(F.sum("tp").cast("double"), tot).alias("accuracy"),
        F.try_divide(F.sum(prec * F.col("support")), tot).alias("precision"),
        F.try_divide(F.sum(rec * F.col("support")), tot).alias("recall"),
        F.try_divide(F.sum(f1 * F.col("support")), tot).alias("f1"))
    if digits is None:
        return out
    return out.select(*by, *[S.rnd(F.col(c), digits).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def regression_metrics(oof: DataFrame, y: str = "y", pred: str = "prediction",
                       digits: int | None = 4, by: list[str] | None = None) -> DataFrame:
    """RMSE, MAE and R^2 in one aggregate (H13-H15); R^2 of a constant target is 1 or 0."""
    by = by or []
    yy = F.col(y).cast("double")
    e = yy - F.col(pred).cast("double")
    base = oof.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                                F.sum(e * e).alias("sse"), (F.var_pop(yy) * F.count(yy)).alias("sst"))
    return _regression(base, by, digits)


def _regression(base: DataFrame, by: list[str], digits: int | None) -> DataFrame:
    r2 = (F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))
          .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    out = base.select(*by, F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))
    if digits is None:
        return out
    return out.select(*by, *[S.rnd(F.col(c), digits).alias(c) for c in ("rmse", "mae", "r2")])


def tally(oof: DataFrame, task: str, by: list[str], weight: str | None = None) -> DataFrame:
    """What losses and metrics need of an out-of-fold table, from one pass and without its rows.

    Classes: the number ``n`` of each (*by, fold, y, prediction).  Regression: sums of the errors
    and moments of the label for each (*by, fold).
    """
    if task == "classification":
        n = F.count(F.lit(1)) if weight is None else F.sum(weight).cast("bigint")
        return oof.groupBy(*by, "fold", "y", "prediction").agg(n.alias("n"))
    y = F.col("y").cast("double")
    e = y - F.col("prediction").cast("double")
    return oof.groupBy(*by, "fold").agg(F.count(e).alias("ne"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"),
                                        F.count(y).alias("ny"), F.avg(y).alias("my"), F.var_pop(y).alias("vy"))


def tallied_losses(tallies: DataFrame, task: str, by: list[str]) -> DataFrame:
    """``fold_losses`` from a :func:`tally`."""
    if task == "classification":
        return fold_losses(tallies, task, by=by, weight="n")
    return tallies.select(*by, "fold", F.when(F.col("ne") > 0, F.sqrt(F.col("sse") / F.col("ne"))).alias("loss"))


def tallied_metrics(tallies: DataFrame, task: str, by: list[str], digits: int = 4) -> DataFrame:
    """``evaluate`` from a :func:`tally`."""
    if task == "classification":
        return classification_metrics(tallies, digits=digits, by=by, weight="n")
    mean = tallies.groupBy(*by).agg(F.try_divide(F.sum(F.col("my") * F.col("ny")), F.sum("ny")).alias("__m"))
    base = tallies.join(mean, by).groupBy(*by).agg(
        F.try_divide(F.sum("sse"), F.sum("ne")).alias("mse"), F.try_divide(F.sum("sae"), F.sum("ne")).alias("mae"), F.sum("sse").alias("sse"),
        F.sum(F.col("ny") * (F.col("vy") + F.pow(F.col("my") - F.col("__m"), 2))).alias("sst"))
    return _regression(base, by, digits)


def evaluate(oof: DataFrame, task: str, metrics: list[str] | None = None,
             y: str = "y", pred: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Requested metrics on the pooled OOF table, rounded 4; unknown names skipped."""
    by = by or []
    full = (classification_metrics(oof, y, pred, by=by) if task == "classification"
            else regression_metrics(oof, y, pred, by=by))
    if metrics is None:
        return full
    return full.select(*by, *[m for m in metrics if m in full.columns])


def leaderboard(oof: DataFrame, task: str, model_col: str = "model", y: str = "y",
                pred: str = "prediction", digits: int = 4, losses: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """One row per model: mean / population-std fold loss and pooled metrics.

    ``oof`` holds the out-of-fold predictions of all models (model, key,
    fold, y, prediction); every model is scored in the same jobs.  ``losses``
    and ``metrics``: its fold losses and its metrics by model, if they are known.
    """
    summ = cv_summary(losses if losses is not None else fold_losses(oof, task, y, pred, by=[model_col]), by=[model_col])
    mets = metrics if metrics is not None else evaluate(oof, task, y=y, pred=pred, by=[model_col])
    return (summ.join(mets, model_col)
            .select(model_col, S.rnd(F.col("cv_loss_mean"), digits).alias("cv_loss_mean"),
                    S.rnd(F.col("cv_loss_std"), digits).alias("cv_loss_std"),
                    *[c for c in mets.columns if c != model_col]))


def best_model(board: DataFrame, model_col: str = "model") -> DataFrame:
    """The model with the lowest mean loss; ties -> first by name."""
    return board.agg(F.min_by(F.col(model_col), F.struct("cv_loss_mean", model_col)).alias(model_col))


def rank_board(board: DataFrame, model_col: str = "model") -> DataFrame:
    """Add the leaderboard position (1 = lowest mean loss, ties by name)."""
    w = Window.orderBy(F.col("cv_loss_mean"), F.col(model_col))
    return board.withColumn("rank", F.row_number().over(w).cast("int"))
