"""Exact quantiles at any scale by bracketing (no single-task value map).

``percentile`` merges a value -> count map of the whole column in one task;
``percentile_approx`` is bounded but approximate.  Here:

1. one aggregate gives n and, per requested probability p, a bracket
   [L, H] from ``percentile_approx`` at p -/+ a margin; the sketch accuracy
   grows with n so that a bracket holds about ``bracket_rows`` values;
2. one aggregate counts, per bracket, the rows below L and inside [L, H] and
   checks that the two order statistics around p * (n - 1) fall inside
   (otherwise the margin widens and step 2 repeats);
3. the values inside each bracket are counted (``groupBy`` value, so one that
   repeats is a single row) and a window over these counts reads the two order
   statistics, interpolated linearly as Spark's ``percentile``; nothing is
   gathered into a list.

All columns and probabilities share the same three jobs; only two numbers
per (column, p) reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BRACKET_ROWS = 200_000
MIN_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    bracket_rows: int = BRACKET_ROWS) -> dict[str, list[float | None]]:
    """{column: [quantile per p]} with linear interpolation, exact."""
    if not columns:
        return {}
    x = {c: F.col(c).cast("double") for c in columns}
    counts = df.agg(*[F.count(x[c]).alias(c) for c in columns]).first().asDict()
    result = {c: [None] * len(probs) for c in columns}
    live = [c for c in columns if counts[c]]
    margin_mult = 2.0
    todo = {(c, i) for c in live for i in range(len(probs))}
    brackets: dict[tuple[str, int], tuple[float, float, int]] = {}
    for _ in range(4):
        if not todo:
            break
        # step 1: approximate brackets
        exprs, keys = [], []
        for c in sorted({c for c, _ in todo}):
            n = counts[c]
            acc = max(MIN_ACCURACY, math.ceil(4 * n / bracket_rows))
            m = margin_mult / acc
            ps = []
            for i in sorted(i for cc, i in todo if cc == c):
                ps += [max(0.0, probs[i] - m), min(1.0, probs[i] + m)]
                keys.append((c, i))
            exprs.append(F.percentile_approx(x[c], ps, acc).alias(c))
        approx = df.agg(*exprs).first().asDict()
        bounds = {}
        pos_in_col: dict[str, int] = {}
        for c, i in keys:
            j = pos_in_col.get(c, 0)
            bounds[(c, i)] = (approx[c][2 * j], approx[c][2 * j + 1])
            pos_in_col[c] = j + 1
        # step 2: ranks below / inside each bracket
        aggs = []
        for k, (c, i) in enumerate(keys):
            lo, hi = bounds[(c, i)]
            aggs += [F.count_if(x[c] < F.lit(lo)).alias(f"b{k}"),
                     F.count_if((x[c] >= F.lit(lo)) & (x[c] <= F.lit(hi))).alias(f"i{k}")]
        r = df.agg(*aggs).first()
        todo = set()
        for k, (c, i) in enumerate(keys):
            n = counts[c]
            pos = probs[i] * (n - 1)
            below, inside = r[f"b{k}"], r[f"i{k}"]
            if below <= math.floor(pos) and below + inside > math.ceil(pos):
                brackets[(c, i)] = (*bounds[(c, i)], below)
            else:
                todo.add((c, i))
        margin_mult *= 4
    for c, i in todo:   # still unresolved after widening: fall back to the exact map
        result[c][i] = df.agg(F.percentile(x[c], probs[i])).first()[0]
    if not brackets:
        return result
    # step 3: count the values inside each bracket (a repeated value is one row) and read the order statistics
    items = sorted(brackets)
    inside = F.filter(F.array(*[
        F.struct(F.lit(k).alias("k"), F.when((x[c] >= F.lit(brackets[c, i][0])) & (x[c] <= F.lit(brackets[c, i][1])), x[c]).alias("v"))
        for k, (c, i) in enumerate(items)]), lambda s: s["v"].isNotNull())
    held = df.select(F.explode(inside).alias("s")).groupBy("s.k", "s.v").agg(F.count(F.lit(1)).alias("n"))
    # distinct values of one bracket per window task: at most its rows but for repeated ones
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = df.sparkSession.createDataFrame(
        [(k, int(math.floor(probs[i] * (counts[c] - 1)) - brackets[c, i][2]), int(math.ceil(probs[i] * (counts[c] - 1)) - brackets[c, i][2]))
         for k, (c, i) in enumerate(items)], "k int, lo long, hi long")
    placed = held.select("k", "v", "n", upto.alias("upto")).join(F.broadcast(ranks), "k")  # one row per column and probability
    at = lambda r: (F.col(r) < F.col("upto")) & (F.col(r) >= F.col("upto") - F.col("n"))
    found = placed.where(at("lo") | at("hi")).groupBy("k").agg(F.max(F.when(at("lo"), F.col("v"))).alias("l"),
                                                               F.max(F.when(at("hi"), F.col("v"))).alias("h"))
    rows = {r["k"]: r for r in found.collect()}
    for k, (c, i) in enumerate(items):
        pos = probs[i] * (counts[c] - 1)
        lower, higher = math.floor(pos), math.ceil(pos)
        lv, hv = rows[k]["l"], rows[k]["h"]
        result[c][i] = lv if higher == lower else (higher - pos) * lv + (pos - lower) * hv
    return result


def quantiles_outside_folds(data: DataFrame, columns: list[str], probs: list[float], fold_col: str, k: int,
                            fills: dict | None = None, bracket_rows: int = BRACKET_ROWS) -> dict[int, dict[str, list]]:
    """{fold: {column: [quantile per p]}} over the rows outside each fold, exact, all folds in the same jobs.

    ``fills`` {fold: {column: (value, copies)}} adds copies of a value, as an
    imputer that replaced NULLs by it would.  Folds are numbered 0 to k - 1;
    a column without values there gives None.  The number of jobs depends
    neither on k nor on the columns: counts, (with fills) ranks of the fills,
    one sketch, one count of brackets, one selection.
    """
    if not columns:
        return {f: {} for f in range(k)}
    x = {c: F.col(c).cast("double") for c in columns}
    own = {r[fold_col]: r for r in data.groupBy(fold_col).agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(columns)]).collect()}
    n = {(c, f): sum(r[f"n{i}"] for g, r in own.items() if g != f) for i, c in enumerate(columns) for f in range(k)}
    copies = {(c, f): (fills or {}).get(f, {}).get(c) for c in columns for f in range(k)}
    filled = [key for key, v in copies.items() if v is not None and v[1]]
    at_fill = {}
    if filled:
        outside = lambda f: F.col(fold_col) != f
        row = data.agg(*[e for i, (c, f) in enumerate(filled) for e in (
            F.count_if(outside(f) & (x[c] < F.lit(copies[c, f][0]))).alias(f"b{i}"),
            F.count_if(outside(f) & (x[c] <= F.lit(copies[c, f][0]))).alias(f"u{i}"))]).first()
        at_fill = {key: (row[f"b{i}"], row[f"u{i}"]) for i, key in enumerate(filled)}

    def source(c: str, f: int, rank: int):
        """Rank among values and copies -> (True, the fill) or (False, rank among the values)."""
        if (c, f) not in at_fill:
            return False, rank
        below, upto = at_fill[c, f]
        value, extra = copies[c, f]
        if below <= rank < upto + extra:
            return True, value
        return False, rank if rank < below else rank - extra

    places: dict = {}   # (column, p, fold) -> (position, lower, upper)
    want: dict = {}     # (column, p) -> fold -> ranks among the values
    for c in columns:
        for j, p in enumerate(probs):
            for f in range(k):
                total = n[c, f] + (copies[c, f][1] if copies[c, f] is not None else 0)
                if not total:
                    continue
                pos = p * (total - 1)
                ends = [source(c, f, math.floor(pos)), source(c, f, math.ceil(pos))]
                places[c, j, f] = (pos, *ends)
                ranks = [r for known, r in ends if not known]
                if ranks:
                    want.setdefault((c, j), {})[f] = ranks
    values = _ranked_outside_folds(data, x, want, n, fold_col, k, bracket_rows)
    result: dict = {f: {c: [None] * len(probs) for c in columns} for f in range(k)}
    for (c, j, f), (pos, lower, upper) in places.items():
        lv, hv = (v if known else values[c, j, f, v] for known, v in (lower, upper))
        lo, hi = math.floor(pos), math.ceil(pos)
        result[f][c][j] = lv if lo == hi or lv == hv else (hi - pos) * lv + (pos - lo) * hv
    return result


def _ranked_outside_folds(data: DataFrame, x: dict, want: dict, n: dict, fold_col: str, k: int,
                          bracket_rows: int) -> dict:
    """{(column, p, fold, rank): value}: order statistics of the rows outside each fold.

    A bracket per (column, p) from one sketch of all rows serves every fold:
    folds are dealt at random, so a rank moves by about the root of the row
    count between them.  A bracket that misses a fold's rank is widened, in
    the end to the whole range.
    """
    bounds: dict = {}
    todo, widen = set(want), 1.0
    rows = {c: max(n[c, f] for f in range(k)) for c in {c for c, _ in want}}
    while todo:
        exprs, asked = [], sorted(todo)
        for c in sorted({c for c, _ in asked}):
            accuracy = max(MIN_ACCURACY, math.ceil(4 * rows[c] / bracket_rows))
            margin = widen * (2.0 / accuracy + 2.0 / math.sqrt(rows[c]))
            ps = []
            for key in (key for key in asked if key[0] == c):
                at = [r / max(1, n[c, f] - 1) for f, ranks in want[key].items() for r in ranks]
                ps += [max(0.0, min(at) - margin), min(1.0, max(at) + margin)]
            exprs.append(F.percentile_approx(x[c], ps, accuracy).alias(c))
        sketch = data.agg(*exprs).first()
        spans = {}
        for c in {c for c, _ in asked}:
            for i, key in enumerate(key for key in asked if key[0] == c):
                spans[key] = (sketch[c][2 * i], sketch[c][2 * i + 1])
        counted = {r[fold_col]: r for r in data.groupBy(fold_col).agg(*[e for i, key in enumerate(asked) for e in (
            F.count_if(x[key[0]] < F.lit(spans[key][0])).alias(f"b{i}"),
            F.count_if(x[key[0]].between(F.lit(spans[key][0]), F.lit(spans[key][1]))).alias(f"i{i}"))]).collect()}
        for i, key in enumerate(asked):
            below = {f: sum(r[f"b{i}"] for g, r in counted.items() if g != f) for f in want[key]}
            inside = {f: sum(r[f"i{i}"] for g, r in counted.items() if g != f) for f in want[key]}
            if all(below[f] <= min(ranks) and max(ranks) < below[f] + inside[f] for f, ranks in want[key].items()):
                bounds[key] = (*spans[key], below)
                todo.discard(key)
        widen *= 8
    if not bounds:
        return {}
    items = sorted(bounds)
    inside = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.when(
        x[c].between(F.lit(bounds[c, j][0]), F.lit(bounds[c, j][1])), x[c]).alias("v"))
        for i, (c, j) in enumerate(items)]), lambda s: s["v"].isNotNull())
    held = data.select(fold_col, F.explode(inside).alias("s")).groupBy("s.i", "s.v").agg(
        *[F.count_if(F.col(fold_col) != f).alias(f"n{f}") for f in range(k)])
    # distinct values of one bracket per window task
    w = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = held.select("i", "v", *[F.col(f"n{f}") for f in range(k)], *[F.sum(f"n{f}").over(w).alias(f"u{f}") for f in range(k)])
    slots = [(f, s) for f in range(k) for s in range(2)]

    def rank_of(i, f, s):
        ranks = want[items[i]].get(f)
        return ranks[min(s, len(ranks) - 1)] - bounds[items[i]][2][f] if ranks else None
    ranks = data.sparkSession.createDataFrame(
        [(i, *[rank_of(i, f, s) for f, s in slots]) for i in range(len(items))],
        "i int, " + ", ".join(f"r{f}_{s} long" for f, s in slots))
    # ranks: one row a column and probability
    found = upto.join(F.broadcast(ranks), "i").groupBy("i").agg(*[F.max(F.when(
        (F.col(f"r{f}_{s}") < F.col(f"u{f}")) & (F.col(f"r{f}_{s}") >= F.col(f"u{f}") - F.col(f"n{f}")),
        F.col("v"))).alias(f"v{f}_{s}") for f, s in slots]).collect()
    out = {}
    for r in found:
        c, j = items[r["i"]]
        for f, ranks_f in want[c, j].items():
            for s, rank in enumerate(ranks_f):
                out[c, j, f, rank] = r[f"v{f}_{s}"]
    return out
