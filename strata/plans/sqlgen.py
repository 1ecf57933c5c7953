"""Small text helpers that write the oracle SQL for many columns at once."""

from __future__ import annotations


def R(expr: str, d: int = 4) -> str:
    """Round half up by IEEE arithmetic, the same rule as ``stats.rnd``."""
    x = f"CAST({expr} AS DOUBLE)"
    return f"(CASE WHEN abs({x}) * 1e{d} < 4.5e15 THEN floor({x} * 1e{d} + 0.5) / 1e{d} ELSE {x} END)"


def profile_row_sql(table_sql: str, col: str, dtype: str, numeric: bool) -> str:
    """One row of the column profile in DuckDB SQL."""
    x = f"CAST({col} AS DOUBLE)"
    if numeric:
        stats = (f"{R(f'avg({x})')} AS mean, {R(f'stddev_samp({x})')} AS std, "
                 f"{R(f'min({x})')} AS min, {R(f'max({x})')} AS max, "
                 f"{R(f'quantile_cont({x}, 0.5)')} AS median, "
                 f"CASE WHEN count({x}) < 3 THEN NULL ELSE {R(f'coalesce(skewness({x}), 0)')} END AS skew")
    else:
        stats = ("CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, "
                 "CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS skew")
    return (f"SELECT '{col}' AS col, '{dtype}' AS dtype, {str(numeric).upper()} AS is_numeric, "
            f"CAST(count(*) - count({col}) AS BIGINT) AS null_count, "
            f"{R(f'coalesce((count(*) - count({col})) / count(*), 0)')} AS null_rate, "
            f"CAST(count(DISTINCT {col}) AS BIGINT) AS cardinality, "
            f"{R(f'coalesce(count(DISTINCT {col}) / count(*), 0)')} AS cardinality_rate, "
            f"{stats} FROM {table_sql}")


def profile_sql(table_sql: str, cols: list[tuple[str, str, bool]]) -> str:
    return "\nUNION ALL\n".join(profile_row_sql(table_sql, c, d, n) for c, d, n in cols)
