"""Sources and sinks (survey section 2.A)."""

from strata.sources.readers import (
    PANDAS_NA_TOKENS,
    canonical_nulls,
    infer_types,
    inf_to_null,
    read_csv,
    read_table,
    require_column,
)
from strata.sources.sinks import (
    load_pipeline,
    make_run_id,
    result_contract,
    sanitize_doubles,
    save_pipeline,
    write_table,
    write_tables,
)

__all__ = [
    "PANDAS_NA_TOKENS", "canonical_nulls", "infer_types", "inf_to_null", "read_csv",
    "read_table", "require_column", "load_pipeline", "make_run_id", "result_contract",
    "sanitize_doubles", "save_pipeline", "write_table", "write_tables",
]
