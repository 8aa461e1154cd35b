from panelwright.sources.columns import ColumnsMissing, clean_names, resolve_columns, standardize_actor, standardize_long, validate_schema
from panelwright.sources.files import (
    LONG_SCHEMA,
    durable,
    read_indicator_csv,
    read_with_quarantine,
    scratch_path,
    write_table,
    written,
)

__all__ = [
    "ColumnsMissing", "LONG_SCHEMA", "clean_names", "durable", "read_indicator_csv", "read_with_quarantine",
    "resolve_columns", "scratch_path", "standardize_actor", "standardize_long", "validate_schema", "write_table", "written",
]
