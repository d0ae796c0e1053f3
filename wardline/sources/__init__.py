"""Sources (parquet tables, CSV with explicit schema, stacked lookup files) and sinks."""

from wardline.sources.tables import (  # noqa: F401
    ENCOUNTER_SCHEMA, read_csv, read_lookup_file, read_table,
)
