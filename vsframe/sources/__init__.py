"""Sources and sinks: typed CSV in, CSV out, and the supplied Parquet tables."""

from vsframe.sources.csv import apply_types, read_typed_csv, write_csv
from vsframe.sources.tables import Tables

__all__ = ["Tables", "apply_types", "read_typed_csv", "write_csv"]
