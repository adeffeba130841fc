"""Sources and sinks: table scans, typed CSV, extracts, catalog views."""

from ledgerline.sources.tables import TABLES, load, register_views
from ledgerline.sources.files import (append_load, empty_clone, read_typed_csv,
                                      schema_catalog, write_extract)

__all__ = ["TABLES", "load", "register_views", "append_load", "empty_clone",
           "read_typed_csv", "schema_catalog", "write_extract"]
