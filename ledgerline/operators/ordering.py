"""Presentation order (O1-O3). Results are sets until presented; a final
``ORDER BY`` is a range-partitioned sort (no single task), applied only
where the report asks for it.

PostgreSQL places NULLs last in ascending and first in descending order;
Spark (like T-SQL and MySQL) does the opposite by default, so the NULL
placement is always spelled out here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, StructType, VariantType


def key(c: Column | str, descending: bool = False, nulls: str = "postgres") -> Column:
    """Sort key with explicit NULL placement: ``nulls`` is ``"postgres"``
    (NULLs count as largest), ``"first"`` or ``"last"``."""
    col = F.col(c) if isinstance(c, str) else c
    if nulls == "postgres":
        return col.desc_nulls_first() if descending else col.asc_nulls_last()
    if nulls == "first":
        return col.desc_nulls_first() if descending else col.asc_nulls_first()
    return col.desc_nulls_last() if descending else col.asc_nulls_last()


def present(df: DataFrame, *keys: Column) -> DataFrame:
    """``ORDER BY keys`` as the last step of a report. Rows with equal keys
    are ordered by their other columns, so that a value that most rows have is
    split between range partitions like any other."""
    names = [c.lower() for c in df.columns]
    once = [f for f in df.schema.fields if names.count(f.name.lower()) == 1]
    rest = [F.col("`" + f.name.replace("`", "``") + "`") for f in once if _sortable(f.dataType)]
    return df.orderBy(*keys, *rest)


def _sortable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    return not isinstance(kind, CalendarIntervalType | MapType | VariantType)
