"""Lenient typed CSV loading and RFC-4180 CSV writing."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vsframe.functions.scalar import TRUE_TOKENS, lenient, truthy

_TARGET = {
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def apply_types(
    df: DataFrame,
    types: Mapping[str, str] | None = None,
    truthy_columns: Iterable[str] | Mapping[str, Iterable[str]] = (),
) -> DataFrame:
    """Type text columns leniently, in place, keeping every other column as is.

    ``types`` maps column -> type name; malformed text becomes null. A column
    already of the target type is left alone (so typing twice is a no-op).
    ``truthy_columns`` become non-null booleans (true for the tokens, else false).
    """
    types = dict(types or {})
    if not isinstance(truthy_columns, Mapping):
        truthy_columns = {c: TRUE_TOKENS for c in truthy_columns}
    current = {f.name: f.dataType for f in df.schema.fields}
    exprs = []
    for name in df.columns:
        if name in truthy_columns:
            exprs.append(truthy(name, truthy_columns[name]).alias(name))
        elif name in types:
            target = _TARGET[types[name]]
            if current[name] == target:
                exprs.append(F.col(name))
            elif isinstance(current[name], T.StringType):
                exprs.append(lenient(name, types[name]).alias(name))
            else:
                exprs.append(F.col(name).try_cast(target).alias(name))
        else:
            exprs.append(F.col(name))
    missing = (set(types) | set(truthy_columns)) - set(df.columns)
    if missing:
        raise ValueError(f"columns not in input: {sorted(missing)}")
    return df.select(*exprs)


def read_typed_csv(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str] | None = None,
    truthy_columns: Iterable[str] | Mapping[str, Iterable[str]] = (),
    *,
    columns: Iterable[str] | None = None,
    multi_line: bool = False,
    null_value: str | None = None,
) -> DataFrame:
    """Read a headed CSV as text, then type the named columns leniently.

    Quotes are RFC 4180 (an inner quote is doubled). ``multi_line`` allows
    quoted newlines but makes each file a single task, since Spark cannot split
    such a file: keep it off for large single files, or land them as Parquet.
    Passing ``columns`` (in file order: they are applied by position) gives an
    all-text schema up front and skips the header probe job. Columns not named
    in ``types`` stay text.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
    )
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType(), True) for c in columns]))
    return apply_types(reader.csv(path), types, truthy_columns)


def write_csv(df: DataFrame, path: str, *, single_file: bool = False, mode: str = "overwrite") -> None:
    """Write a headed CSV that ``read_typed_csv`` reads back unchanged.

    Inner quotes are doubled (not backslash-escaped), so text round-trips.
    A null and an empty string both come back as null. ``single_file``
    coalesces to one writer task: for small results only.
    """
    out = df.coalesce(1) if single_file else df
    (
        out.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
