"""Folders of Parquet files that were written under several schemas, read under one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def with_defaults(schema: T.StructType, defaults: dict[str, object]) -> T.StructType:
    """``schema`` whose columns have defaults for files without them; a null that a file holds stays null."""
    def sql(v: object) -> str:
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(v).lower() if isinstance(v, bool) else repr(v)

    field = lambda f: T.StructField(f.name, f.dataType, True, f.metadata | {"CURRENT_DEFAULT": sql(defaults[f.name]), "EXISTS_DEFAULT": sql(defaults[f.name])})
    return T.StructType([field(f) if f.name in defaults else f for f in schema.fields])


def read_versions(spark: SparkSession, path: str, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """All files below ``path`` under ``schema``: columns that a file lacks get their default (else null), numbers widen from
    the file's type where nothing is lost (int to long or double, float to double), columns that the schema lacks are left out. The reader does it file by file: columns and filters still
    reach the scan."""
    return spark.read.schema(with_defaults(schema, defaults or {})).option("recursiveFileLookup", True).parquet(path)
