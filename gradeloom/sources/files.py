"""Sinks, the JDBC source, and tables written along the way. Every sink takes a folder and writes in parallel."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process
    does the warehouse serve in its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or spark.conf.get('spark.sql.warehouse.dir')}/gradeloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: worked out once, however often it is read."""
    df.write.parquet(path := folder(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _or_na(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("N/A"))


def users_report(users: DataFrame) -> DataFrame:
    """The 14 columns of the user and fee report; what is missing is N/A."""
    stamp = lambda c: F.coalesce(F.date_format(c, ISO), F.lit("N/A"))
    return users.select(
        F.col("id").cast("string").alias("ID"), F.col("email").alias("Email"), _or_na(F.col("full_name")).alias("Full_Name"), F.col("role").alias("Role"), _or_na(F.nullif(F.col("grade"), F.lit(0))).alias("Grade"),
        _or_na(F.col("standard")).alias("Standard"), F.col("is_paid").alias("Paid"), _or_na(F.col("payment_id")).alias("Payment_ID"), _or_na(F.col("payment_status")).alias("Payment_Status"),
        F.col("fee_override").alias("Fee_Override"), F.col("is_fee_exempt").alias("Fee_Exempt"), stamp("premium_expiry").alias("Premium_Expiry"), stamp("created_at").alias("Created_At"), stamp("last_active_at").alias("Last_Active"),
    )


def users_sheet(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").cast("string").alias("ID"), F.col("email").alias("Email"), _or_na(F.col("full_name")).alias("Full_Name"), F.col("role").alias("Role"), F.lit(True).alias("Active"), F.col("is_premium").alias("Premium"), F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("N/A")).alias("Created_At"))


def write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """CSV with a header; ``partition_by`` gives each of its values a folder, with one file unless Spark splits a large one."""
    writer = (df.repartition(partition_by) if partition_by else df).write.mode("overwrite").option("header", True).option("quoteAll", True).option("emptyValue", "").option("nullValue", "\\N")
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("emptyValue", "").option("nullValue", "\\N").csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A database table by ranges of a number column, read in parallel. Rows without a number, and rows outside of the
    bounds, are read too, with the first and the last range."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=partitions, properties=options)
