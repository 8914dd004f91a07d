"""Keyed writes over Parquet folders (S8-S11): new rows are told from old ones by joins, folders are only added to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import new_path


def new_rows(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys existing lacks; of rows that share new keys one stays."""
    return df.dropDuplicates(keys).join(existing, keys, "left_anti")


def insert_ignore(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the new rows to a table folder; running it again adds nothing."""
    spark = df.sparkSession
    new_rows(df, spark.read.schema(df.schema).parquet(path), keys).write.mode("append").parquet(path)


def upserted(df: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """base with rows of df by key: what df gives replaces, its nulls leave the old value, new keys are added."""
    new = df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in df.columns if c not in keys])
    on = [base[k] == F.col(f"_k_{k}") for k in keys]
    return base.join(new, on, "full").select(
        *[F.coalesce(base[k], F.col(f"_k_{k}")).alias(k) for k in keys],
        *[(F.coalesce(F.col(f"_n_{c}"), base[c]) if c in df.columns else base[c]).alias(c) for c in base.columns if c not in keys])


def upsert(df: DataFrame, base: DataFrame, keys: list[str], path: str) -> None:
    """Write the updated table as a new version folder; readers move to it once it is complete."""
    upserted(df, base, keys).write.mode("errorifexists").parquet(path)


def replace_children(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """base with all rows of the parents that rows has replaced by rows."""
    return base.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def write_parts(df: DataFrame, path: str, key: str, parts: int) -> None:
    """A new table folder in parts by a hash of key, in which ``replace_parts`` can replace parents."""
    df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartition("part").write.mode("errorifexists").partitionBy("part").parquet(path)


def replace_parts(rows: DataFrame, path: str, key: str, parts: int) -> None:
    """Replace the children of all parents that rows has, in place: only the parts with such parents are read and written.

    The new parts are written beside the table first, so no file is read while it is replaced, and running it again
    gives the same table. rows has the table's columns.
    """
    spark = rows.sparkSession
    schema = rows.withColumn("part", F.lit(0)).schema
    new = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    touched = sorted(r.part for r in new.select("part").distinct().collect())  # at most ``parts`` numbers
    old = spark.read.schema(schema).parquet(path).where(F.col("part").isin(touched))
    beside = new_path(spark, "parts")
    old.join(rows.select(key).distinct(), key, "left_anti").unionByName(new).write.parquet(beside)
    (spark.read.schema(schema).parquet(beside).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path))
