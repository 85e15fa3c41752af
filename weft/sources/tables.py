"""Readers with a given schema, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scan_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return (
        spark.read.schema(schema).option("sep", sep).option("header", header)
        .option("multiLine", False).option("escape", '"').csv(path)
    )


def scan_json_index(spark: SparkSession, path: str, record: str, key: str = "idx", whole_file: bool = False) -> DataFrame:
    """Files of ``{index: record}`` maps, one map per line (or per file), sorted by index."""
    raw = spark.read.option("wholetext", whole_file).text(path)
    maps = raw.select(F.from_json("value", f"map<string,struct<{record}>>").alias("m"))
    return (
        maps.select(F.explode("m").alias(key, "rec"))
        .select(F.col(key).cast("bigint").alias(key), "rec.*")
        .orderBy(key)
    )


def scan_table(spark: SparkSession, path: str, order: list[str] | None = None, n: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.orderBy(*order).limit(n) if n is not None else df


def scan_vectors(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    return spark.read.parquet(path).select(key, F.col(vector).cast("array<double>").alias(vector))


def corpus_by_category(df: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Documents that fall in one of the named groups; ``label`` is the group's number."""
    label = F.coalesce(*[F.when(cond, F.lit(i)) for i, cond in enumerate(groups.values())])
    return df.withColumn("label", label.cast("int")).filter(F.col("label").isNotNull())


def sink_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    df.write.option("header", header).option("sep", sep).option("escape", '"').csv(path)


def sink_json(df: DataFrame, path: str) -> None:
    """Values only: one record per line, nested columns kept."""
    df.write.json(path)


def sink_json_index(df: DataFrame, path: str, key: str, chunk: int = 1000) -> None:
    """``{index: record}`` maps, one line per ``chunk`` consecutive index values."""
    rec = F.struct(*[c for c in df.columns if c != key])
    lines = (
        df.groupBy(F.floor(F.col(key) / chunk).alias("_c"))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), rec))).alias("m"))
        .select(F.to_json("m").alias("value"))
    )
    lines.write.text(path)


def keyed_columns(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """The key first, then one column per dimension."""
    return df.select(key, *[F.col(vector)[k].alias(f"v{k}") for k in range(dim)])


def sink_vectors_keyed(df: DataFrame, path: str, key: str, vector: str, dim: int) -> None:
    sink_csv(keyed_columns(df, key, vector, dim), path, header=True)


def sink_text(df: DataFrame, path: str, tokens: str) -> None:
    """One line per document, tokens joined by spaces."""
    df.select(F.concat_ws(" ", tokens).alias("value")).write.text(path)
