"""Reading and writing the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Folders that the tables of an index are split into, by document.
BUCKETS = 64


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """Writes the tables of an index below a path, those with documents in buckets of these (``_bucket``)."""
    for name, table in tables.items():
        if "document_id" in table.columns:
            bucket = F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")
            table.withColumn("_bucket", bucket).repartitionByRange("_bucket", "document_id").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/{name}")
        else:
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}").drop("_bucket") for name in names}


def of_document(spark: SparkSession, path: str, name: str, document_id: str) -> DataFrame:
    """The rows of one document of a saved table; only its bucket is read."""
    bucket = F.pmod(F.xxhash64(F.lit(document_id)), F.lit(BUCKETS)).cast("int")
    return spark.read.parquet(f"{path}/{name}").filter((F.col("_bucket") == bucket) & (F.col("document_id") == document_id)).drop("_bucket")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str, order: str = "line_no", column: str = "line") -> None:
    """Writes the lines of a report, in order, as text files whose names follow that order."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: an upsert that replaces earlier versions."""
    last = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def formula_tables(formulas: DataFrame) -> dict[str, DataFrame]:
    """The normal form of a formula table: one table for the formulas and one for each list column."""
    plain = formulas.drop("variables", "operators", "functions", "depends_on")
    tables = {"formulas": plain}
    for column, name, single in (("variables", "formula_variables", "variable"), ("operators", "formula_operators", "operator"), ("functions", "formula_functions", "function"), ("depends_on", "formula_dependencies", "depends_on")):
        if column in formulas.columns:
            tables[name] = formulas.select("formula_id", F.explode(column).alias(single)).distinct()
    return tables
