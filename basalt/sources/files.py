"""Sources and sinks: files with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def copy_from(spark: SparkSession, path: str, schema: str, fmt: str = "text", delimiter: str | None = None, header: bool = False, null: str | None = None) -> DataFrame:
    """COPY … FROM: text (tab) or csv, quotes doubled inside quotes. The schema is declared, so nothing is read twice."""
    sep = delimiter or ("," if fmt == "csv" else "\t")
    empty = null if null is not None else "" if fmt == "csv" else "\\N"
    return spark.read.csv(path, schema=schema, sep=sep, header=header, quote='"', escape='"', nullValue=empty, mode="FAILFAST")


def copy_to(df: DataFrame, path: str, fmt: str = "text", delimiter: str | None = None, header: bool = False) -> None:
    sep = delimiter or ("," if fmt == "csv" else "\t")
    df.write.mode("overwrite").csv(path, sep=sep, header=header, quote='"', escape='"', nullValue="" if fmt == "csv" else "\\N")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def write_partitioned(df: DataFrame, path: str, by: list[str], sort: list[str] = (), mode: str = "append") -> None:
    """Append Parquet in directories by `by`; rows of a directory meet first, so that each gets few files.
    Sorting within files gives row groups whose statistics prune."""
    rows = df.repartition(*[F.col(c) for c in by])
    rows = rows.sortWithinPartitions(*by, *sort) if sort else rows
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, key: list[str]) -> None:
    """A table whose joins on the key need no shuffle."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)


def jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A table over JDBC, read in `parts` ranges of a numeric column; the driver's jar must be on the class path."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=options)


def catalog_tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables of the session's current database and temporary views."""
    rows = [(t.catalog, t.namespace[0] if t.namespace else None, t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")


def catalog_columns(spark: SparkSession, table: str) -> DataFrame:
    """information_schema.columns of one table."""
    fields = spark.table(table).schema.fields
    rows = [(table, f.name, i + 1, "YES" if f.nullable else "NO", f.dataType.simpleString()) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


class MaterializedView:
    """A stored snapshot of a query. refresh() writes a new one beside the old and then points to it, so
    that readers never see half of one."""

    def __init__(self, spark: SparkSession, path: str, query: str):
        self.spark, self.path, self.query, self.version = spark, path, query, 0

    def refresh(self) -> None:
        self.spark.sql(self.query).write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        self.version += 1

    def read(self) -> DataFrame:
        if not self.version:
            raise ValueError("not refreshed yet")
        return self.spark.read.parquet(f"{self.path}/v{self.version}")
