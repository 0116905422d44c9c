"""Tables as Parquet files: reading, registering, describing and exporting them; and the foreign keys between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FACT_TABLES = ("lineitem", "orders", "events", "labels")


@dataclass(frozen=True)
class ForeignKey:
    """table.column refers to to_table.to_column."""

    table: str
    column: str
    to_table: str
    to_column: str


FOREIGN_KEYS = (
    ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    ForeignKey("labels", "doc_id", "documents", "doc_id"),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
    ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
    ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
)


def path_of(sf_dir: str, table: str) -> str:
    return f"{sf_dir}/{table}.parquet"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(path_of(sf_dir, table))


def register(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> None:
    """Temporary views over the Parquet files, named as the tables."""
    for t in tables:
        read(spark, sf_dir, t).createOrReplaceTempView(t)


def tables_of(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)


def columns_of(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Name, type and nullability of each column."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]


def type_class(kind: T.DataType) -> str:
    """INT, FLOAT, STRING, TIME, or OTHER for what predicates and histograms don't take."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT"
    if isinstance(kind, T.StringType):
        return "STRING"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "TIME"
    return "OTHER"


def schema_classes(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> dict[str, dict[str, str]]:
    return {t: {f.name: type_class(f.dataType) for f in read(spark, sf_dir, t).schema.fields} for t in tables}


def export(df: DataFrame, root: str, table: str, overwrite: bool = False) -> str:
    """Write df under root/table; an existing table is an error unless overwrite is set."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{root}/{table}")
    return f"{root}/{table}"


def table_size(df: DataFrame) -> int:
    return df.count()
