"""The function catalogue's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.catalogue import category_queries
from tessera.registry import register
from tessera.sources.tables import TABLES
from tessera.sources.tables import register as register_tables


def over_views(text: str):
    """A query function that registers the tables and runs the text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_tables(spark, sf_dir, tuple(t for t in TABLES if t in text))
        return spark.sql(text)

    return run


for _name, (_spark, _other) in category_queries().items():
    register(_name, over_views(_spark), _other)
