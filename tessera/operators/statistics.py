"""Column statistics from one frequency table.

All columns of a type class are unpivoted into (column, value) and counted once; distinct counts, null counts, common
values and histograms follow from those counts. Ranks are taken over range partitions and the partitions' totals, so no column
has to be sorted by one task. The counted values are written once by range, and all else reads that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import written
from tessera.sources.tables import type_class

CASTS = {"INT": "bigint", "FLOAT": "double", "STRING": "string", "TIME": "timestamp_ntz"}
BINS, COMMON_VALUES = 51, 100


def repeatable_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same ones on every run: those of least hash of their key."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for columns of one type class; value is typed as the class."""
    (kind,) = {type_class(df.schema[c].dataType) for c in columns}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(CASTS[kind]).alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.column", "p.value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def counts(freq: DataFrame) -> DataFrame:
    """(column, table_size, null_count, distinct_count)."""
    return freq.groupBy("column").agg(
        F.sum("n").alias("table_size"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
    )


def common_values(freq: DataFrame, k: int = COMMON_VALUES) -> DataFrame:
    """(column, place, value, n): the k most common non-null values; ties by value."""
    by = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return freq.where("value IS NOT NULL").withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).select("column", "place", "value", "n")


def _bins(n: Column, bins: int) -> Column:
    """Ranks of the bin bounds among n values: max(1, n - floor(n - i / bins * n)), in double arithmetic."""
    return F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.greatest(F.lit(1), n - F.floor(n - (i.cast("double") / F.lit(float(bins))) * n)))


def ordered(freq: DataFrame, partitions: int | None = None) -> DataFrame:
    """freq and part: the range partition of (column, value) that a row lies in, parts ascending with the values. Written once, so that
    the parts are the same to all that read it."""
    by = ("column", "value")
    ranges = freq.repartitionByRange(partitions, *by) if partitions else freq.repartitionByRange(*by)
    return written(ranges.withColumn("part", F.spark_partition_id()))


def _bounds(parted: DataFrame, bins: int) -> DataFrame:
    """(column, bound) of the rows of ordered() that are given."""
    # A row per column and partition: small, whatever the data.
    per_part = parted.groupBy("column", "part").agg(F.sum("n").alias("size"))
    by = Window.partitionBy("column")
    before = per_part.select("column", "part", "size", (F.sum("size").over(by.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(by).alias("total"))
    ranks = F.filter(_bins(F.col("total"), bins), lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("size")))
    # Only partitions with a rank in them are looked into.
    wanted = before.select("column", "part", "before", ranks.alias("ranks")).where(F.size("ranks") > 0)
    running = parted.join(F.broadcast(wanted), ["column", "part"]).withColumn("upto", F.sum("n").over(Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    high = F.col("before") + F.col("upto")
    return running.where(F.exists("ranks", lambda r: (r > high - F.col("n")) & (r <= high))).select("column", F.col("value").alias("bound"))


def _without_common(parted: DataFrame, bins: int, k: int) -> DataFrame:
    rest = parted.where("value IS NOT NULL").join(F.broadcast(common_values(parted, k).select("column", "value")), ["column", "value"], "left_anti")
    return _bounds(rest, bins)


def histogram(freq: DataFrame, bins: int = BINS, partitions: int | None = None) -> DataFrame:
    """(column, bound): upper bounds of equi-height bins, without repeats."""
    return _bounds(ordered(freq.where("value IS NOT NULL"), partitions), bins)


def histogram_without_common(freq: DataFrame, bins: int = BINS, k: int = COMMON_VALUES) -> DataFrame:
    """(column, bound) over the values that are not among the k most common; columns with k values or fewer have none."""
    return _without_common(ordered(freq.where("value IS NOT NULL")), bins, k)


def redundant_bins(bounds: Column, length: int, filler: Column) -> Column:
    """bounds stretched to length entries: each is repeated, the first ones once more; an empty array becomes fillers."""
    base, extra = F.floor(F.lit(length) / F.size(bounds)), F.lit(length) % F.size(bounds)
    stretched = F.flatten(F.transform(bounds, lambda x, i: F.array_repeat(x, (base + F.when(i < extra, 1).otherwise(0)).cast("int"))))
    return F.when(F.size(bounds) == 0, F.array_repeat(filler, length)).otherwise(stretched)


def filler_of(kind: str) -> str:
    """What an empty histogram of a type class is filled with."""
    return {"INT": "0", "FLOAT": "0", "STRING": "A", "TIME": "1970-01-01"}[kind]


def substring_support(df: DataFrame, column: str, min_share: float, most_per_length: int, longest: int = 25) -> DataFrame:
    """(substring, length, support): substrings of at most longest characters that at least min_share of the non-null
    rows hold, the most supported of each length, while every length has some, without those that a longer one outdoes."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("s"))
    distinct = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    least = rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(min_share))).alias("least"))
    length = F.char_length("s")
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.least(length, F.lit(longest))), lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.substring(F.col("s"), i, n))))
    parts = distinct.where(length > 0).select("n", F.explode(F.array_distinct(every)).alias("substring"))
    counted = parts.groupBy("substring").agg(F.sum("n").alias("support")).crossJoin(F.broadcast(least)).where("support >= least").withColumn("length", F.char_length("substring"))
    top = counted.withColumn("place", F.row_number().over(Window.partitionBy("length").orderBy(F.desc("support"), "substring"))).where(F.col("place") <= most_per_length)
    # At most longest * most_per_length rows from here on.
    reached = top.withColumn("nth", F.dense_rank().over(Window.orderBy("length"))).where("nth = length")
    longer = F.max("support").over(Window.orderBy(F.desc("length")).rangeBetween(Window.unboundedPreceding, -1))
    return reached.withColumn("outdone", longer).where("outdone IS NULL OR support >= outdone").select("substring", "length", "support")


def column_stats(df: DataFrame, table: str, bins: int = BINS, k: int = COMMON_VALUES) -> DataFrame:
    """One row per column that has a type class: counts, histogram, common values and the histogram without them, as strings."""
    out: DataFrame | None = None
    for kind in CASTS:
        columns = [f.name for f in df.schema.fields if type_class(f.dataType) == kind]
        if not columns:
            continue
        freq = ordered(frequencies(df, columns))
        text = lambda c: F.col(c).cast("string")
        gather = lambda h, name: h.groupBy("column").agg(F.transform(F.sort_array(F.collect_list("bound")), lambda x: x.cast("string")).alias(name))
        mcv = common_values(freq, k).groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", text("value").alias("value"), F.col("n").alias("count")))), lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("most_common_values"))
        one = counts(freq).join(gather(_bounds(freq.where("value IS NOT NULL"), bins), "histogram"), "column", "left").join(mcv, "column", "left").join(gather(_without_common(freq, bins, k), "histogram_mcv"), "column", "left")
        one = one.select(F.lit(table).alias("table"), "column", F.lit(kind).alias("dtype"), "table_size", F.col("table_size").alias("sample_size"), "null_count", "distinct_count", "histogram", "most_common_values", F.coalesce("histogram_mcv", F.array().cast("array<string>")).alias("histogram_mcv"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"{table} has no column that statistics can describe")
    return out


def describe_stats(stats: DataFrame) -> DataFrame:
    """Statistics as lines of text for a prompt."""
    return stats.select(F.format_string("%s.%s (%s): %d rows, %d nulls, %d distinct, bounds [%s]", "table", "column", "dtype", "table_size", "null_count", "distinct_count", F.array_join("histogram", ", ")).alias("line"))
