"""Exact deduplication with the keyed state of Structured Streaming.

A stream of (digest, identifier, locator) updates one state entry a digest, held in RocksDB without a watermark, so
no entry ever expires. The state is then read as a table; for every digest that was hit more than once, the full
normalised bytes of each member are compared with those of the member that stays, fetched by its locator. Texts whose
digests agree but whose bytes differ form classes of their own. DataFrame and SQL operations only.

The state may be kept in a folder and gone on with: a later run's rows then meet all that earlier runs have seen, whose texts
are fetched by locator where a digest is hit, so the files of earlier runs must still be there.

Defined results: a null text is the empty text; rows that repeat a doc_id are told apart by their locator, of which
exactly one stays in a class; a null doc_id loses to any other; an empty table gives no rows; of the caller's
columns, whose names are free, only doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ascii_lower, documents, located, removed_at_end, shared_dir, written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of the narrow feed that one micro-batch takes in.
FEED_BYTES = 16 << 30


@contextmanager
def _settings(spark: SparkSession, **values: str):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _feeds(spark: SparkSession, top: str) -> list[str]:
    """The folders of the feeds that were put into the state folder top, one a run."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top}/feed")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().toString() for x in files.listStatus(where)) if files.exists(where) else []


def keyed_state(spark: SparkSession, top: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream what is new below top/feed (digest, who) through the keyed state in top: (digest, keep, hits) of all that was ever seen."""
    at = f"{top}/state"
    # Space is not allocated ahead: a store for every partition would take megabytes while it is still empty.
    with _settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false"):
        reader = spark.readStream.schema(schema)
        reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader.option("maxBytesPerTrigger", FEED_BYTES)
        seen = reader.parquet(f"{top}/feed/*").groupBy("digest").agg(F.max("who").alias("keep"), F.count(F.lit(1)).alias("hits"))
        query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(at)
        # Written, as the state store's provider is a setting of the reading session.
        values = state.schema["value"].dataType.names
        return written(state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{values[0]}`").alias("keep"), F.col(f"value.`{values[1]}`").alias("hits")))


def _who() -> Column:
    return F.struct("doc_id", F.col("__at.file").alias("file"), F.col("__at.index").alias("index")).alias("who")


def _earlier_texts(spark: SparkSession, feeds: list[str], schema: T.StructType, hit: DataFrame) -> DataFrame | None:
    """who and norm of the rows of earlier runs under the digests of hit, fetched by their locators."""
    old = spark.read.schema(schema).parquet(*feeds).join(hit.select("digest"), "digest", "left_semi").select("who")
    files = [r.file for r in old.select("who.file").distinct().collect()]  # names of files, which are few beside their rows
    if not files:
        return None
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index")).alias("__at")
    texts = spark.read.parquet(*files).select("doc_id", ascii_lower(F.col("text")).alias("norm"), at).select(_who(), "norm")
    return texts.join(old, "who", "left_semi")


def _classed(rows: DataFrame, top: str, digest: Callable[[Column], Column] | None, files_per_batch: int | None) -> DataFrame:
    """For each of the located rows: who, sha (binary), keep (who of the row that stays), group_size."""
    spark = rows.sparkSession
    sha = lambda t: F.unhex(F.sha2(t, 256))
    digest = digest or sha
    norm = rows.select(_who(), ascii_lower(F.col("text")).alias("norm"))
    before = _feeds(spark, top)
    told = norm.select(digest(F.col("norm")).alias("digest"), "who", sha(F.col("norm")).alias("sha"))
    own = f"{top}/feed/{uuid.uuid4().hex}"
    told.write.parquet(own)
    feed = spark.read.schema(told.schema).parquet(own)
    if not feed.take(1):
        return feed.select("who", "sha", F.col("who").alias("keep"), F.lit(1).cast("long").alias("group_size")).limit(0)
    state = keyed_state(spark, top, told.schema, files_per_batch)
    hit = state.where("hits > 1")
    if before:
        hit = written(hit.join(feed.select("digest").distinct(), "digest", "left_semi"))
        earlier = _earlier_texts(spark, before, told.schema, hit)
        norm = norm if earlier is None else norm.unionByName(earlier)
    member = written(norm.select(digest(F.col("norm")).alias("digest"), "who", "norm").join(hit, "digest"))
    stays = member.where("who <=> keep").select("digest", F.col("norm").alias("kept_norm"))
    odd = member.join(stays, "digest").where("norm != kept_norm").select("digest", "who", "norm")
    # Texts that share a digest without being equal: hardly ever any.
    odd_class = odd.groupBy("digest", "norm").agg(F.max("who").alias("odd_keep"), F.count(F.lit(1)).alias("odd_size"))
    odd_row = written(odd.join(odd_class, ["digest", "norm"]).select("digest", "who", "odd_keep", "odd_size"))
    less = odd_row.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    known = feed.join(state, "digest")
    if odd_row.take(1):
        out = known.join(less, "digest", "left").join(odd_row.drop("digest"), "who", "left")
    else:
        out = known.withColumns({"less": F.lit(0), "odd_keep": F.lit(None).cast(feed.schema["who"].dataType), "odd_size": F.lit(None).cast("long")})
    return out.select("who", "sha", F.coalesce("odd_keep", "keep").alias("keep"), F.coalesce("odd_size", F.col("hits") - F.coalesce("less", F.lit(0))).alias("group_size"))


def classes(docs: DataFrame, digest: Callable[[Column], Column] | None = None, files_per_batch: int | None = None, state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The located rows of docs, and for each of them who, sha (binary), keep (who of the row that stays) and group_size.

    digest: of the normalised text; SHA-256 unless a test asks for a weaker one. state: a folder that holds the state of earlier
    runs, with which this one goes on, or which it begins; without it the state goes when the driver ends.
    """
    spark = docs.sparkSession
    top = state.rstrip("/") if state else shared_dir(spark)
    rows = located(docs, f"{top}/texts/{uuid.uuid4().hex}" if state else None)
    try:
        return rows, _classed(rows, top, digest, files_per_batch)
    finally:
        if not state:
            removed_at_end(spark, top)


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    _, out = classes(docs, **options)
    kept = F.col("who").eqNullSafe(F.col("keep"))
    return out.select("who.doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows, out = classes(docs, **options)
    gone = out.where(~F.col("who").eqNullSafe(F.col("keep"))).select(F.struct("who.file", "who.index").alias("__at"))
    return rows.join(gone, "__at", "left_anti").select("__row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP5_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
