"""What the operators of this subpackage share: tables, the shared folder, words and vectorised hashing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: the six ASCII white-space characters, and nothing else.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (local mode)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "/tmp/checkpoints"
    return f"{top.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete path when it ends, whether or not the session was stopped before."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives lost executors. Deleted when the driver ends."""
    spark = df.sparkSession
    path = shared_dir(spark)
    try:
        df.write.parquet(path)
    finally:
        removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z alone become a-z; null counts as empty. Pure ASCII takes the byte-wise path of lower()."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def texts_of(batch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def _is_scan(docs: DataFrame) -> bool:
    """Whether docs is a projection or a fixed choice of the rows of files, so that a row's place in its file names it."""
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        if not node.deterministic():
            return False
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation"


def _named(columns: list[str], of: str = "") -> list[Column]:
    return [F.col(of + "`" + c.replace("`", "``") + "`").alias(c) for c in columns]


def located(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, text, __row (struct of all columns of docs) and __at (struct of file and index: where the row lies).

    What is no scan of files is written first: to folder, or to a table that goes when the driver ends."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index")).alias("__at")
    if "_metadata" not in docs.columns and _is_scan(docs):
        return docs.select("doc_id", "text", F.struct(*_named(docs.columns)).alias("__row"), at)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*_named(others)) if others else F.struct(F.lit(None).cast("int").alias("none"))
    stored = docs.select("doc_id", "text", rest.alias("__rest"))
    if folder:
        stored.write.parquet(folder)
        stored = docs.sparkSession.read.schema(stored.schema).parquet(folder)
    else:
        stored = written(stored)
    row = [F.col(c) if c in ("doc_id", "text") else _named([c], "__rest.")[0] for c in docs.columns]
    return stored.select("doc_id", "text", F.struct(*row).alias("__row"), at)


# Vectorised hashing of words for statistics and vocabularies: a polynomial over randomised byte values, modulo 2**64, taken
# from prefix sums. Words can be made that collide, so nothing whose identity matters goes by it.

_ODD, _ODD_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x + np.uint64(salt)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span, the same wherever the span lies."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_ODD, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_ODD_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes, worked out block by block so that memory follows the longest word, not the data."""
    out = np.empty(len(start), np.uint64)
    block = start >> 20
    order = np.argsort(block, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
        low, high = start[part].min(), end[part].max()
        out[part] = span_hashes(_BYTE[data[low:high]], start[part] - low, end[part] - low)
    return out


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[*SPACES.encode()]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(IS_SPACE[data], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts in order, and at which of them each text begins (one more entry than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, end = word_spans(data)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return word_keys(data, start, end), np.searchsorted(start, begins)


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of size word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return mix(span_hashes(mix(words, salt), at, at + size), salt)


def chunks(batches: Iterator, most_bytes: int = 1 << 20, column: str = "text") -> Iterator:
    """The Arrow batches cut into runs of rows whose column holds about most_bytes; a single value is never cut."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def slices(batches: Iterator, rows: int) -> Iterator:
    """The Arrow batches cut into runs of so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
