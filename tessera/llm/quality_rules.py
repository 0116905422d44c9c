"""Quality rules: base counts of a text, and robust multivariate outliers by minimum covariance determinant.

Each text gives a vector of transformed statistics. For every language and source, the covariance of least determinant over a share
SUBSET of its texts is approached by concentration steps from two starts, at medians and quartiles and at medians and
median deviations: distances to the current estimate, the SUBSET of least distance, its mean and covariance, and again, until the
determinant no longer falls. The end of least determinant is taken. Texts whose Mahalanobis distance to it passes CUTOFF are rejected. Sources with few texts in a language are pooled. All sums run over whole numbers, so they are
exact in any order; quantiles of distances are taken over narrow bins. DataFrame and SQL operations only.

Defined results: a null text has no words, and fails the base rules; null languages and sources form groups of their
own; a group whose texts are all alike rejects what lies further off than the FLOORs allow; repeated rows are judged
alike; an empty table gives no rows; other columns are kept by kept_documents() and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, written

SYMBOLS = "#*$%&|<>"
#: Differences below these are no difference: of the logarithm of the word count, of the mean word length, and of the shares
#: of symbols, repeated lines and repeated words. Each is the least standard deviation that an estimate may have.
FLOORS = {"log_words": 0.5, "word_length": 0.25, "symbols": 0.01, "dup_lines": 0.1, "repeats": 0.1}
#: Whole steps that a floor is divided into, and the most that a statistic may be in such steps.
STEPS, MOST = 16, 4096
P = len(FLOORS)
#: Share of a group whose covariance is least, and what its variances are multiplied by to be consistent for a normal
#: distribution: SUBSET over the distribution function of chi-square with P + 2 degrees at the SUBSET quantile of P degrees.
#: At half, nearly as many outliers as good texts are borne. The usual P / 2 rows more keep a covariance from being singular; here the FLOORs do.
SUBSET, CONSISTENCY = 0.5, 1.912
#: Squared distance; a normal vector passes it about once in a million (chi-square, P degrees).
CUTOFF = 36.0
#: A step that lowers the determinant's root by no more than this share is the last; so many steps always suffice in practice.
LEAST_FALL, MOST_ROUNDS = 1e-6, 100
#: Texts below which the sources of a language are pooled.
LEAST_GROUP = 100
#: Up to so many groups (a row of some 200 bytes each) estimates are broadcast, else joined by shuffle.
BROADCAST_GROUPS = 50_000


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and __lines."""
    out = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    out = out.withColumn("__words", F.array_remove(F.split("__text", "[\\x20\\x09-\\x0D]+"), ""))
    windows = F.transform(F.sequence(F.lit(0), F.size("__words") - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))
    out = out.withColumns(
        {
            "__lines": F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
            "__n": F.size("__words"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.size(F.split("__text", f"[{SYMBOLS}]")) - 1).cast("long"),
            "__windows": F.when(F.size("__words") >= 3, windows),
        }
    )
    # Windows in order of their hashes and words; only where some hash is found twice. The words decide what repeats.
    window = lambda x, i: F.struct(x.alias("x"), F.slice("__words", i + 1, F.lit(3)).alias("w"), i.alias("i"))
    out = out.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(F.transform("__windows", window))))
    same = lambda e, f: F.coalesce((f["x"] == e["x"]) & (f["w"] == e["w"]), F.lit(False))
    twice = F.filter("__sorted", lambda e, k: same(e, F.get("__sorted", k - 1)) | same(e, F.get("__sorted", k + 1)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    out = out.withColumns(
        {
            "n_words": F.col("__n").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_repeat_words": F.when(F.col("__sorted").isNull(), F.lit(0)).otherwise(covered).cast("long"),
        }
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _statistics() -> list[Column]:
    """The vector in whole steps: x0 ... x4."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    values = (F.log1p("n_words"), share("word_chars", "n_words"), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return [F.least(F.round(v * (STEPS / floor)), F.lit(MOST)).cast("long").alias(f"x{k}") for k, (v, floor) in enumerate(zip(values, FLOORS.values()))]


def _group() -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"__{c}") for c in ("lang", "source")]


def _join(rows: DataFrame, side: DataFrame, on: list[str], n: int, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(side) if n <= BROADCAST_GROUPS else side, on, how)


#: Places of a lower triangle.
TRIANGLE = [(i, j) for i in range(P) for j in range(i + 1)]


#: Columns of an estimate.
ESTIMATE = [*[f"m{i}" for i in range(P)], *[f"w{i}{j}" for i, j in TRIANGLE]]


def _total(terms: list[str]) -> str:
    return " + ".join(terms) or "0.0D"


def _distance() -> Column:
    """Squared distance of x0 ... to m0 ... under the inverse factor w_ij."""
    return F.expr(_total([f"pow({_total([f'w{i}{j} * (x{j} - m{j})' for j in range(i + 1)])}, 2.0D)" for i in range(P)]))


def _factor(sums: DataFrame) -> DataFrame:
    """Mean m_i, the inverse w_ij of the Cholesky factor of the covariance, and its determinant's root, from the sums of a group and start."""
    means = [f"s{i} / n AS m{i}" for i in range(P)]
    spread = [f"(q{i}{j} / n - s{i} / n * (s{j} / n)) * {CONSISTENCY}D + {STEPS**2 if i == j else 0} AS v{i}{j}" for i, j in TRIANGLE]
    out = sums.selectExpr("g", "start", *means, *spread)
    for j in range(P):  # the factor column by column
        rest = {i: f"v{i}{j} - ({_total([f'l{i}{k} * l{j}{k}' for k in range(j)])})" for i in range(j, P)}
        out = out.selectExpr("*", f"sqrt(greatest({rest[j]}, 1e-6D)) AS l{j}{j}").selectExpr("*", *[f"({rest[i]}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, P)])
    for off in range(P):  # its inverse diagonal by diagonal
        out = out.selectExpr("*", *[f"{f'-({_total([f"l{j + off}{k} * w{k}{j}" for k in range(j, j + off)])})' if off else '1'} / l{j + off}{j + off} AS w{j + off}{j}" for j in range(P - off)])
    return out.selectExpr("g", "start", *ESTIMATE, " * ".join(f"l{j}{j}" for j in range(P)) + " AS root")


def _bin(distance: Column) -> Column:
    return F.least(F.floor(F.log2(distance + 1) * 64), F.lit(64 * 60)).cast("int")


def estimates(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(lang, source) -> g, and g -> its estimate, for vectors (__lang, __source, x0 ...); and the number of groups."""
    per_source = vectors.groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("n"))
    g = F.when(F.col("n") >= LEAST_GROUP, F.struct(F.col("__lang").alias("lang"), F.col("__source").alias("source"))).otherwise(F.struct(F.col("__lang").alias("lang"), F.lit(None).cast("string").alias("source")))
    groups = written(per_source.select("__lang", "__source", F.to_json(g).alias("g")))
    n = groups.count()
    rows = written(_join(vectors, groups, ["__lang", "__source"], n).select("g", *[f"x{i}" for i in range(P)]))
    quartiles = written(rows.groupBy("g").agg(*[F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i in range(P)]))
    # Above a quarter of outliers the quartiles of a statistic may lie among them; the median deviation holds up to half.
    deviations = _join(rows, quartiles, ["g"], n).groupBy("g").agg(*[F.percentile(F.expr(f"abs(x{i} - p{i}[1])"), 0.5).alias(f"d{i}") for i in range(P)])
    spreads = [[f"(p{i}[2] - p{i}[0]) / 1.349D" for i in range(P)], [f"d{i} * 1.4826D" for i in range(P)]]
    both = written(_join(quartiles, deviations, ["g"], n))
    starts = [both.selectExpr("g", f"{k} AS start", *[f"p{i}[1] AS m{i}" for i in range(P)], *[f"1 / greatest({spread[i]}, {STEPS}D) AS w{i}{i}" if i == j else f"0.0D AS w{i}{j}" for i, j in TRIANGLE]) for k, spread in enumerate(spreads)]
    now = written(starts[0].unionByName(starts[1]).selectExpr("*", "CAST('Infinity' AS DOUBLE) AS root", "TRUE AS falls"))
    for _ in range(MOST_ROUNDS):
        open_now = now.where("falls").drop("root", "falls")
        if not open_now.take(1):
            break
        near = _join(rows, open_now, ["g"], 2 * n).select("g", "start", *[f"x{i}" for i in range(P)], _bin(_distance()).alias("bin"))
        reach = written(near.groupBy("g", "start").agg(F.percentile("bin", SUBSET).alias("reach")))
        subset = _join(near, reach, ["g", "start"], 2 * n).where("bin <= reach")
        sums = ["count(1) AS n", *[f"sum(x{i}) AS s{i}" for i in range(P)], *[f"sum(x{i} * x{j}) AS q{i}{j}" for i, j in TRIANGLE]]
        step = _factor(written(subset.groupBy("g", "start").agg(*map(F.expr, sums))))
        # Each start keeps its least determinant, and goes on while a step lowers it.
        old = now.select("g", "start", F.struct("root", *ESTIMATE).alias("old"))
        both_now = old.join(step.select("g", "start", F.struct("root", *ESTIMATE).alias("new")), ["g", "start"], "left")
        better = F.coalesce(F.col("new.root") < F.col("old.root"), F.lit(False))
        falls = F.coalesce(F.col("new.root") < F.col("old.root") * (1 - LEAST_FALL), F.lit(False))
        now = written(both_now.select("g", "start", F.when(better, F.col("new")).otherwise(F.col("old")).alias("e"), falls.alias("falls")).select("g", "start", "e.*", "falls"))
    least = now.groupBy("g").agg(F.min_by(F.struct(*ESTIMATE), F.struct("root", "start")).alias("e"))
    return groups, written(least.select("g", "e.*")), n


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(counted: DataFrame, estimate: tuple[DataFrame, DataFrame, int], columns: list) -> DataFrame:
    """columns of counted (it has __lang, __source, base_failed and x0 ...), with distance2 and kept."""
    groups, now, n = estimate
    named = _join(counted, groups, ["__lang", "__source"], n, "left")
    out = _join(named, now, ["g"], n, "left")
    distance = _distance()
    return out.select(*columns, distance.alias("distance2"), F.when(F.col("base_failed"), False).otherwise(F.coalesce(distance, F.lit(0.0)) <= CUTOFF).alias("kept"))


def judged(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the counts, base_failed, distance2 and kept."""
    columns = ["doc_id", *COUNTS, "base_failed"]
    counted = written(with_counts(docs.select("doc_id", "text", "lang", "source")).select(*columns, *_group(), *_statistics()))
    return _judged(counted, estimates(counted.where("NOT base_failed").drop(*columns)), columns)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. The texts are counted twice and never shuffled."""
    whole = docs.select(F.struct(*docs.columns).alias("__row"), "text", "lang", "source")
    counted = with_counts(whole).select("__row", "base_failed", *_group(), *_statistics())
    # Written before it is filtered: a filter that moved down would count every text again for each mention of a count.
    estimate = estimates(written(counted.drop("__row")).where("NOT base_failed").drop("base_failed"))
    return _judged(counted, estimate, ["__row"]).where("kept").select("__row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select("doc_id", *COUNTS, "base_failed", "kept", "distance2")
