"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with n documents of N in all and target share w is to be repeated w N' / n times in the mean, N' being the
size asked for. Every document gets a number of copies from the Poisson distribution of that mean: the uniform
number that an md5 of its id and text seeds is inverted, so the same seed gives the same mixture however the rows are dealt. The rows
are exploded by their counts and put in a global order by the md5 of document and copy, range-partitioned, so no
source or document makes a partition large. A document of more than RUN draws is exploded into runs of draws first,
which are shuffled before they are drawn, so one that is to come a million times is no task of its own either.

Means over PIECE are split into equal parts, each inverted by itself. A null source is a source of its own; sources
without a weight are left out, weights of sources without documents are spread over the others in proportion. An
empty text is a document like any other. Rows of equal id and text draw alike, as they have one seed. Columns of `docs` come
through unchanged, but for those named copy, copies and shuffle_key, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, input_bytes, small_enough

PIECE = 16.0
#: Stored input for each partition of the mixture, where the session's number of partitions would make them larger.
PARTITION_BYTES = 128 << 20
MOST_PARTITIONS = 1 << 20
#: Draws that one row makes; a document of more, of a source of few documents and a large weight, is dealt out.
RUN = 256
SEED = 42
#: Least chance that is told apart: 52 bits of an md5.
_STEPS = 2.0**52


def uniform(*parts: Column) -> Column:
    """A number inside (0, 1) from the first 52 bits of the md5 of the parts, joined by a colon."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_STEPS)


def chances(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1 ... of a Poisson variable of mean up to PIECE, as far as a number of 52 bits can lie above it."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("total"), F.array(first).alias("all"))

    def step(held: Column, k: Column) -> Column:
        p = held["p"] * mean / k
        return F.struct(p.alias("p"), (held["total"] + p).alias("total"), F.concat(held["all"], F.array(held["total"] + p)).alias("all"))

    table = F.aggregate(F.sequence(F.lit(1), F.lit(99)), start, step, lambda held: held["all"])
    return F.filter(table, lambda c: c < F.lit(1 - 0.5 / _STEPS))


def poisson(table: Column, u: Column) -> Column:
    """Least k with u <= P(X <= k): how many of the table's chances lie under u. (u goes into the fold, to be worked out once.)"""
    start = F.struct(u.alias("u"), F.lit(0).alias("k"))
    return F.aggregate(table, start, lambda held, c: F.struct(held["u"].alias("u"), (held["k"] + (c < held["u"]).cast("int")).alias("k")), lambda held: held["k"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None, source: str, size: float | None) -> DataFrame:
    """source, parts, chances: how many draws each of a source's documents takes, and the table of one draw."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        counts = counts.join(table, F.col("source").eqNullSafe(F.col("name"))).where("w > 0").drop("name")
    sums = counts.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    asked = float(size if size is not None else sums.n or 0)
    means = counts.select("source", (F.col("w") / F.lit(sums.w or 1.0) * F.lit(asked) / F.col("n")).alias("mean"))
    means = means.withColumn("parts", F.greatest(F.ceil(F.col("mean") / PIECE).cast("int"), F.lit(1)))
    return means.select("source", "parts", chances(F.col("mean") / F.col("parts")).alias("chances"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, size: float | None = None, seed: int = SEED, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixture: columns of `docs`, copy (from 1), copies, shuffle_key, in the order of shuffle_key.

    Without weights all sources weigh the same; without size the mixture is, in the mean, as large as the weighted sources.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    table = scratch.keep(rates(docs, weights, source, size).select(F.col("source").alias("__source"), F.col("parts").alias("__parts"), F.col("chances").alias("__chances")), "rates")
    rows = docs.drop("copy", "copies", "shuffle_key")
    names = rows.columns
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    ident = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")), digest)
    rows = rows.withColumn("__ident", ident).join(small_enough(table, scratch.bytes("rates")), F.col(source).eqNullSafe(F.col("__source")))
    usual = rows.where(F.col("__parts") <= RUN).select(*names, "__ident", _drawn(F.lit(1), F.col("__parts")).alias("copies"), F.lit(0).alias("__before"))
    usual = usual.withColumn("__own", F.col("copies"))
    often = table.where(F.col("__parts") > RUN)
    if not often.isEmpty():
        usual = usual.unionByName(_dealt(rows.where(F.col("__parts") > RUN), names, parts_of(spark, docs), scratch))
    # explode_outer: of explode Spark would infer a filter, which would draw a second time
    copied = usual.select("*", F.posexplode_outer(F.array_repeat(F.lit(True), F.col("__own"))).alias("__at", "__one")).where("__at IS NOT NULL")
    copied = copied.withColumn("copy", (F.col("__at") + F.col("__before") + 1).cast("int"))
    order = F.md5(F.concat_ws(":", F.col("__ident"), F.col("copy").cast("string"), F.lit("order")).cast("binary"))
    copied = copied.select(*names, F.col("copies").cast("int").alias("copies"), "copy", order.alias("shuffle_key"))
    # an md5 is uniform, so the bounds of an even range partitioning are known without a look at the rows
    parts = parts_of(spark, docs)
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") / 2.0**32 * parts).cast("int")
    return copied.repartitionById(parts, part).sortWithinPartitions("shuffle_key", key, "copy")


def _drawn(first: Column, last: Column) -> Column:
    """The sum of a document's draws `first` to `last`."""
    return F.aggregate(F.sequence(first, last), F.lit(0), lambda held, j: held + poisson(F.col("__chances"), uniform(F.col("__ident"), j.cast("string"))))


def _dealt(rows: DataFrame, names: list[str], parts: int, scratch: Scratch) -> DataFrame:
    """Documents of so many draws that they are dealt out in runs of RUN: names, __ident, copies, and for each run how many copies it has and how many come before."""
    runs = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("__parts") - 1) / RUN).cast("int"))).alias("__run"))
    runs = runs.repartition(parts, "__ident", "__run")
    first, last = F.col("__run") * RUN + 1, F.least((F.col("__run") + 1) * RUN, F.col("__parts"))
    drawn = runs.select(*names, "__ident", "__run", _drawn(first, last).alias("__own"))
    sums = drawn.select("__ident", "__run", "__own").distinct()
    own = Window.partitionBy("__ident")
    sums = sums.select("__ident", "__run", F.sum("__own").over(own).alias("copies"), (F.sum("__own").over(own.orderBy("__run")) - F.col("__own")).alias("__before"))
    sums = scratch.keep(sums, "runs")
    return drawn.join(small_enough(sums, scratch.bytes("runs")), ["__ident", "__run"]).select(*names, "__ident", "copies", "__before", "__own")


def parts_of(spark: SparkSession, docs: DataFrame) -> int:
    """The session's number of partitions, or more where they would be large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, input_bytes(docs) // PARTITION_BYTES))


#: The mixture of op9 and the pipeline: equal weights.
ORACLE = """
WITH d AS (SELECT doc_id, text, lang, source, n_chars, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) AS ident FROM documents),
c AS (SELECT source, count(*) AS n FROM d GROUP BY source),
r AS (SELECT source, 1.0 / (SELECT count(*) FROM c) * (SELECT sum(n) FROM c)::DOUBLE / n::DOUBLE AS mean FROM c),
p AS (SELECT source, mean, greatest(1, CAST(ceil(mean / 16.0) AS INTEGER)) AS parts FROM r),
cdf AS (SELECT source, k, sum(chance) OVER (PARTITION BY source ORDER BY k) AS total FROM
  (SELECT source, k, exp(-(mean / parts) + k * ln(mean / parts) - lgamma(k + 1)) AS chance FROM p, (SELECT unnest(range(0, 99)) AS k) ks) x),
u AS (SELECT d.doc_id, d.source, d.text, d.ident, j, (('0x' || substr(md5('42:' || ident || ':' || CAST(j AS VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, parts + 1)) t(j)),
n AS (SELECT doc_id, source, text, ident, sum(k)::INTEGER AS copies FROM
  (SELECT u.doc_id, u.source, u.text, u.ident, j, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND cdf.total < u.u) AS k FROM u) x GROUP BY doc_id, source, text, ident)
SELECT doc_id, source, text, copies, CAST(copy AS INTEGER) AS copy, md5('42:' || ident || ':' || CAST(copy AS VARCHAR) || ':order') AS shuffle_key
FROM n, unnest(range(1, copies + 1)) t(copy)
"""
