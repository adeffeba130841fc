"""Operator 9: mixing sources to target weights by Poisson replication.

Each source has a target share of the mixed corpus; its repetition rate is the
number of its documents wanted over the number it has. A document's number of
copies is a Poisson draw with that mean: a hash of the seed and the id gives a
uniform number, which is looked up in the distribution function. Copies are
made by ``explode`` and spread by a hash of id and copy, in whose order each
partition is sorted, so reading the partitions one after the other reads a
shuffled corpus. Everything is DataFrame functions.

A mean above ``BLOCK`` is split into equal parts, each drawn on its own, for
the distribution function of a large mean can't be summed in doubles.

Target shares default to the counts to the power ``TEMPER``, counted over all
documents; the count combines before its shuffle, and the table of rates has
one row per source. The planner broadcasts it only if it is small; otherwise
its join splits a large source between tasks.

Defined results: null is a source of its own; a source without a given weight
gets none of the corpus, and so no copy, nor does any where the weights sum to zero or
match no source; weights are scaled to sum to one;
rows with a null id draw by their text; repeated rows get equal numbers of
copies; an empty table stays empty; other columns pass through, a column named
like the added ``copy_no`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, spare, stage

SEED = "mix-1"
TEMPER = 0.5
BLOCK = 16
TAIL = 90  # terms of the distribution function of a mean up to BLOCK


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 digest as a number from 0 up to 1."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict | None = None, source_col: str = "source",
          temper: float = TEMPER) -> DataFrame:
    """(source, rate): copies wanted of each document."""
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temper)))
    else:
        given = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "mix_source string, weight double")
        sizes = sizes.withColumnRenamed("mix_source", "s").join(
            given, F.col("s").eqNullSafe(F.col("mix_source")), "left") \
            .select(F.col("s").alias("mix_source"), "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes = stage(sizes, "mix-sizes")
    total = sizes.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights"))
    # no weight that matches a source: no copies
    rate = F.try_divide(F.col("weight"), F.col("weights")) * F.col("rows") / F.col("n")
    # one row of totals beside one row per source
    return sizes.join(F.broadcast(total)) \
                .select("mix_source", F.round(F.coalesce(rate, F.lit(0.0)), 6).alias("rate"))


def with_distribution(rate: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``parts`` and ``below``: the distribution function of the mean
    ``rate / parts`` at 0, 1, 2, ..."""
    parts = F.greatest(F.ceil(F.col("rate") / block), F.lit(1))
    mean = F.col("rate") / F.col("parts")
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TAIL)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("below")),
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"),
            F.concat(s["below"], F.array(F.element_at(s["below"], -1) + s["p"] * mean / k)).alias("below")),
        lambda s: s["below"])
    return rate.withColumn("parts", parts.cast("int")).withColumn("below", steps)


def replicate(docs: DataFrame, weights: dict | None = None, seed: str = SEED, id_col: str = "doc_id",
              source_col: str = "source", text_col: str = "text", temper: float = TEMPER) -> DataFrame:
    """``docs`` with each row as often as drawn, numbered by ``copy_no`` from
    1, in shuffled order."""
    docs = docs.drop("copy_no") if "copy_no" in docs.columns else docs
    columns = docs.columns
    source, parts, below, number, place = spare(columns, "mix_source", "mix_parts", "mix_below", "mix_copies", "mix_place")
    wanted = stage(with_distribution(rates(docs, weights, source_col, temper)), "mix-rates")
    wanted = wanted.select(F.col("mix_source").alias(source), F.col("parts").alias(parts), F.col("below").alias(below))
    drawn = docs.join(wanted, F.col(source_col).eqNullSafe(F.col(source)))
    me = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text_col, F.lit("")))))
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col(parts)), F.lit(0),
        lambda n, part: n + F.size(F.filter(below, lambda c: c <= uniform(F.lit(seed), me, part))))
    many = drawn.withColumn(number, copies).filter(F.col(number) > 0) \
                .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(number))))
    order = F.xxhash64(F.lit(seed), me, F.col("copy_no"))
    return many.withColumn(place, order).repartition(place).sortWithinPartitions(place) \
               .select(*columns, "copy_no")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(documents(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed corpus with the columns of documents."""
    return replicate(docs).select(*docs.columns)


SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPER}) AS weight FROM documents GROUP BY source),
rate AS (
  SELECT source, round(weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(n) FROM sizes) / n, 6) AS rate
  FROM sizes),
part AS (
  SELECT source, greatest(ceil(rate / {BLOCK}), 1)::INTEGER AS parts, rate / greatest(ceil(rate / {BLOCK}), 1) AS mean
  FROM rate),
steps AS (
  SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS below FROM part
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), below + p * mean / (k + 1) FROM steps WHERE k < {TAIL}),
draws AS (
  SELECT d.doc_id, p.source, u.i AS part,
         ('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || u.i), 1, 13))::BIGINT / pow(2, 52) AS u
  FROM documents d JOIN part p ON d.source IS NOT DISTINCT FROM p.source,
       LATERAL unnest(range(1, p.parts + 1)) AS u(i)),
copies AS (
  SELECT doc_id, sum((SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM draws.source AND s.below <= draws.u))::INTEGER AS n
  FROM draws GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.i::INTEGER AS copy_no
FROM documents d JOIN copies USING (doc_id), LATERAL unnest(range(1, copies.n + 1)) AS c(i)
"""
