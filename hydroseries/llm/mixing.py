"""Mixing sources to target weights by Poisson replication.

Each document is repeated k times, k from a Poisson distribution whose mean is the repetition rate of its source: target share times
total, over the source's count. k inverts the distribution at a uniform number that a hash of seed and doc_id gives, so a rerun, a
retry or another partitioning gives the same rows. All of it is Spark SQL.

Defined cases: a null source is a source of its own; sources without a weight get the rate 0 if any weight is named, and all sources
weigh the same by default; null doc_ids share the draw of the text "null", rows with one doc_id share a draw; an empty table
gives an empty one; further columns are carried along, and own columns take a name that is free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: A mean above this is split into equal parts that are drawn apart; the sum of Poisson numbers is one again.
PART = 16.0
#: Terms of a part's distribution: beyond them less than 1e-16 of the mass is left at a mean of PART.
TERMS = 64
#: Copies that one row of a heavily repeated document gives out.
CHUNK = 64
#: Rates that may be broadcast: TERMS numbers and a name each, a few MB.
FEW = 4096


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source: str = "source") -> DataFrame:
    """source, rate: the mean number of copies. One row a source; the counts are pre-aggregated on each side of the shuffle."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        counts = counts.withColumn("weight", F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0))
    whole = counts.agg(F.sum("weight").alias("weights"), F.sum("n").alias("docs"))
    size = F.col("docs") if total is None else F.lit(float(total))
    return counts.crossJoin(F.broadcast(whole)).select("source", F.coalesce(F.try_divide(F.col("weight") * size.cast("double"), F.col("weights") * F.col("n")), F.lit(0.0)).alias("rate"))


def _uniform(*parts):
    """52 bits of an MD5, as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 17, source: str = "source") -> tuple[DataFrame, str, str]:
    """The replicated documents in a random order, and the names of the columns copy number and rate.

    The one large shuffle is the global one that is asked for. Rates are one row a source, and they are broadcast only after a count has
    shown that there are FEW at most; else the join is a shuffle, in which Spark splits a hot source. Documents of sources with a rate
    above PART are first dealt out in rows of CHUNK copies, so that a document of a tiny source is not repeated by one task.
    """
    copy, rate, key = (free_name(docs, x) for x in ("copy_no", "mix_rate", "_mix_key"))
    rates = repetition_rates(docs, weights, total, source)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    mean = F.col("rate") / parts
    # P(0), P(0)+P(1), ...: each term is the last one times mean / k.
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf")),
        lambda acc: acc["cdf"],
    )
    rates = rates.select(F.col("source").alias("_mix_source"), F.col("rate").alias(rate), parts.alias("_mix_parts"), cdf.alias("_mix_cdf"))
    heavy = rates.where(F.col("_mix_parts") > 1)
    if rates.limit(FEW + 1).count() <= FEW:
        rates = F.broadcast(rates)
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = docs.join(rates, docs[source].eqNullSafe(F.col("_mix_source"))).withColumn(
        "_mix_count",
        F.aggregate(
            F.transform(F.sequence(F.lit(1), F.col("_mix_parts")), lambda i: _uniform(F.lit(str(seed)), ident, i.cast("string"))),
            F.lit(0),
            lambda n, u: n + F.size(F.filter("_mix_cdf", lambda c: u >= c)),
        ),
    )
    drawn = drawn.where(F.col("_mix_count") > 0)
    copies = drawn.where(F.col("_mix_parts") == 1).select("*", F.explode(F.sequence(F.lit(1), F.col("_mix_count"))).alias(copy))
    if not heavy.isEmpty():
        chunks = drawn.where(F.col("_mix_parts") > 1).withColumn("_mix_chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_mix_count") / CHUNK).cast("int") - 1)))
        dealt = chunks.repartition(F.md5(F.concat_ws("|", ident, F.col("_mix_chunk").cast("string")).cast("binary")))
        last = F.least(F.col("_mix_count"), (F.col("_mix_chunk") + 1) * CHUNK)
        copies = copies.unionByName(dealt.select("*", F.explode(F.sequence(F.col("_mix_chunk") * CHUNK + 1, last)).alias(copy)).drop("_mix_chunk"))
    copies = copies.select(*[F.col(f"`{c}`") for c in docs.columns], rate, copy)
    shuffled = copies.withColumn(key, F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), ident, F.col(copy).cast("string")).cast("binary")))
    return shuffled.repartition(F.col(key)).sortWithinPartitions(key).drop(key), copy, rate
