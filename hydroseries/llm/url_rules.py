"""URL filtering: longest-match block and allow rules, and association rules that FP-growth mines from labelled URLs for the rest.

A URL's items are its host labels, path parts and query names. Labelled URLs become transactions of their items and label; Spark's
FP-growth mines frequent combinations; rules with a label as consequent stay if confidence and support are high enough. Matching is by
an inverted index: rules and URLs meet on single items, and a rule matches where all its items were met. Items that occur in just the
same labelled URLs are one item in mining, whose members stand for each other: n of them would give 2^n frequent sets that tell nothing more.

Defined cases: of matching rules the surest decides, then the best supported, then the longest, then the label last by name; a null URL or one without :// has empty host and path, matches no rule and gets the default verdict; repeated
rows are judged alike; without any labelled URL no rule is mined; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, free_name


@dataclass(frozen=True)
class UrlRule:
    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[UrlRule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null. The rules are parameters, so they are part of the expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_items(url: Column) -> Column:
    """The distinct items of a URL; numbers in a path are one item, whatever their value."""
    host, path = host_of(url), path_of(url)
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(ascii_lower(path), r"[^a-z0-9]+"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"\d+", "0")))
    names = F.transform(F.split(F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("")), "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.filter(F.concat(labels, words, names), lambda x: F.char_length(x) > 2))


def merged_items(labelled: DataFrame, min_support: float) -> DataFrame:
    """item, member_of: each frequent item and the first, by name, of the items that occur in just the same rows.

    Rows are told by a 64-bit hash; two items are alike if the numbers, sums and parities of their rows' hashes are. At most the mean
    number of items in a row over min_support are frequent, however many rows there are.
    """
    # Numbered before it is exploded, so that a row has one number.
    rows = labelled.select(F.xxhash64(F.monotonically_increasing_id()).alias("row"), "items").select("row", F.explode("items").alias("item"))
    told = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("row").alias("parity"), F.sum(F.col("row").cast("decimal(20,0)")).alias("sum"))
    alike = W.partitionBy("n", "parity", "sum")
    least = F.ceil(F.lit(min_support) * labelled.count()).cast("long")
    return told.where(F.col("n") >= least).select("item", F.min("item").over(alike).alias("member_of"))


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8, merged: DataFrame | None = None) -> DataFrame:
    """items, label, confidence, support of the rules kept, from rows with items and label. merged: items are given by their first member.

    A rule stays if no rule on a part of its items has the same label and at least its confidence. Support is a share of all rows, so
    the number of frequent items does not grow with the input.
    """
    if merged is not None:
        labelled = with_merged(labelled, merged)
    rows = labelled.select(F.array_append("items", F.concat(F.lit("label="), "label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("label="))).select(
        F.array_sort(F.filter("antecedent", lambda x: ~F.startswith(x, F.lit("label=")))).alias("items"), F.substring(F.col("consequent")[0], 7, 1000).alias("label"), "confidence", "support", F.size("antecedent").alias("n")
    ).where(F.size("items") == F.col("n")).drop("n")
    # Pruning by the index too: a general rule meets a special one on each of the general one's items.
    keyed = rules.withColumn("id", F.xxhash64("items", "label")).withColumn("n", F.size("items"))
    general = keyed.select(F.col("id").alias("g"), F.col("label").alias("glabel"), F.col("confidence").alias("gconf"), F.col("n").alias("gn"), F.explode("items").alias("item"))
    special = keyed.select("id", "label", "confidence", "n", F.explode("items").alias("item"))
    covered = special.join(general, "item").where((F.col("label") == F.col("glabel")) & (F.col("gn") < F.col("n")) & (F.col("gconf") >= F.col("confidence"))).groupBy("id", "g", "gn").count().where(F.col("count") == F.col("gn")).select("id").distinct()
    return keyed.join(covered, "id", "left_anti").drop("id", "n")


def with_merged(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows with items as merged items; those that are not frequent in mining fall away. The map of merged items, of bounded size, is one row."""
    one = merged.agg(F.map_from_entries(F.collect_list(F.struct("item", "member_of"))).alias("_merged"))
    held = F.array_distinct(F.array_compact(F.transform("items", lambda x: F.try_element_at(F.col("_merged"), x))))
    return rows.crossJoin(F.broadcast(one)).withColumn("items", held).drop("_merged")


def match_rules(urls: DataFrame, rules: DataFrame, key: str, merged: DataFrame | None = None) -> DataFrame:
    """key, label, confidence of the best matching rule: highest confidence, then support, then most items, then label.

    URLs with equal items are judged once: their items meet the inverted index, and each URL gets the verdict by its item set.
    """
    rules = rules.withColumn("rule_id", F.xxhash64("items", "label")).withColumn("n", F.size("items"))
    index = rules.select("rule_id", F.explode("items").alias("item"))
    if merged is not None:
        urls = with_merged(urls, merged)
    named = urls.select(key, F.array_sort("items").alias("items")).withColumn("set", F.sha2(F.array_join("items", "\n"), 256))
    sets = named.groupBy("set").agg(F.any_value("items").alias("items"))
    met = sets.select("set", F.explode("items").alias("item")).join(index, "item").groupBy("set", "rule_id").count()
    best = met.join(rules.drop("items"), "rule_id").where(F.col("count") == F.col("n")).groupBy("set").agg(F.max(F.struct("confidence", "support", "n", "label")).alias("best"))
    return named.join(best, "set").select(key, F.col("best.label").alias("label"), F.col("best.confidence").alias("confidence"))


def judge_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow", min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """page_id, url, host, path, rule, verdict, confidence (null where the rule or the default decided) of each row of pages.

    The labels to learn from are the rules' own verdicts. Which item sets there are is counted before anything else is joined.
    """
    spark: SparkSession = pages.sparkSession
    own = free_name(pages, "_set")
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_items(F.col("url")).alias("items"))
    base = base.withColumn("hit", longest_rule(rules, F.col("host"), F.col("path"))).withColumn(own, F.sha2(F.array_join(F.array_sort("items"), "\n"), 256))
    labelled = base.where(F.col("hit").isNotNull()).select("items", F.col("hit.verdict").alias("label"))
    merged = None
    if labelled.isEmpty():
        mined = spark.createDataFrame([], "items array<string>, label string, confidence double, support double")
    else:
        merged = merged_items(labelled, min_support)
        mined = mine_rules(labelled, min_support, min_confidence, merged)
    sets = base.where(F.col("hit").isNull()).groupBy(own).agg(F.any_value("items").alias("items"))
    found = match_rules(sets, mined, own, merged)
    return base.join(found, own, "left").select(
        "page_id", "url", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", "label", F.lit(default)).alias("verdict"),
        F.when(F.col("hit").isNull(), F.col("confidence")).alias("confidence"),
    )
