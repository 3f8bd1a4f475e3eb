"""URL filtering: rules by hand, and association rules mined from labelled URLs.

A URL becomes a set of tokens: labels of its host, segments of its path (digits as ``#``), names of its
query. Spark's FP-growth finds the frequent token sets of labelled URLs, the label being one more item.
Rules "tokens => label" stay if they have enough support and confidence and no shorter rule for the
same label does as well. A rule is filed in an index under its rarest token, so a URL meets the rules of
its own tokens only and is compared with the rest of each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions.joins import small_side
from gridmill.functions.semantics import col, require
from gridmill.llm.common import fresh, without, written

MIN_CONFIDENCE = 0.8
MIN_ROWS = 20  # a rule is seen in so many labelled URLs at least, however many there are
ALLOW, BLOCK = "allow", "block"
RULE_SCHEMA = "tokens array<string>, label string, confidence double, support double, file string"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def by_hand(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of ``(verdict, host + path)`` and its verdict; null where none fits.

    A rule's path starts at its first slash. It fits its host and all hosts below, on paths that start with its own.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest outermost
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """The sorted token set of a URL; empty for null and for texts without ``://``."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    named = lambda kind, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind + ":"), p))
    hosts = named("host", F.split(host_of(url), r"\."))
    paths = named("path", F.split(F.regexp_replace(path_of(url), "[0-9]+", "#"), "/"))
    queries = named("query", F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^([^=]*)", 1)))
    return F.array_sort(F.array_distinct(F.concat(hosts, paths, queries)))


def mine(labelled: DataFrame, url: str = "url", label: str = "label", min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Association rules from tokens to a label: ``tokens``, ``label``, ``confidence``, ``support``, ``file`` (its rarest token).

    Rows with a null label or without tokens are passed over; with fewer than ``min_rows`` left there are no rules. Support is asked for as a number
    of rows, so that a rare host counts as much in a large set. A rule is dropped if one with fewer of its tokens, for the same label, is at least as confident.
    """
    require(labelled, url, label)
    spark = labelled.sparkSession
    marked = F.concat(F.lit("label="), col(label))
    items = labelled.select(tokens_of(col(url)).alias("_t"), marked.alias("_l")).filter("_l IS NOT NULL AND size(_t) > 0")
    items = written(items.select(F.concat("_t", F.array("_l")).alias("items")), "url-items")
    rows = items.count()
    if rows < min_rows:
        return spark.createDataFrame([], RULE_SCHEMA)
    model = FPGrowth(itemsCol="items", minSupport=min_rows / rows, minConfidence=min_confidence).fit(items)
    found = model.associationRules.filter(F.get("consequent", F.lit(0)).startswith("label=")).select(
        F.array_sort("antecedent").alias("tokens"), F.expr("substring(consequent[0], 7)").alias("label"), "confidence", "support"
    )
    found = written(found, "url-rules-all")
    common = model.freqItemsets.filter(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), "freq")
    each = found.withColumn("token", F.explode("tokens"))
    rarest = each.join(common, "token").groupBy(*found.columns).agg(F.min(F.struct("freq", "token"))["token"].alias("file"))
    rules = written(rarest, "url-rules-filed")
    shorter = rules.select("file", F.col("tokens").alias("_st"), F.col("label").alias("_sl"), F.col("confidence").alias("_sc"))
    beaten = (
        rules.drop("file").withColumn("file", F.explode("tokens"))
        .join(shorter, "file")
        .filter((F.col("label") == F.col("_sl")) & (F.col("_sc") >= F.col("confidence")))
        .filter((F.size("_st") < F.size("tokens")) & (F.size(F.array_except("_st", "tokens")) == 0))
        .select("tokens", "label").distinct()
    )
    return written(rules.join(beaten, ["tokens", "label"], "left_anti").select(*RULE_SCHEMA.replace(",", "").split()[::2]), "url-rules")


def match(urls: DataFrame, rules: DataFrame, url: str = "url", found: str = "found") -> DataFrame:
    """Add the best mined rule that fits each URL, as a struct (confidence, support, length, label, tokens), else null.

    The most confident rule wins, then the best supported, then the longer. URLs of equal token sets are
    matched once. Null URLs, and those without ``://``, fit no rule; an empty table gives an empty result.
    """
    require(urls, url)
    kept = urls.select(*without(urls, [found]))
    mine_, their = fresh(kept.columns, "_tokens"), fresh(kept.columns, "_their")
    marked = kept.withColumn(mine_, tokens_of(col(url)))
    sets = marked.select(col(mine_).alias("set")).distinct()
    best = (
        sets.withColumn("file", F.explode("set"))
        .join(rules, "file")
        .filter(F.size(F.array_except("tokens", "set")) == 0)
        .groupBy(F.col("set").alias(their))
        .agg(F.max(F.struct("confidence", "support", F.size("tokens").alias("length"), "label", "tokens")).alias(found))
    )
    # written, so that either it is small, or both sides are dealt out for the join and a frequent set of tokens can be split
    best = small_side(written(best, "url-matches"))
    return marked.join(best, col(mine_) == col(their), "left").drop(mine_, their)


def judge(
    urls: DataFrame, labelled: DataFrame, hand_rules: Sequence[tuple[str, str]], url: str = "url", default: str = ALLOW,
    min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict``, and the mined rule behind a verdict without rule by hand.

    The longest rule by hand decides; else the best mined rule; else ``default``. Rules are mined from those ``labelled``
    URLs (url, label) that no rule by hand decides: the others would teach what is known. Columns of these names are replaced.
    """
    ruled, _ = by_hand(host_of(F.col("url")), path_of(F.col("url")), hand_rules)
    rules = mine(labelled.filter(ruled.isNull()), "url", "label", min_rows, min_confidence)
    kept = urls.select(*without(urls, ["host", "path", "rule", "verdict", "mined", "confidence"]))
    found = fresh(kept.columns, "_found")
    matched = match(kept, rules, url, found).withColumns({"host": host_of(col(url)), "path": path_of(col(url))})
    name, said = by_hand(F.col("host"), F.col("path"), hand_rules)
    mined = F.when(name.isNull(), col(found))
    return matched.withColumns(
        {"rule": name, "verdict": F.coalesce(said, mined["label"], F.lit(default)), "mined": F.array_join(mined["tokens"], " "), "confidence": mined["confidence"]}
    ).drop(found)
