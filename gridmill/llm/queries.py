"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import exact_index, fingerprints, jaccard_join, language_id, line_dedup, mixing, periodic_runs, pieces, quality_rules, sharding, spelling, toxicity, url_filters
from gridmill.llm.common import words_of
from gridmill.llm.registry import query, table
from gridmill.session import scratch_path


def tokenizer_model() -> bytes:
    import public_tokenizers

    return pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def piece_digests(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the decoded text of each document; the numbers stay in the operator's columns."""
    done = pieces.encode_decode(docs.select("doc_id", "text"), tokenizer_model())
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return piece_digests(table(spark, sf, "documents"))


SHARDS = 16


@query("op9_sharding")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in 16 shards of near equal bytes; ``slot`` is the place in the shard, ``virtual_slot`` the hashed slot."""
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")
    rows = table(spark, sf, "documents").select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slot_map = sharding.rebalance(rows, "doc_id", F.col("size"), SHARDS, scratch_path(spark, "slot-map"), new=("shard", "slot", "virtual_slot"))
    done = sharding.placed(rows, "doc_id", F.col("size"), slot_map, [], place="slot")
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )


@query("op6_mixing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op8_line_dedup", line_dedup.SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select(*line_dedup.digests(done))


@query("op10_fingerprints")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf, "documents"))


URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)


@query("op3_url_filters")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Pages judged by the rules, else by association rules.

    Rules are mined from pages whose path names a labelled document after the language: block for low quality or toxic ones.
    """
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_filters.judge(pages, labelled_pages(pages, table(spark, sf, "labels")), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "mined", "confidence"
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, label) of the pages that name a labelled document."""
    number = F.regexp_extract(url_filters.path_of(F.col("url")), r"^/[a-z]{2}/([0-9]{1,18})(?:[/.]|$)", 1)
    named = pages.select("url", number.try_cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL")
    by_doc = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    judged = F.when(bad, "block").when(F.col("quality").isNotNull(), "allow")
    return named.join(by_doc, "doc_id").select("url", judged.alias("label"))


@query("op1_quality_rules")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, sf, "labels"))
    return quality_rules.judged(docs, rules, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query("op2_language_id")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language_id.fit(docs.filter(fold != 2).select("text", "lang"))
    rows = docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out"))
    return language_id.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query("op4_toxicity")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """The chain over the categories that ``labels`` has: low quality first, then toxic."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chain = toxicity.fit(docs, table(spark, sf, "labels"), categories)
    return toxicity.predict(docs, chain).select(
        "doc_id", F.col("is_toxic").alias("toxic"), F.col("p_toxic").alias("score"), "p_low_quality", "is_low_quality"
    )


@query("op5_ngram_jaccard_join")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf, "documents").select("doc_id", "text"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text); in a tenth, by the crc32 of doc_id, the words from place a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # words in a column of their own: inside the lambda they would be looked for again at each place
    split = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words_of(F.col("text"))).alias("words"))
    n = F.size("words")
    a = F.pmod(F.floor(F.col("h") / 10), n)
    p = 1 + F.floor((n - F.col("a")) / (3 + F.floor(F.col("h") / 10) % 8))
    measured = split.withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    place = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int")
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i))), " ")
    return measured.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of each text, made periodic in a tenth of them; the run of greatest exponent, and digests of all runs and of what is left."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = periodic_runs.with_runs(made_periodic(docs)).drop("text")
    # lengths over periods are compared as products of whole numbers; runs come by start and then period, so the first of equals stays
    greater = lambda x, best: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda best, x: F.when(greater(x, best), x).otherwise(best))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


SLIP = 97


@query("op12_spelling_variants", spelling.SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents").select("doc_id", "text"), slip=SLIP)


@query("op13_exact_dedup", exact_index.SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return exact_index.dedup(table(spark, sf, "documents").select("doc_id", "text"))
