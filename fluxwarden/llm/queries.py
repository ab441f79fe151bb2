"""The driver's queries over the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, filter_audit, licences, lm_score, near_dup, oracles, packing, quality, runs, token_counts, token_file, toxicity, url_filter
from .common import bind, table, words_of, written
from .oracles import PLANTED

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.fit(toxicity.labelled_sample(docs, labels, ~toxicity.held_out()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir), keep_text=False)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The counts are made once and kept as a narrow table; the fit and the verdicts both read it.
    counts = written(quality.with_stats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "stats")
    model = quality.fit_corpus(counts)
    out = counts.withColumn("base_failed", quality.base_failed()).withColumn("posterior", F.round(quality.posterior_column(model), 6))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= quality.MIN_POSTERIOR)).drop(quality.LINES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select(F.col("id").cast("long").alias("doc_id"), *packed.columns[1:])


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_file.write_shards(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return token_file.read_documents(shards).withColumnRenamed("id", "doc_id")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"), licences.templates(spark), whole_text=True)
    return found.select(F.col("id").alias("doc_id"), "licence", F.round("dice", 6).alias("dice"), F.col("n_lines").cast("long").alias("n_lines"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.cluster(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.select(F.col("id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents"))
    return scored.select(F.col("id").alias("doc_id"), "n_words", F.round("log_total", 4).alias("log_total"), F.round("log_score", 6).alias("log_score"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), "contaminated",
    )


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("select * from values (-1L, 0L, 'user', :said), (-1L, 1L, 'assistant', :said) as t(conv_id, turn, role, text)", {"said": PLANTED})
    found = chat.digests(chat.format_table(chat.turn_chains(rows.unionByName(planted))))
    return found.select(F.col("conv").cast("long").alias("conv_id"), *found.columns[2:])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.fingerprints(table(spark, sf_dir, "documents"))
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return filter_audit.audit(filter_audit.with_repeats(filter_audit.labelled(rows, table(spark, sf_dir, "labels"), marks)))


def planted_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts: of every tenth document by crc32 of its id, the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        repeated = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), repeated), " ")).otherwise(F.col("text"))

    return docs.withColumn("text", F.when(h % 10 == 0, bind(words_of(F.col("text")), periodic)).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    top = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    found = found.withColumn("top", top).select(
        F.col("id").cast("long").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "top.*", F.floor(F.col("top.length") * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_quality_rules, op4_packing, op5_token_file, op6_licence_scan, op7_jaccard_join, op8_token_counts, op9_lm_score, op10_decontaminate, op11_chat_format, op12_filter_audit, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
