"""Benchmark decontamination: a broadcast hash set of test n-grams against every window of every document.

Method: the normalised 10-word windows of the test items become one small table (hash, words, items). Its size is
counted first; up to ``max_broadcast_grams`` it is broadcast and each document's windows probe it where the text
was read, without a shuffle; a larger table is joined by hash with an ordinary shuffle of windows, which are a row of key, place, length and hash
each; what they hit goes back to the documents, whose words are written once and stay where they are. A hash hit counts only if the
words themselves are equal. Then documents or the hit spans are removed.

Everything is a DataFrame expression: no Python runs on executors.

Defined results: null or wordless text has no words and no hits; an item of fewer than ``n`` words is one window of
its own length, a wordless one none; a document shorter than a window can't hold it; rows with equal id and text all
get the same result; an empty benchmark or document table gives no hits; extra columns are kept by the filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, fresh, lower_words, row_key, without_keys, written

#: Runs of ASCII digits, ASCII letters (lower-cased afterwards) and all that isn't ASCII; and what lies between.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
NGRAM = 10
#: About 300 bytes each with their words: 60 MB at most are broadcast.
MAX_BROADCAST_GRAMS = 200_000


def _words(text: Column) -> Column:
    return lower_words(text, WORD)


def benchmark_grams(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """Distinct windows of the test items: gram_len, gram_hash, gram (words), items (sorted distinct ids)."""
    b = benchmark.select(F.col(item_col).alias("item"), _words(F.col(text_col)).alias("w"))
    b = b.withColumn("len", F.least(F.size("w"), F.lit(n))).where("len > 0")
    b = b.select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    b = b.select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("gram"))
    b = b.groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    b = b.withColumn("hashes", F.transform("gram", lambda w: F.xxhash64(w))).withColumn("gram_len", F.size("gram"))
    return b.select("gram_len", _window_hash(F.col("hashes"), F.col("gram_len"), n).alias("gram_hash"), "gram", "items")


def _window_hash(h: Column, length: Column, n: int) -> Column:
    out = F.lit(None).cast("long")
    for k in range(n, 0, -1):
        out = F.when(length == k, _hash_at(h, F.lit(0), k)).otherwise(out)
    return out


def _hash_at(h: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(h, at + i) for i in range(k)])


def hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", n: int = NGRAM, max_broadcast_grams: int = MAX_BROADCAST_GRAMS,
) -> DataFrame:
    """One row per distinct (id, text): key, id, n_rows (how many rows share it), n_words, spans (hit windows as
    (at, len), 0-based), items (distinct hit item ids). Windows are scanned once; one shuffle holds a row per document
    and per hit."""
    grams = written(benchmark_grams(benchmark, item_col, item_text_col, n), "grams")
    sizes = {r["gram_len"]: r["c"] for r in grams.groupBy("gram_len").agg(F.count("*").alias("c")).collect()}  # n rows at most
    d = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), _words(F.col(text_col)).alias("words"))
    if sum(sizes.values()) > max_broadcast_grams:
        return _shuffled_hits(d, grams, sorted(sizes))
    grams = F.broadcast(grams.select("gram_hash", "gram_len", "gram", "items"))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # Position -1 stands for the document itself, so that one pass gives documents and hits.
    d = d.select("id", "key", "words", "hashes", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - 1, F.lit(-1)))).alias("at"))
    if len(sizes) > 1:
        d = d.withColumn("len", F.explode(F.when(F.col("at") < 0, F.array(F.lit(0))).otherwise(F.array(*[F.lit(k) for k in sorted(sizes)]))))
    else:
        d = d.withColumn("len", F.when(F.col("at") < 0, 0).otherwise(F.lit(next(iter(sizes), 0))))
    d = d.where((F.col("at") < 0) | ((F.col("len") > 0) & (F.col("at") + F.col("len") <= F.size("words"))))
    probe = F.lit(None).cast("long")
    for k in sorted(sizes):
        probe = F.when((F.col("at") >= 0) & (F.col("len") == k), _hash_at(F.col("hashes"), F.col("at"), k)).otherwise(probe)
    d = d.select("id", "key", "words", "at", "len", probe.alias("hash"))
    found = d.join(grams, (d["hash"] == grams["gram_hash"]) & (d["len"] == grams["gram_len"]), "left")
    found = found.where((F.col("at") < 0) | (F.col("gram").isNotNull() & (F.slice("words", F.col("at") + 1, F.greatest(F.col("len"), F.lit(1))) == F.col("gram"))))
    hit = F.col("at") >= 0
    found = found.select(
        "id", "key", F.when(~hit, 1).otherwise(0).alias("one"), F.when(~hit, F.size("words")).alias("nw"),
        F.when(hit, F.struct(F.col("at"), F.col("len"))).alias("span"), F.when(hit, F.col("items")).alias("items"),
    )
    return found.groupBy("key").agg(
        F.first("id").alias("id"), F.sum("one").alias("n_rows"), F.max("nw").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _shuffled_hits(d: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """The same for a benchmark too large to broadcast. ``d``: id, key, words."""
    one = d.groupBy("key").agg(F.first("id").alias("id"), F.count("*").alias("n_rows"), F.first("words").alias("words"))
    one = written(one, "words")

    def windows(h: Column) -> Column:
        of = lambda k: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda at: F.struct(at.alias("at"), F.lit(k).alias("len"), _hash_at(h, at, k).alias("hash")))
        none = F.array().cast("array<struct<at:int,len:int,hash:bigint>>")
        return F.concat(none, *[F.when(F.size(h) >= k, of(k)).otherwise(none) for k in sizes])

    w = one.select("key", F.explode(bind(F.transform("words", lambda x: F.xxhash64(x)), windows)).alias("w")).select("key", "w.*")
    found = w.join(grams, (w["hash"] == grams["gram_hash"]) & (w["len"] == grams["gram_len"])).select("key", "at", "len", "gram", "items")
    found = found.groupBy(F.col("key").alias("hit_key")).agg(F.collect_list(F.struct("at", "len", "gram", "items")).alias("found"))
    both = one.join(found, one["key"].eqNullSafe(found["hit_key"]), "left")
    true = F.filter(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), lambda x: F.slice(F.col("words"), x["at"] + 1, x["len"]) == x["gram"])
    both = both.select("key", "id", "n_rows", F.size("words").alias("n_words"), true.alias("found"))
    spans, items = F.transform("found", lambda x: F.struct(x["at"], x["len"])), F.flatten(F.transform("found", lambda x: x["items"]))
    return both.select("key", "id", "n_rows", "n_words", F.array_sort(F.array_distinct(spans)).alias("spans"), F.array_sort(F.array_distinct(items)).alias("items"))


def covered(spans: Column) -> Column:
    """Words inside any of the sorted (at, len) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def scan(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row per document row: id, n_words, n_hit, items, contaminated."""
    h = hits(docs, benchmark, **options)
    h = h.select("id", "n_rows", F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).alias("n_hit"), "items")
    h = h.withColumn("contaminated", F.col("n_hit") > 0)
    return h.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))).drop("copy", "n_rows")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options,
) -> DataFrame:
    """``docs`` with its own columns, without contaminated documents (``remove="documents"``) or with the hit words and
    the separators before them cut out of the texts (``remove="spans"``)."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    bad = hits(docs, benchmark, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0)
    if remove == "documents":
        return without_keys(docs, row_key(docs[id_col], docs[text_col]), bad, "contaminated")
    key, spans = fresh(docs, "_key", "_spans")
    keyed = docs.withColumn(key, row_key(docs[id_col], docs[text_col]))
    bad = bad.select(F.col("key").alias("gone"), F.col("spans").alias(spans))
    both = keyed.join(bad, keyed[key].eqNullSafe(bad["gone"]), "left")
    # A piece is a word with the separators before it, so piece i goes with word i.
    text = F.col(text_col)
    pieces = F.regexp_extract_all(text, F.lit(f"{GAP}{WORD}"), 0)
    keep = F.filter(pieces, lambda p, i: ~F.exists(F.col(spans), lambda s: (i >= s["at"]) & (i < s["at"] + s["len"])))
    tail = F.regexp_extract(text, f"({GAP})$", 1)
    cut = F.when(F.col(spans).isNull(), text).otherwise(F.concat(F.array_join(keep, ""), tail))
    return both.withColumn(text_col, cut).select(*[F.col(f"`{c}`") for c in docs.columns])
