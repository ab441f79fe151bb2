"""LM scoring: stupid-backoff scores from n-gram counts over all documents, computed relationally.

Method: each map task cuts its documents into batches of so many bytes. Each batch lists its distinct n-grams of every order (64-bit hashes)
with how often it has them; these rows, packed per (batch, bucket), meet by hash in buckets, which are the count tables
partitioned by hash: a bucket adds up each n-gram and answers every batch that asked with the corpus counts, in the
order of its request. A batch then joins the answers to its exploded n-grams, scores each word and sums per document.
So a hot n-gram crosses the network once per batch, not once per occurrence, and no task holds all rows of a key.
A row of the exchange holds all n-grams that a batch has in a bucket; only buckets that it has some in get one, so there are never more rows than
n-grams. ``count_table`` gives the same counts as a plain table (n, gram_hash, count) for other uses.

A word w after context h scores c(h w) / c(h) if the n-gram was seen at least ``min_count`` times, else ``alpha`` times
the score with a shorter context, down to c(w) / N. The texts that are scored are those that are counted, so every n-gram is seen once at least; with
``min_count`` 2, one that a text alone has backs off. A document's total is the sum of natural logarithms, its score the mean of them.

Defined results: null, empty and wordless texts have 0 words and score 0; repeated rows count and are scored each; extra columns are left out;
a text's first words have the contexts there are; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .memory import give_back
from .shingles import K, mix, word_hashes
from .tokens import slices

ORDER = 2
ALPHA = 0.4
MIN_COUNT = 2
#: N-grams that a bucket is planned for, about 40 bytes each in its task.
BUCKET_GRAMS = 2_000_000
#: Bytes of text in a batch, a text at least; one task holds it with its counts.
BATCH_BYTES = 8_000_000


def gram_places(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words that end at each place, and whether the text reaches so far back."""
    out = np.zeros(len(words), np.uint64)
    start = np.repeat(bounds[:-1], np.diff(bounds))
    ok = np.arange(len(words)) - start >= n - 1
    for j in range(n):  # j words back
        out[j:] += words[: len(words) - j] * K[j]
    return mix(out + np.uint64(n)), ok


def requests(words: np.ndarray, bounds: np.ndarray, order: int, buckets: int):
    """The distinct n-grams (all orders together) sorted by bucket and hash, their counts here, and for each order the
    place of every word's n-gram in that list (-1 if there is none)."""
    hashes, places = [], []
    for n in range(1, order + 1):
        h, ok = gram_places(words, bounds, n)
        hashes.append(h[ok])
        places.append(np.flatnonzero(ok))
    joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    distinct, where, count = np.unique(joined, return_inverse=True, return_counts=True)
    bucket = _bucket(distinct, buckets)
    to = np.argsort(bucket, kind="stable")
    back = np.empty(len(to), np.int64)
    back[to] = np.arange(len(to))
    out, first = [], 0
    for h, place in zip(hashes, places, strict=True):
        at = np.full(len(words), -1, np.int64)
        at[place] = back[where[first : first + len(h)]]
        out.append(at)
        first += len(h)
    return distinct[to], count[to], bucket[to], out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """By range of the hash, so that a list sorted by hash is sorted by bucket as well."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, batch_bytes: int = BATCH_BYTES, id_type: str = "bigint") -> DataFrame:
    """A row per document: id, n_words, log_total (the sum), log_score (the mean of a word)."""
    if not 1 <= order <= len(K):
        raise ValueError(f"order must be from 1 to {len(K)}")
    spark = docs.sparkSession

    def coded(pages):
        """A batch's words as numbers of its sorted distinct word hashes, one packed row."""
        made = TaskContext.get().partitionId() << 32
        for page in pages:
            for t in slices(page, 1, batch_bytes):
                words, bounds = word_hashes(t.column(1))
                distinct, code = np.unique(words, return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "batch": pa.array([made], pa.int64()), "ids": pa.array([t.column(0).to_pylist()], pa.list_(pa.string())), "bounds": [bounds.astype(np.int64).tobytes()],
                    "vocabulary": [distinct.tobytes()], "codes": [_pack(code.astype(np.uint32))],
                })
                made += 1
        give_back()

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    packed = written(texts.mapInArrow(coded, "batch bigint, ids array<string>, bounds binary, vocabulary binary, codes binary"), "words")

    # N: the words of all documents, from the bounds of the batches.
    total_words = _total_words(packed)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_words * order // BUCKET_GRAMS))

    def unpacked(b):
        vocabulary = np.frombuffer(b["vocabulary"].as_py(), np.uint64)
        return vocabulary[_unpack(b["codes"].as_py(), np.uint32)], np.frombuffer(b["bounds"].as_py(), np.int64)

    def ask(it):
        for t in it:
            for row in range(t.num_rows):
                words, bounds = unpacked({c: t[c][row] for c in ("vocabulary", "codes", "bounds")})
                grams, count, bucket, _ = requests(words, bounds, order, buckets)
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                ends = [(i, int(a), int(z)) for i, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if z > a]
                for i in range(0, len(ends), 64):
                    part = ends[i : i + 64]
                    yield pa.RecordBatch.from_pydict({
                        "batch": pa.array([t["batch"][row].as_py()] * len(part), pa.int64()), "bucket": pa.array([k for k, _, _ in part], pa.int32()),
                        "grams": pa.array([grams[a:z].tobytes() for _, a, z in part], pa.binary()), "counts": pa.array([_pack(count[a:z].astype(np.uint32)) for _, a, z in part], pa.binary()),
                    })

    def answer(table: pa.Table) -> pa.Table:
        """Adds up a bucket's n-grams and answers each batch in its own order."""
        grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in table["grams"]]
        counts = [_unpack(c.as_py(), np.uint32) for c in table["counts"]]
        _, where = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts)).astype(np.int64)[where]
        ends = np.cumsum([len(g) for g in grams])
        give_back()
        return pa.table({"batch": table["batch"], "bucket": table["bucket"], "totals": pa.array([_pack(x) for x in np.split(total, ends[:-1])], pa.binary())})

    asked = packed.select("batch", "bounds", "vocabulary", "codes").mapInArrow(ask, "batch bigint, bucket int, grams binary, counts binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "batch bigint, bucket int, totals binary")
    answered = written(answered, "counts")
    smoothing = np.log(alpha)

    def scored(key, left: pa.Table, right: pa.Table) -> pa.Table:
        words, bounds = unpacked({c: left[c][0] for c in ("vocabulary", "codes", "bounds")})
        ids = left["ids"][0].as_py()
        by = np.argsort(right["bucket"].to_numpy())
        totals = [_unpack(right["totals"][int(i)].as_py(), np.int64) for i in by]
        total = np.concatenate(totals) if totals else np.zeros(0, np.int64)
        _, _, _, at = requests(words, bounds, order, buckets)
        c = [np.where(a >= 0, total[a], 0) if len(total) else np.zeros(len(a), np.int64) for a in at]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.log(c[0] / max(1, total_words)) + (order - 1) * smoothing
            for n in range(2, order + 1):
                # The context is the (n - 1)-gram that ends one word earlier.
                context = np.concatenate([[0], c[n - 2][:-1]])
                value = np.where(c[n - 1] >= min_count, np.log(c[n - 1] / np.maximum(context, 1)) + (order - n) * smoothing, value)
        # A text's first words have shorter contexts, which is no backoff.
        start = np.repeat(bounds[:-1], np.diff(bounds))
        value -= smoothing * np.maximum(0, order - 1 - (np.arange(len(words)) - start))
        sums = np.zeros(len(ids))
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            sums[full] = np.add.reduceat(value, bounds[full])
        give_back()
        n = np.diff(bounds)
        return pa.table({"id": pa.array(ids, pa.string()), "n_words": n, "log_total": sums, "log_score": sums / np.maximum(n, 1)})

    both = packed.groupBy("batch").cogroup(answered.groupBy("batch"))
    return both.applyInArrow(scored, "id string, n_words bigint, log_total double, log_score double").withColumn("id", F.col("id").cast(id_type))


def count_table(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """n, gram_hash, count of every n-gram up to ``order``: counted per batch of rows first, then by hash."""

    def run(it):
        for t in it:
            words, bounds = word_hashes(t.column(0))
            for n in range(1, order + 1):
                h, ok = gram_places(words, bounds, n)
                distinct, count = np.unique(h[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), n, np.int32)), pa.array(distinct.view(np.int64)), pa.array(count)], names=["n", "gram_hash", "count"])

    return docs.select(text_col).mapInArrow(run, "n int, gram_hash bigint, count bigint").groupBy("n", "gram_hash").agg(F.sum("count").alias("count"))


def _total_words(packed: DataFrame) -> int:
    def run(it):
        for t in it:
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(np.frombuffer(b.as_py()[-8:], np.int64)[0]) for b in t["bounds"]], pa.int64())})

    return packed.select("bounds").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
