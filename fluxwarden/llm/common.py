"""Pieces that several training-data operators share: text columns, shared storage, small helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the same thing, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words_of(c: Column, pattern: str = WORD) -> Column:
    """The words of a text as an array; null has none."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), 0), F.array().cast("array<string>"))


def lower_words(text: Column, pattern: str) -> Column:
    """The words of a text with A-Z lower-cased. ``pattern`` must match upper-case letters as it does lower-case ones.
    ``translate`` is slow, so it sees only the words that hold other than ASCII characters."""
    ascii_only = lambda c: F.octet_length(c) == F.char_length(c)
    each = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda w: F.when(ascii_only(w), F.lower(w)).otherwise(F.translate(w, UPPER, UPPER.lower())))
    found = F.when(ascii_only(text), F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)).otherwise(each)
    return F.coalesce(found, F.array().cast("array<string>"))


def bind(value: Column, f) -> Column:
    """f(value) with ``value`` computed once, however often f names it and wherever the optimizer moves the result."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """A filter on a costly condition, which stays where it is put: an ordinary filter would be pushed below the
    columns it reads, and their expressions be computed again for it."""
    (name,) = fresh(df, "_keep")
    return df.withColumn(name, F.explode(F.array_repeat(F.lit(True), F.when(condition, 1).otherwise(0)))).drop(name)


def row_key(id_col: Column, text: Column) -> Column:
    """Identifies a row by what it holds, so that a task run again gives the same keys. Rows with equal id and text share a key."""
    return F.struct(id_col.cast("string").alias("id"), F.xxhash64(text).alias("h"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("n"))


#: Keys broadcast at most, up to 100 bytes each; beyond that, joins on them shuffle.
MAX_BROADCAST_KEYS = 1_000_000


def text_key(text: Column) -> Column:
    """Identifies a text, null as well: two hashes and its length."""
    return F.struct(F.xxhash64(text).alias("h"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("c"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("n"))


def without_keys(docs: DataFrame, key: Column, gone: DataFrame, label: str) -> DataFrame:
    """``docs`` with its own columns, without the rows whose key is in ``gone`` (column key), which is written first."""
    gone = written(gone.select(F.col("key").alias("gone")).distinct(), label, rebalance=True)
    if gone.count() <= MAX_BROADCAST_KEYS:
        gone = F.broadcast(gone)
    (name,) = fresh(docs, "_key")
    keyed = docs.withColumn(name, key)
    return keyed.join(gone, keyed[name].eqNullSafe(gone["gone"]), "left_anti").drop(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that was set; a folder of this machine
    only where Spark runs in this process alone, as in tests."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not (made := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fluxwarden-"))
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
    return made.get()


#: Folders of intermediate tables, innermost ``scratch`` last; what is written outside of one is left for the store's own expiry.
_owners: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables that were written inside when it ends: results must be written by then."""
    _owners.append([])
    try:
        yield
    finally:
        for path in _owners.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str, rebalance: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors. ``rebalance`` is for results
    far smaller than what they are made from: their rows are shuffled into few files instead of one file per task."""
    if rebalance:
        df = df.hint("rebalance")
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/fluxwarden/{label}-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given column names, changed where ``df`` already has a column so called (in any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out
