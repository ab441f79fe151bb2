"""How filters interact: what each of them removes, alone and after others, in every order in which they can be applied.

A document is a mask: a bit for each filter that it fails and one for each label that it bears. For every mask there is one big integer with a
64-bit field for each outcome of each step of each order (5 filters: 120 orders, 600 steps), 1 where a document of that mask has the outcome. Adding the
integers of a part's documents counts all steps at once; a field can't flow over into the next before 2 ** 64 documents. Tasks add their own rows
first and send one integer per part; the sums are unpacked into a row per part, order and step.

Filters here (words are runs of anything but ASCII white space; null text is empty): A under 200 words, B distinct words under half of them, C over 2 % of A-Z,
D one of ``#$%&*|``, E a text that a smaller id has too. Texts are known by SHA-256 cut to 128 bits. Rows of one text with the same labels, part and marks become one
row with a number before texts are compared, so a text that a third of all rows hold is no hot key.

Odd input: a null part is the empty string, an id that is null is no smaller than another and bears no labels, repeated rows count each (none is smaller than itself).
A label table may name an id repeatedly: a mark holds if any of its rows has it. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .memory import give_back
from .tokens import plain_texts, slices

#: Fixed values of the filters.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
FILTERS = "ABCDE"
SLICE_BYTES = 4_000_000
#: Bytes of a field.
FIELD = 8
#: Sums of parts that a task holds at once.
MAX_PARTS = 256
MARKS = ("good", "toxic")


class Outcomes:
    """The packed outcomes of every mask. Bits of a mask: the filters in order, then the marks."""

    def __init__(self, filters: str = FILTERS, marks: tuple[str, ...] = MARKS):
        self.filters, self.marks = filters, marks
        self.orders = ["".join(p) for p in permutations(filters)]
        self.names = ["kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks]]
        self.packed = [self._pack(m) for m in range(1 << len(filters) + len(marks))]

    def _pack(self, mask: int) -> int:
        fields = np.zeros((len(self.orders), len(self.filters), len(self.names)), f"<u{FIELD}")
        fails = {f for k, f in enumerate(self.filters) if mask >> k & 1}
        bears = [mask >> len(self.filters) + k & 1 for k in range(len(self.marks))]
        for o, order in enumerate(self.orders):
            gone = False
            for s, f in enumerate(order):
                removed = f in fails and not gone
                redundant = f in fails and gone
                gone = gone or removed
                fields[o, s] = [not gone, removed, redundant, fails == {f}, *[removed and b for b in bears]]
        return int.from_bytes(fields.tobytes(), "little")

    def unpack(self, total: int) -> np.ndarray:
        """Counts by order, step and name."""
        size = (len(self.orders), len(self.filters), len(self.names))
        return np.frombuffer(total.to_bytes(FIELD * int(np.prod(size)), "little"), f"<u{FIELD}").reshape(size).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, digest, mask): the filters that read one text, A to D, by whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 2, SLICE_BYTES):
                texts = plain_texts(b.column(2))
                digests = [hashlib.sha256(t.as_buffer()).digest()[:16] for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(masks(texts))], names=["id", "part", "digest", "mask"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, part string, digest binary, mask int")


def masks(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3 of each text: A to D."""
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    flat, owner = split.flatten(), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # a text that begins or ends with white space gives empty words there
    codes = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False)[real].astype(np.int64)
    owner = owner[real].astype(np.int64)
    words = np.bincount(owner, minlength=n)
    pairs = np.sort(owner * (len(flat) + 1) + codes)
    first = np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]
    distinct = np.bincount(pairs[first] // (len(flat) + 1), minlength=n)
    points = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    upper = per_text((raw >= ord("A")) & (raw <= ord("Z")), offsets)
    symbols = per_text(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)), offsets)
    bits = (words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, 100 * upper > MAX_UPPER_PERCENT * points, symbols > 0)
    return sum(b.astype(np.int32) << k for k, b in enumerate(bits))


def per_text(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True bytes of each text."""
    at = np.searchsorted(np.flatnonzero(hit), offsets)
    return at[1:] - at[:-1]


def labelled(rows: DataFrame, labels: DataFrame, marks: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """``rows`` (see ``fingerprints``) with a bit for each mark that a row of ``labels`` with their id has, as counts of equal rows: (id, part, digest, mask, n)."""
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*[F.max(c).alias(f"_{m}") for m, c in marks.items()])
    # Rows without an id are spread by their texts.
    keyed = rows.withColumn("_none", F.when(F.col("id").isNull(), F.xxhash64("digest", "part")).otherwise(0)).withColumn("_key", F.coalesce(F.col("id").cast("string"), F.lit("")))
    marked = marked.withColumn("_none", F.lit(0).cast("long")).withColumn("_key", F.col("_id").cast("string"))
    joined = keyed.join(marked, ["_key", "_none"], "left")
    mask = F.col("mask")
    for k, m in enumerate(marks):
        mask = mask + F.when(F.coalesce(F.col(f"_{m}"), F.lit(False)), 1 << len(FILTERS) + k).otherwise(0)
    return joined.groupBy("_key", "_none", "id", "part", "digest", mask.alias("mask")).agg(F.count("*").alias("n")).drop("_key", "_none")


def with_repeats(rows: DataFrame) -> DataFrame:
    """(part, mask, n) of counted rows, with the bit of E where a smaller id has the same text. Rows of one text, part and mask meet as one row, made in the
    tasks that hold them, before texts are compared."""
    # Of the rows with the smallest id so far, how many there are: added up in two steps, since no aggregate counts them.
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    same = rows.groupBy("digest", "part", "mask").agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    w = Window.partitionBy("digest")
    first = F.col("nameless") + F.when(F.col("least.id") == F.min("least.id").over(w), F.col("least.n")).otherwise(0)
    same = same.withColumn("first", first)
    bit = 1 << FILTERS.index("E")
    both = F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    return same.select("part", F.explode(both).alias("r")).select("part", "r.mask", "r.n").where("n > 0")


def audit(rows: DataFrame, outcomes: Outcomes | None = None) -> DataFrame:
    """A row per part, order and step, zeros included, of counted masks (part, mask, n): kept, removed, redundant, unique_fails, <mark>_lost, and
    shapley, the filter's removed over all orders."""
    o = outcomes or Outcomes()
    width = FIELD * len(o.orders) * len(o.filters) * len(o.names)

    def as_batch(sums: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.to_bytes(width, "little") for v in sums.values()], pa.binary())], names=["part", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        for batch in batches:
            for part, mask, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, 0) + n * o.packed[mask]
                if len(sums) > MAX_PARTS:
                    yield as_batch(sums)
                    sums = {}
        if sums:
            yield as_batch(sums)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name != part:
                    if part is not None:
                        yield unpacked(part, total)
                    part, total = name, 0
                total += int.from_bytes(value.as_buffer(), "little")
        if part is not None:
            yield unpacked(part, total)

    def unpacked(part: str, total: int) -> pa.RecordBatch:
        counts = o.unpack(total)
        steps = [(order, s) for order in range(len(o.orders)) for s in range(len(o.filters))]
        letters = np.array([o.orders[order][s] for order, s in steps])
        removed = counts[:, :, 1].ravel()
        shapley = {f: int(removed[letters == f].sum()) for f in o.filters}
        columns = [pa.array([part] * len(steps)), pa.array([o.orders[order] for order, _ in steps]), pa.array([s + 1 for _, s in steps], pa.int32()), *[pa.array(counts[:, :, k].ravel()) for k in range(len(o.names))], pa.array([shapley[f] for f in letters])]
        return pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *o.names, "shapley"])

    sums = rows.select("part", "mask", "n").mapInArrow(add, "part string, total binary")
    sums = sums.repartition("part").sortWithinPartitions("part")
    counted = ", ".join(f"{name} bigint" for name in o.names)
    return sums.mapInArrow(spread, f"part string, filter_order string, step int, {counted}, shapley bigint")
