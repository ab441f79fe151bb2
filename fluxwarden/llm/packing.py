"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Method: a document's ids (plus the end id) are cut into full pieces of ``length`` and a rest. Full pieces are
sequences of their own; rests are dealt at random into groups of about ``group_size``, and within each group packed by
first-fit decreasing: a tournament tree over the bins holds the largest free room below each node, so the first bin
that fits is found by one descent. Groups are independent Spark tasks and hold (id, length) rows, not texts.

Padding: a sequence is padded to ``length``, unless its length is a power of two.

Defined results: null texts count as empty and have the end id only; rows with equal ids are separate documents;
documents of equal length are ordered by id and start; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .memory import give_back
from .tokens import slices, word_encoder

LENGTH = 2048
END_ID = 1
GROUP_SIZE = 10_000
#: Bytes of text that a task encodes at once.
SLICE_BYTES = 2_000_000
PIECES = "id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class TournamentTree:
    """First bin with room for n, over bins that all begin with ``length``: node k holds the largest room below it."""

    def __init__(self, bins: int, length: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [length] * (2 * self.size)

    def first_fit(self, n: int) -> tuple[int, int]:
        """Takes n from the first bin with that much room; returns the bin and the room it had."""
        room, k = self.room, 1
        if room[1] < n:
            raise ValueError("no bin has room")
        while k < self.size:
            k *= 2
            if room[k] < n:
                k += 1
        had = room[k]
        bin_, room[k] = k - self.size, had - n
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
        return bin_, had


def first_fit_decreasing(sizes: Iterable[int], length: int = LENGTH) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; the items must come in decreasing order and be no longer than ``length``."""
    sizes = list(sizes)
    tree, bins, offsets = TournamentTree(max(1, len(sizes)), length), [], []
    for n in sizes:
        b, had = tree.first_fit(n)
        bins.append(b)
        offsets.append(length - had)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row per piece: id (as a string), start, length, ids_crc32, doc_tokens."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = word_encoder(tokenizer_path)
        for batch in batches:
            for b in slices(batch, 1, SLICE_BYTES):
                ids, offsets = encoder.encode(b.column(1))
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                rows, starts, sizes, crcs, totals = [], [], [], [], []
                for i in range(b.num_rows):
                    first, n = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                    for start in range(0, n + 1, length):
                        stop = min(n, start + length)
                        crc = zlib.crc32(raw[4 * (first + start) : 4 * (first + stop)])
                        whole = min(n + 1, start + length) - start
                        rows.append(i)
                        starts.append(start)
                        sizes.append(whole)
                        crcs.append(zlib.crc32(end, crc) if start + whole == n + 1 else crc)
                        totals.append(n + 1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals))], names=["id", "start", "length", "ids_crc32", "doc_tokens"])
        give_back()

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, group_size: int = GROUP_SIZE) -> DataFrame:
    """The pieces plus sequence_id, offset, padded_length and padding (of its sequence). Sequence ids are unique, not gapless."""
    parts = written(pieces(docs, tokenizer_path, id_col, text_col, length, end_id), "pieces")
    groups = max(1, -(-parts.count() // group_size))
    # A row's place in the written table, hashed, deals rows out evenly whatever they hold, and alike in every attempt.
    parts = parts.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(17)), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), length)
        used = pdf["length"].groupby(np.asarray(bins)).transform("sum")
        padded = np.where((used & (used - 1)) == 0, used, length)
        return pdf.assign(sequence_id=pdf["grp"] * (1 << 32) + np.asarray(bins, np.int64), offset=np.asarray(offsets, np.int64), padded_length=padded, padding=padded - used)[
            ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "padding"]
        ]

    return parts.groupBy("grp").applyInPandas(run, f"{PIECES}, sequence_id bigint, offset bigint, padded_length bigint, padding bigint")
