"""Token-ID output: one wavelet matrix per shard, in a compressed file that answers access, count and occurrence queries.

Method: documents are ranged by id over partitions, and each partition writes shards of whole documents, about
``shard_tokens`` ids each. A shard's ids are renumbered over its own sorted alphabet and stored as bit planes of a
wavelet matrix, from the highest bit down, each plane being the stable partition of the one above. Planes are kept in
blocks, each compressed by zstd, with the number of ones before each block; so access(i), rank(id, i) (counting) and
select(id, k) (occurrence lookup) decompress a block or two per plane and no more.

A shard image is a row of a Parquet table in the shared folder (a file per partition), so writing is atomic and any
store that Spark knows will do.

Image: magic, then little-endian u32 sizes (n ids, n documents, n alphabet, planes, compressed documents), the
alphabet as u32, zeros per plane as u32, per plane and block: ones before it (u32) and compressed size (u32); then the
documents (ids, lengths) and the blocks.

Defined results: null texts count as empty and have the end id only; null ids come first; rows with equal ids stand
next to each other as separate documents; extra columns are left out; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .tokens import slices, word_encoder

MAGIC = b"WAVM0001"
BLOCK_BYTES = 4096
BLOCK_BITS = BLOCK_BYTES * 8
SHARD_TOKENS = 1 << 20
END_ID = 1


class WaveletMatrix:
    """Reads a shard image; planes are decompressed block by block as they are asked for."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a wavelet matrix image")
        self.image = image
        self.n, docs, sigma, self.planes, packed = struct.unpack_from("<5I", image, 8)
        at = 28
        self.alphabet = np.frombuffer(image, "<u4", sigma, at)
        at += 4 * sigma
        self.zeros = np.frombuffer(image, "<u4", self.planes, at)
        at += 4 * self.planes
        self.blocks = -(-self.n // BLOCK_BITS)
        index = np.frombuffer(image, "<u4", 2 * self.planes * self.blocks, at).reshape(self.planes, self.blocks, 2)
        at += index.nbytes
        self.ones, sizes = index[:, :, 0], index[:, :, 1].astype(np.int64)
        doc_at, at = at, at + packed
        self.starts = at + np.cumsum(sizes.ravel()).reshape(sizes.shape) - sizes
        self.sizes = sizes
        self.doc_ids, self.doc_lengths = json.loads(zstandard.decompress(image[doc_at : doc_at + packed])) if docs else ([], [])
        self.cache: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, plane: int, block: int) -> np.ndarray:
        key = (plane, block)
        if key not in self.cache:
            a = int(self.starts[key])
            self.cache[key] = np.frombuffer(zstandard.decompress(self.image[a : a + int(self.sizes[key])], BLOCK_BYTES), np.uint8)
        return self.cache[key]

    def _bit(self, plane: int, i: int) -> int:
        block, at = divmod(i, BLOCK_BITS)
        return int(self._block(plane, block)[at >> 3]) >> (7 - (at & 7)) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones before place i."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        block, at = divmod(i, BLOCK_BITS)
        data = self._block(plane, block)
        n = int(self.ones[plane, block]) + int(np.bitwise_count(data[: at >> 3]).sum())
        return n + (int(data[at >> 3]) >> (8 - (at & 7))).bit_count() if at & 7 else n

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit."""
        before = self.ones[plane].astype(np.int64)
        if not bit:
            before = np.arange(self.blocks) * BLOCK_BITS - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._block(plane, block))[: self.n - block * BLOCK_BITS]
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for p in range(self.planes):
            bit = self._bit(p, i)
            ones = self._ones(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int:
        c = int(np.searchsorted(self.alphabet, token))
        return c if c < len(self.alphabet) and self.alphabet[c] == token else -1

    def _span(self, code: int, i: int) -> tuple[int, int]:
        """Where the id's run begins below the last plane, and where place i would stand in it."""
        a, b = 0, i
        for p in range(self.planes):
            oa, ob = self._ones(p, a), self._ones(p, b)
            a, b = (int(self.zeros[p]) + oa, int(self.zeros[p]) + ob) if code >> (self.planes - 1 - p) & 1 else (a - oa, b - ob)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often the id stands before place i."""
        code = self._code(token)
        if code < 0:
            return 0
        a, b = self._span(code, min(i, self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the id's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        code = self._code(token)
        i = self._span(code, 0)[0] + k
        for p in range(self.planes - 1, -1, -1):
            bit = code >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - (int(self.zeros[p]) if bit else 0))
        return i

    def decode(self) -> np.ndarray:
        """All ids in order, from the last plane up."""
        codes = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            plane = np.concatenate([self._block(p, b) for b in range(self.blocks)])
            ones = np.unpackbits(plane, count=self.n).view(bool)
            up, z = np.empty_like(codes), int(self.zeros[p])
            up[np.flatnonzero(~ones)] = codes[:z]  # places are faster than masks where bits are mixed
            up[np.flatnonzero(ones)] = codes[z:] | codes.dtype.type(1 << (self.planes - 1 - p))
            codes = up
            for b in range(self.blocks):
                self.cache.pop((p, b), None)
        return self.alphabet[codes]


def wavelet_image(ids: np.ndarray, doc_ids: list, doc_lengths: list[int]) -> bytes:
    present = np.zeros(int(ids.max()) + 1, bool) if len(ids) else np.zeros(0, bool)
    present[ids] = True
    alphabet = np.flatnonzero(present).astype("<u4")
    planes = max(1, int(len(alphabet) - 1).bit_length()) if len(ids) else 0
    small = np.uint16 if planes <= 16 else np.uint32
    code = np.zeros(len(present), small)
    code[alphabet] = np.arange(len(alphabet), dtype=small)
    v, zeros, index, body = code[ids], [], [], []
    squeeze = zstandard.ZstdCompressor(level=1)
    for p in range(planes):
        ones = (v & small(1 << (planes - 1 - p))) != 0
        packed = np.packbits(ones)
        before = 0
        for at in range(0, len(packed), BLOCK_BYTES):
            block = packed[at : at + BLOCK_BYTES]
            data = squeeze.compress(block)
            index.append((before, len(data)))
            body.append(data)
            before += int(np.bitwise_count(block).sum())
        low = v[np.flatnonzero(~ones)]
        zeros.append(len(low))
        v = np.concatenate([low, v[np.flatnonzero(ones)]])
    docs = squeeze.compress(json.dumps([doc_ids, doc_lengths]).encode())
    head = MAGIC + struct.pack("<5I", len(ids), len(doc_ids), len(alphabet), planes, len(docs))
    return b"".join([head, alphabet.tobytes(), np.array(zeros, "<u4").tobytes(), np.array(index, "<u4").tobytes(), docs, *body])


def write_shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Writes the shards in ascending order of ids and returns them as a table: part, shard, start (ids before it in its
    part), n_tokens, image."""

    def run(batches):
        encoder, part = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        shard = start = held = 0
        ids, names, lengths = [], [], []

        def image():
            nonlocal shard, start, held
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "start": [start], "n_tokens": [held], "image": pa.array([wavelet_image(np.concatenate(ids), names, lengths)], pa.binary())})
            shard, start, held = shard + 1, start + held, 0
            for x in (ids, names, lengths):
                x.clear()
            return out

        for batch in batches:
            for b in slices(batch, 1):
                found, offsets = encoder.encode(b.column(1))
                n = np.diff(offsets)
                flat = np.insert(found, offsets[1:], np.uint32(end_id))
                offsets = offsets + np.arange(len(offsets))
                own, first = b.column(0).to_pylist(), 0
                while first < b.num_rows:  # whole documents until the shard is full
                    last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + shard_tokens - held, "right")) - 1)
                    ids.append(flat[offsets[first] : offsets[last]])
                    names += own[first:last]
                    lengths += (n[first:last] + 1).tolist()
                    held += int(offsets[last] - offsets[first])
                    first = last
                    if held >= shard_tokens or first < b.num_rows:
                        yield image()
        if held:
            yield image()

    # Rows of one id are told apart by the hash of their texts, so that they spread over ranges as well.
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ranged = d.repartitionByRange("id", "h").sortWithinPartitions("id", "h").drop("h")
    return written(ranged.mapInArrow(run, "part int, shard int, start bigint, n_tokens bigint, image binary"), "shards")


def read_documents(shards: DataFrame, id_type: str = "bigint") -> DataFrame:
    """From the shard images: id, start (ids of all documents before it), n_tokens, ids_crc32 of each document."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per written partition
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = shards.join(F.broadcast(before), "part").select((F.col("base") + F.col("start")).alias("start"), "image")

    def run(batches):
        for b in batches:
            for start, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                m = WaveletMatrix(image.as_py())
                raw = memoryview(m.decode().astype("<u4", copy=False).tobytes())
                ends = np.cumsum([0, *m.doc_lengths])
                crcs = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"id": pa.array([None if x is None else str(x) for x in m.doc_ids], pa.string()), "start": pa.array(start + ends[:-1]), "n_tokens": pa.array(m.doc_lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    out = placed
    return out.mapInArrow(run, "id string, start bigint, n_tokens bigint, ids_crc32 bigint").withColumn("id", F.col("id").cast(id_type))
