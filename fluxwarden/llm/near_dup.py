"""N-gram Jaccard join by parity sketches: XOR-hashed shingles, pigeonhole join of sketch pieces per size band, verify.

Two texts link when their sets of word shingles have Jaccard similarity of at least ``num`` / ``den``. Method:

1. Equal sets are one node (its 64-bit set hash; sets are held apart by a second hash, and nodes that two sets would share
   get ids from that one instead), so exact copies are never compared with each other.
2. Bands. For sizes a and b, similarity t allows a symmetric difference of at most (a + b)(1 - t) / (1 + t). Bands cover
   the sums a + b in steps of 25 %; a set of n shingles meets others only in the two or three bands that its sums
   can reach. A band has one bound D.
3. Parity sketches. In a band, every shingle flips one bit of one of P > D pieces of a (virtual, very wide) bit sketch;
   a piece is kept as the XOR of the codes of its set bits. Sketches of two sets differ in no more bits, so in no more
   pieces, than the sets differ in shingles: linked sets agree in P - D pieces at least. Each piece that isn't empty is
   an entry (band, piece, XOR); entries are dealt by hash to buckets, and equal ones found there. Where both sets of
   a pair fill over D pieces, or one does, some piece that agrees isn't empty. A set that fills fewer also gives its
   empty pieces, under a key that only such sets have.
4. Candidates. In a bucket, a short run of equal entries gives all its pairs. A long one gives pairs of its hub, the run's
   smallest ref, with the others: as many rows as the run has refs. Runs of one group mostly have the same hub, so its
   many runs together give about one row per ref. Entries that many texts of one batch share are combined there: the task sends their smallest
   ref alone to the bucket and keeps the list, which learns the run's hub by a join. So a bucket sees a hot entry once per batch.
5. Verification. A dense parity sketch of each node (a bit for each shingle, at least) has a Hamming distance that bounds the
   difference from below; pairs beyond D go. The others' shingle sets are read from the texts again and compared exactly.
6. Components of the links by alternating minimum over neighbours and pointer jumping, in written rounds.
7. Families. The nodes paired with a hub by long runs are its family; two nodes of a long run are in one. Only pairs of
   a family that lie in different components still matter, so families within one component are done. In the
   others, the nodes outside the family's largest component meet all of it, block by block: first by wide sketches
   (eight bits a shingle), which gives the nodes that may still link; then by these nodes' shingle sets, nearest first, where a pair already
   joined is passed over. What comes out are links that join components, fewer than nodes, and components are brought up to date once.

Entries travel as packed NumPy columns (bucket rows), never as a Spark row each: 4 bytes of key and the gap to the place of the
text before, a byte mostly, however many buckets there are. A place in its task (ref) becomes a node by a join, once pairs are made; copies
give their entries once for a batch, and only those of one batch go on to the buckets. What can't be decided by a bounded
step is decided by an exact one: there are no caps. Links inside a component are looked for only as far as the component needs
them, so their number isn't told.

Defined results: null, empty and wordless texts have no shingles and are linked with nothing, not even each other; rows
with equal texts share a node; null ids take part but are no one's smallest id; extra columns are kept by keep_one();
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written
from .memory import give_back
from .shingles import K, mix, shingle_sets
from .tokens import slices

SHINGLE = 5
NUM, DEN = 80, 100
#: Runs of up to so many refs give all their pairs; longer ones go by step 4.
SHORT_RUN = 8
#: Entries that a bucket is planned for; a bucket's memory is about 50 bytes each.
BUCKET_ENTRIES = 1_000_000
#: Texts of a batch that share an entry, from which on they are combined.
COMBINE_FROM = 64
#: Ids broadcast at most (8 bytes each); beyond that, the join shuffles.
MAX_BROADCAST_IDS = 1_000_000
#: Places of copies broadcast at most (4 bytes each).
MAX_BROADCAST_PLACES = 8_000_000
#: Shingles of a block of a family's nodes: a task compares two blocks, 8 bytes a shingle each.
BLOCK_SHINGLES = 800_000
#: What a task holds at once: bytes of text, and entries before they are packed.
SLICE_BYTES = 3_000_000
HELD_ENTRIES = 1_000_000


class Bands:
    """Bands of sums of two sizes, for similarity num / den: band k holds sums over bounds[k] up to bounds[k + 1]."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        bounds = [2]
        while bounds[-1] < 1 << 33:
            bounds.append(max(bounds[-1] + 1, bounds[-1] * 5 // 4))
        self.bounds = np.array(bounds, np.int64)
        self.most = self.bounds[1:] * (den - num) // (den + num)  # D of each band
        self.pieces = (self.most + 1) * 11 // 10 + 8

    def span(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last band that a set of n shingles can share with another."""
        low = n + -(-n * self.num // self.den)
        high = n + n * self.den // self.num
        return np.searchsorted(self.bounds, low) - 1, np.searchsorted(self.bounds, high) - 1


def set_hashes(sets: np.ndarray, bounds: np.ndarray, seed: int = 5) -> np.ndarray:
    """A 64-bit hash of each set, as a signed number; 0 for the empty set."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(sets ^ K[seed]), bounds[full]) + np.diff(bounds)[full].astype(np.uint64) * K[6])
    return out.view(np.int64)


def node_ids(sets: np.ndarray, bounds: np.ndarray, shared: frozenset[int], bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Each set's node (``bits`` of its hash) and its second hash, which is the node where different sets share the first one."""
    first, second = set_hashes(sets, bounds) >> (64 - bits), set_hashes(sets, bounds, 2)
    if shared:
        first = np.where(np.isin(first, np.fromiter(shared, np.int64, len(shared))), second, first)
    return first, second


def dense_sketches(sets: np.ndarray, bounds: np.ndarray, factor: int = 1) -> list[bytes]:
    """Parity sketch of each set: ``factor`` bits a shingle, rounded up to a power of two of at least 64; each shingle
    flips one. Halves XOR to the sketch of half the size, so sketches of different sizes can be compared."""
    low = (mix(sets ^ K[7]) >> np.uint64(16)).astype(np.int64)
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        bits = 1 << max(6, (factor * (z - a) - 1).bit_length()) if z > a else 64
        out.append(np.packbits((np.bincount(low[a:z] & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes())
    return out


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches, folded to ``size`` bytes."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def entries(sets: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """64-bit entry keys and the row that each is of. Sets are sorted, so a piece is a run of a range of hashes."""
    n = np.diff(bounds)
    first, last = bands.span(n)
    keys, rows = [], []
    owner = np.repeat(np.arange(len(n)), n)
    for j in range(3):
        band = first + j
        use = (n > 0) & (band <= last) & (band >= 0)
        use &= np.where(use, bands.most[np.maximum(band, 0)] > 0, False)  # D = 0 links equal sets only
        if not use.any():
            continue
        mine = use[owner]
        h, own = sets[mine], owner[mine]
        b = band[own]
        piece = ((h >> np.uint64(32)) * bands.pieces[b].astype(np.uint64)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (own[1:] != own[:-1])]))
        parity = np.bitwise_xor.reduceat(mix(h ^ K[3]), start)
        own, b, piece = own[start], b[start], piece[start]
        place = b.astype(np.uint64) * K[0] + piece * K[1]
        keys.append(mix(parity ^ mix(place)))
        rows.append(own)
        filled = np.bincount(own, minlength=len(n))
        for i in np.flatnonzero(use & (filled <= bands.most[np.maximum(band, 0)])):  # rare: give its empty pieces as well
            empty = np.setdiff1d(np.arange(bands.pieces[band[i]]), piece[own == i].astype(np.int64)).astype(np.uint64)
            keys.append(mix(mix(np.uint64(band[i]) * K[0] + empty * K[1]) ^ K[4]))
            rows.append(np.full(len(empty), i))
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def packed_places(places: np.ndarray) -> bytes:
    """Ascending places as gaps, of as few bytes each as the largest needs."""
    gaps = np.diff(places, prepend=0)
    return gaps.astype(np.min_scalar_type(int(gaps.max()))).tobytes()


def unpacked_places(packed, count: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, f"u{memoryview(packed).nbytes // count}"), dtype=np.int64)


SKETCHED = "kind int, id string, text_hash bigint, node bigint, second bigint, n bigint, sketch binary, wide binary, ref bigint, batch bigint, bucket int, keys binary, places binary, combined binary, key bigint, refs binary"


def sketched(docs: DataFrame, bands: Bands, buckets: int, shingle: int, id_col: str, text_col: str, shared: frozenset[int] = frozenset(), hash_bits: int = 64, combine_from: int = COMBINE_FROM) -> DataFrame:
    """Rows of kind 0 are documents (id, text_hash, node, second, n, sketch, wide; ref: partition and place, for the first of its node
    in a batch; batch: its first ref), of kind 1 the entries of a batch for a bucket: keys (u32), their places (gaps, from ``batch`` on), and whether a place stands for a
    combined list (u8; null: none does); of kind 2 such lists: key (bucket and u32), refs (i64)."""
    fields = [f.strip().split(" ")[0] for f in SKETCHED.split(",")]
    types = dict(zip(fields, (pa.int32(), pa.string(), *[pa.int64()] * 4, *[pa.binary()] * 2, pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64(), pa.binary()), strict=True))

    def out(**columns):
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f], t) if f in columns else pa.nulls(size, t) for f, t in types.items()], names=fields)

    def run(batches):
        held: list = []
        held_rows = 0
        given = first = TaskContext.get().partitionId() << 40  # next ref, and that of the batch's first text
        seen = np.zeros(0, np.int64)

        def flush():
            nonlocal held, held_rows, first, seen
            keys = np.concatenate([k for k, _ in held])
            refs = np.concatenate([r for _, r in held])
            base, first = first, given
            held, held_rows, seen = [], 0, seen[:0]
            if not len(keys):
                return
            bucket_of = lambda k: ((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(keys, kind="stable")  # refs ascend, so the first of equal keys has the smallest
            k = keys[order]
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(start, len(k)))
            many = size >= combine_from
            lists = {"key": [], "refs": []}
            for at, count in zip(start[many].tolist(), size[many].tolist(), strict=True):
                lists["key"].append(int(bucket_of(k[at])) << 32 | int(k[at] & np.uint64(0xFFFFFFFF)))
                lists["refs"].append(refs[order[at : at + count]].tobytes())
            listed = np.repeat(many, size)
            keep = ~listed
            keep[start] = True
            # The entries that go on keep the order of their texts within a bucket, so gaps between places are small.
            flags = np.zeros(len(keys), np.uint8)
            flags[order[keep]] = 1 + listed[keep]
            at = np.flatnonzero(flags)
            bucket = bucket_of(keys[at]).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            sorted_ = np.argsort(bucket, kind="stable")
            at, bucket = at[sorted_], bucket[sorted_].astype(np.int32)
            low, places, combined = keys[at].astype(np.uint32), refs[at] - base, flags[at] - 1
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            raw = {"batch": np.full(len(cuts), base), "bucket": bucket[cuts], "keys": [], "places": [], "combined": []}
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
                raw["keys"].append(low[a:z].tobytes())
                raw["places"].append(packed_places(places[a:z]))
                raw["combined"].append(combined[a:z].tobytes() if combined[a:z].any() else None)
            yield out(kind=np.ones(len(cuts), np.int32), **raw)
            if lists["key"]:
                yield out(kind=np.full(len(lists["key"]), 2, np.int32), **lists)

        for batch in batches:
            for b in slices(batch, 2, SLICE_BYTES):
                sets, bounds = shingle_sets(b.column(2), shingle)
                nodes, second = node_ids(sets, bounds, shared, hash_bits)
                # Copies within a batch of entries give theirs once.
                _, one = np.unique(nodes, return_index=True)
                one = np.sort(one[~np.isin(nodes[one], seen)])
                own_refs = given + np.arange(len(one))
                ref = np.full(b.num_rows, -1)
                ref[one] = own_refs
                yield out(kind=np.zeros(b.num_rows, np.int32), id=b.column(0), text_hash=b.column(1), node=nodes, second=second, n=np.diff(bounds), sketch=dense_sketches(sets, bounds), wide=dense_sketches(sets, bounds, 8), ref=pa.array(ref, mask=ref < 0), batch=np.full(b.num_rows, first))
                given += len(one)
                seen = np.concatenate([seen, nodes[one]])
                pick = [sets[bounds[i] : bounds[i + 1]] for i in one]
                own_bounds = np.concatenate([[0], np.cumsum([len(p) for p in pick])]).astype(np.int64)
                keys, rows = entries(np.concatenate(pick) if pick else sets[:0], own_bounds, bands)
                by_text = np.argsort(rows, kind="stable")
                held.append((keys[by_text], own_refs[rows[by_text]]))
                held_rows += len(keys)
                if held_rows >= HELD_ENTRIES:
                    yield from flush()
        if held:
            yield from flush()
        give_back()

    d = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, SKETCHED)


def without_copies(found: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    """The entries (kind 1) without those of texts whose node has a smaller ref, in another batch; those that stand for a list stay."""
    names = ["batch", "bucket", "keys", "places", "combined"]
    found = found.select(*names)
    copies = own.where("ref is not null").select("node", "ref", "batch").join(nodes.select("node", "first_ref"), "node").where("ref != first_ref")
    copies = copies.groupBy("batch").agg(F.sort_array(F.collect_list((F.col("ref") - F.col("batch")).cast("int"))).alias("copies"))
    copies = written(copies, "copies", rebalance=True)
    if (copies.agg(F.sum(F.size("copies"))).first()[0] or 0) > MAX_BROADCAST_PLACES:
        return found  # the same pairs come out, more often

    def run(batches):
        for t in batches:
            rows = []
            for batch, bucket, keys, places, combined, gone in zip(*t.columns, strict=True):
                k, flags = keys.as_buffer(), combined.as_buffer() if combined.is_valid else None
                if gone.is_valid:
                    k = np.frombuffer(k, np.uint32)
                    p, g = unpacked_places(places.as_buffer(), len(k)), gone.values.to_numpy()
                    keep = g[np.minimum(np.searchsorted(g, p), len(g) - 1)] != p
                    if flags is not None:
                        flags = np.frombuffer(flags, np.uint8)
                        keep |= flags > 0
                        flags = flags[keep].tobytes()
                    if not keep.any():
                        continue
                    k, places = k[keep].tobytes(), packed_places(p[keep])
                else:
                    k, places = k.to_pybytes(), places.as_py()
                    flags = flags and flags.to_pybytes()
                rows.append((batch.as_py(), bucket.as_py(), k, places, flags))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), *[pa.binary()] * 3))], names=names)

    return found.join(F.broadcast(copies), "batch", "left").mapInArrow(run, "batch bigint, bucket int, keys binary, places binary, combined binary")


CANDIDATES = "a bigint, b bigint, hub boolean, key bigint"


def _candidates(table: pa.Table, short_run: int) -> pa.Table:
    """Equal entries of a bucket as pairs of refs a < b: all of a short run, those with its smallest ref (the hub) of a long one or one with combined
    lists; for the lists, also the hub (a) of their key."""
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["keys"]]
    ref = np.concatenate([base + unpacked_places(x.as_buffer(), len(k)) for base, x, k in zip(table["batch"].to_pylist(), table["places"], keys, strict=True)])
    listed = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(len(k), np.uint8) for x, k in zip(table["combined"], keys, strict=True)])
    key = np.concatenate(keys)
    order = np.lexsort((ref, key))
    key, ref, listed = key[order], ref[order], listed[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (ref[1:] != ref[:-1])]))
    listed = np.maximum.reduceat(listed, new)
    key, ref = key[new], ref[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    some_listed = np.maximum.reduceat(listed, start) > 0
    size_or_long = np.where(some_listed, np.maximum(size, short_run + 1), size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(2, short_run + 1):
        at = start[size_or_long == k]
        for i in range(k):
            for j in range(i + 1, k):
                a.append(ref[at + i])
                b.append(ref[at + j])
    short = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
    long = np.repeat(size_or_long > short_run, size)
    hub, first = np.repeat(ref[start], size), np.repeat(start, size) == np.arange(len(ref))
    star = np.unique(np.stack([hub, ref], 1)[long & ~first], axis=0)
    of = start[some_listed]
    bucket = table["bucket"][0].as_py()
    n = len(short) + len(star)
    out = pa.table({
        "a": np.concatenate([short[:, 0], star[:, 0], ref[of]]), "b": pa.concat_arrays([pa.array(np.concatenate([short[:, 1], star[:, 1]])), pa.nulls(len(of), pa.int64())]),
        "hub": np.repeat([False, True], [len(short), len(star) + len(of)]), "key": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array((np.int64(bucket) << np.int64(32)) | key[of].astype(np.int64))]),
    })
    give_back()
    return out


def _spread(batches):
    """hub, refs (a combined list) to pairs of the hub with each ref, once for each batch of lists."""
    for t in batches:
        lists = [np.frombuffer(x.as_buffer(), np.int64) for x in t.column("refs")]
        hub, ref = np.repeat(t.column("hub").to_numpy(), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *lists])
        pairs = np.unique(np.stack([hub, ref], 1)[hub != ref], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.ones(len(pairs), bool))], names=["a", "b", "hub"])
    give_back()


def of_nodes(pairs: DataFrame, refs: DataFrame) -> DataFrame:
    """Pairs of refs (a, b, hub) as pairs of different nodes, each once."""
    for side in "ab":
        pairs = pairs.join(refs.select(F.col("ref").alias(side), F.col("node").alias(f"n{side}")), side)
    return pairs.where("na != nb").groupBy(F.col("na").alias("a"), F.col("nb").alias("b")).agg(F.max("hub").alias("hub"))


def _may_link(na: Column, nb: Column, num: int, den: int) -> Column:
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num)


def _near_enough(bands: Bands):
    num, den = bands.num, bands.den

    def run(batches):
        """Pairs whose sizes and dense sketches allow a link."""
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            for i, (na, nb, sa, sb) in enumerate(zip(t["na"].to_pylist(), t["nb"].to_pylist(), t["sa"], t["sb"], strict=True)):
                x, y = np.frombuffer(sa.as_buffer(), np.uint8), np.frombuffer(sb.as_buffer(), np.uint8)
                small = min(len(x), len(y))
                keep[i] = int(np.bitwise_count(fold(x, small) ^ fold(y, small)).sum()) * (den + num) <= (na + nb) * (den - num)
            yield t.select(["a", "b"]).filter(pa.array(keep))

    return run


def filtered(pairs: DataFrame, nodes: DataFrame, bands: Bands) -> DataFrame:
    """The pairs a, b that sizes and dense sketches allow."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    pairs = pairs.where(_may_link(F.col("na"), F.col("nb"), bands.num, bands.den))
    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near_enough(bands), "a bigint, b bigint")


def shingles_of(needed: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, id_col: str, text_col: str, shared: frozenset[int], hash_bits: int = 64) -> DataFrame:
    """node, shingles (sorted) of the nodes in ``needed``, from the texts of a document of each."""
    needed = written(needed.select("node").distinct().join(nodes, "node").select("node", "first_key"), "needed", rebalance=True)
    keys = needed.select(F.col("first_key").alias("key"))
    if needed.count() <= MAX_BROADCAST_IDS:
        keys = F.broadcast(keys)
    texts = docs.select(_key(F.col(id_col).cast("string"), F.xxhash64(text_col)).alias("key"), F.col(text_col).alias("text")).join(keys, "key", "left_semi")

    def run(batches):
        for batch in batches:
            for b in slices(batch, 1, SLICE_BYTES):
                sets, bounds = shingle_sets(b.column(1), shingle)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node_ids(sets, bounds, shared, hash_bits)[0]), lists], names=["node", "shingles"])
        give_back()

    return written(texts.select("key", "text").mapInArrow(run, "node bigint, shingles array<bigint>"), "sets").dropDuplicates(["node"])


def verified(pairs: DataFrame, bands: Bands, read_sets) -> DataFrame:
    """The pairs that link, by their shingle sets, which ``read_sets`` gives for a table of nodes."""
    sets = read_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.select("a", "b", (F.size("sa") + F.size("sb")).cast("long").alias("total"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))
    return both.where(F.col("common") * bands.den >= (F.col("total") - F.col("common")) * bands.num).select("a", "b")


def _key(id_: Column, text_hash: Column) -> Column:
    return F.struct(id_.alias("id"), text_hash.alias("h"))


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node that links reach) for all nodes with links. Each round takes the smallest root among
    neighbours and follows roots to their roots, and is written; it ends when no root changes."""
    both = written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")), "links", rebalance=True)
    roots = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root"))
    roots = written(roots, "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = written(step.join(jump, "root", "left").select("node", "old", F.coalesce("next", "root").alias("root")), "roots")
        changed = step.where(F.col("old") != F.col("root")).limit(1).count()
        roots = step.select("node", "root")
        if not changed:
            return roots


def _allowed(bands: Bands, nodes: np.ndarray, roots: np.ndarray, n: np.ndarray, outside: np.ndarray, side: np.ndarray, wide: list[bytes]):
    """For each node of side 0: its place, the places on side 1 that lie in other components and that sizes and wide sketches allow,
    and how far those are."""
    num, den = bands.num, bands.den
    small = min(map(len, wide))
    bits = np.stack([fold(np.frombuffer(s, np.uint8), small) for s in wide]).view(np.uint64)
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        # Two nodes outside the largest component stand on both sides of two tasks: one of them compares the pair.
        ok = (roots[right] != roots[i]) & (np.minimum(n[right], n[i]) * den >= np.maximum(n[right], n[i]) * num) & (~outside[right] | (nodes[right] > nodes[i]))
        j = right[ok]
        if len(j):
            d = np.bitwise_count(bits[j] ^ bits[i]).sum(1)
            near = d * (den + num) <= (n[j] + n[i]) * (den - num)
            if near.any():
                yield i, j[near], d[near] / (n[j[near]] + n[i])


def _columns(table: pa.Table) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in ("node", "root", "n", "outside", "side")]


def _may_still_link(bands: Bands):
    def run(table: pa.Table) -> pa.Table:
        """hub, node of the nodes in two blocks that the wide sketches let link with one of another component."""
        node, root, n, outside, side = _columns(table)
        found = np.zeros(len(node), bool)
        for i, j, _ in _allowed(bands, node, root, n, outside, side, [w.as_buffer() for w in table["wide"]]):
            found[i] = found[j] = True
        kept = np.unique(node[found])
        give_back()
        return pa.table({"hub": pa.array(np.full(len(kept), table["hub"][0].as_py()), pa.int64()), "node": kept})

    return run


def _joining_links(bands: Bands):
    num, den = bands.num, bands.den

    def run(table: pa.Table) -> pa.Table:
        """The links between two blocks that join components, by shingle sets, nearest pairs first."""
        node, root, n, outside, side = _columns(table)
        lists = table["shingles"].combine_chunks()
        flat, at = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(n)])
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        out = []
        for i, j, far in _allowed(bands, node, root, n, outside, side, dense_sketches(flat, at, 8)):
            own = flat[at[i] : at[i + 1]]
            for k in j[np.argsort(far, kind="stable")].tolist():
                x, y = find(int(root[i])), find(int(root[k]))
                if x == y:
                    continue
                common = len(np.intersect1d(own, flat[at[k] : at[k + 1]], assume_unique=True))
                if common * den >= (int(n[i] + n[k]) - common) * num:
                    up[x] = y
                    out.append((int(node[i]), int(node[k])))
        give_back()
        return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    return run


def in_blocks(family: DataFrame, bands: Bands, payload: DataFrame, compare, schema: str) -> DataFrame:
    """``compare`` over blocks of the families (hub, node, root, n) that hold several components: nodes outside the largest
    component (side 0) with all nodes (side 1). ``payload`` has a column for each node, such as its sketch, and may
    hold a node more than once."""
    of_root = family.groupBy("hub", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    mixed = of_root.groupBy("hub").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("s").alias("all"), (F.sum("s") - F.max_by("s", F.struct("c", "root"))).alias("rest"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.where("roots > 1").select("hub", "main", blocks("rest").alias("lefts"), blocks("all").alias("rights"))
    d = written(family.join(mixed, "hub").withColumn("outside", F.col("root") != F.col("main")), "mixed", rebalance=True)
    ids = d.select("node").distinct()
    if ids.count() <= MAX_BROADCAST_IDS:
        payload = payload.join(F.broadcast(ids), "node", "left_semi")
    place = lambda name: F.pmod(F.xxhash64("node"), F.col(name)).cast("int")
    left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda k: F.struct(place("lefts").alias("i"), k.alias("j"), F.lit(0).alias("side")))
    right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda k: F.struct(k.alias("i"), place("rights").alias("j"), F.lit(1).alias("side")))
    d = d.select("hub", "node", "root", "n", "outside", F.explode(F.when(F.col("outside"), F.concat(left, right)).otherwise(right)).alias("at"))
    d = d.join(payload.dropDuplicates(["node"]), "node").select("hub", "at.*", *[c for c in d.columns if c not in ("hub", "at")], *[c for c in payload.columns if c != "node"])
    return d.groupBy("hub", "i", "j").applyInArrow(compare, schema)


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN, id_type: str = "bigint", short_run: int = SHORT_RUN, hash_bits: int = 64, combine_from: int = COMBINE_FROM) -> DataFrame:
    """A row per document row: id, text_hash, node, n_shingles, component_id (smallest id that links reach)."""
    spark, bands = docs.sparkSession, Bands(num, den)
    rows = docs.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * 250 // BUCKET_ENTRIES))
    shared: frozenset[int] = frozenset()
    while True:
        both = written(sketched(docs, bands, buckets, shingle, id_col, text_col, shared, hash_bits, combine_from), "sketches")
        own = both.where("kind = 0").select("id", "text_hash", "node", "second", "n", "sketch", "wide", "ref", "batch")
        nodes = own.where("n > 0").groupBy("node").agg(
            F.min(F.col("id").cast(id_type)).alias("first_id"), F.min(_key(F.col("id"), F.col("text_hash"))).alias("first_key"), F.first("n").alias("n"), F.min("ref").alias("first_ref"),
            F.first("sketch").alias("sketch"), (F.min("second") != F.max("second")).alias("shared"),
        )
        nodes = written(nodes, "nodes")
        # Two sets with one 64-bit hash: about one such node in 10 ** 9.5 texts. The work begins anew with other ids for those.
        if not (found := nodes.where("shared").select("node").collect()):
            break
        shared |= {r["node"] for r in found}
    read_sets = lambda needed: shingles_of(needed, nodes, docs, shingle, id_col, text_col, shared, hash_bits)
    found = without_copies(both.where("kind = 1"), own, nodes).groupBy("bucket").applyInArrow(lambda t: _candidates(t, short_run), CANDIDATES)
    found = written(found, "found")
    lists = both.where("kind = 2").select("key", "refs").join(found.where("key is not null").select("key", F.col("a").alias("hub")), "key")
    every = found.where("key is null").select("a", "b", "hub").unionByName(lists.select("hub", "refs").mapInArrow(_spread, "a bigint, b bigint, hub boolean"))
    refs = own.where("ref is not null").select("ref", "node")
    found = written(of_nodes(every.groupBy("a", "b").agg(F.max("hub").alias("hub")), refs), "candidates", rebalance=True)
    pairs = written(filtered(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes, bands), "pairs", rebalance=True)
    roots = components(written(verified(pairs, bands, read_sets), "links", rebalance=True))
    stars = found.where("hub").select(F.col("a").alias("hub"), F.col("b").alias("node"))
    if stars.limit(1).count():
        placed = nodes.select("node", "n").join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
        family = written(stars.unionByName(stars.select("hub", F.col("hub").alias("node")).distinct()).join(placed, "node"), "family", rebalance=True)
        open_ = written(in_blocks(family, bands, own.where("ref is not null").select("node", "wide"), _may_still_link(bands), "hub bigint, node bigint").distinct(), "open", rebalance=True)
        if open_.limit(1).count():
            joined = in_blocks(family.join(open_, ["hub", "node"]), bands, read_sets(open_), _joining_links(bands), "a bigint, b bigint")
            joined = written(joined, "links", rebalance=True)
            # Links between components, as links between their roots.
            for side in "ab":
                joined = joined.join(placed.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side)
            above = components(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
            moved = placed.join(above.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
            roots = written(moved.select("node", F.coalesce("above", "root").alias("root")), "roots")
    linked = roots.join(nodes.select("node", "first_id"), "node").select("node", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = nodes.select("node", "first_id").join(linked.select("node", "root"), "node", "left").join(least, "root", "left")
    of_node = of_node.select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    out = own.drop("sketch", "wide", "second", "ref", "batch").join(of_node, "node", "left")
    id_ = F.col("id").cast(id_type)
    return out.select(id_.alias("id"), "text_hash", "node", F.col("n").alias("n_shingles"), F.coalesce("component_id", id_).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its own columns, one document of each group: the one with the smallest id (of rows with equal id, the
    one with the smallest text hash). Documents without shingles stay."""
    found = written(cluster(docs, id_col, text_col, **options).where("n_shingles > 0"), "clusters")
    id_ = F.col("id").cast("string")
    chosen = found.groupBy("component_id").agg(F.min_by(F.struct(id_.alias("id"), F.col("text_hash").alias("h")), F.struct("id", "text_hash")).alias("chosen"))
    (key,) = fresh(docs, "_key")
    keyed = docs.withColumn(key, _key(F.col(id_col).cast("string"), F.xxhash64(text_col)))
    gone = found.select("component_id", F.struct(id_.alias("id"), F.col("text_hash").alias("h")).alias("k")).join(chosen, "component_id").where(~F.col("k").eqNullSafe(F.col("chosen"))).select("k").distinct()
    gone = written(gone, "gone")
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = keyed.join(gone, keyed[key].eqNullSafe(gone["k"]), "left_anti")
    twice = found.groupBy("id", "text_hash").count().where("count > 1").limit(1).count()
    if twice:  # rows with equal id and text are left: one of them stays
        kept = kept.dropDuplicates([key])
    return kept.drop(key)
