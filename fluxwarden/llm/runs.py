"""Periodic runs of words: every maximal stretch with a smallest period q that is at least ``MIN_LENGTH`` words and ``MIN_PERIODS`` periods long.

Every run has a Lyndon root under one of two opposite orders of the words: the longest Lyndon word from each of its places (the run's first word
aside) is as long as the period. Both Lyndon arrays come from the first phase of Baier's suffix sorting, which groups suffixes by their longest Lyndon
prefix: places start in a group for each word; groups are taken from the greatest down, and each stretch of equal neighbouring blocks of the group is
appended to the block before it if that one is smaller, which moves to a new group just above its old one (those with more copies higher). A block's
length when its group is taken is the Lyndon array's value there. Roots that are followed by their own copy are extended to runs by the longest common
extension to both sides, which is found by comparing ever longer pieces.

Only stretches of words in which each word lies in an ``ANCHOR``-gram that occurs twice in the text are grouped: a run of 24 words and three periods
consists of such words (for each of them, an 8-gram of the run holds it and recurs a period before or after), and the word next to a run that isn't
one can't extend it. Hashes of grams may clash, which only makes a stretch longer than needed.

Odd input: a null text has no words and no runs. Repeated rows and ids are answered row by row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import give_back
from .shingles import gram_hashes, mix
from .tokens import plain_texts, slices

MIN_LENGTH, MIN_PERIODS = 24, 3
#: Words of the grams that must recur. It may not exceed a third of MIN_LENGTH.
ANCHOR = 8
SLICE_BYTES = 4_000_000
RUNS = "id string, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def lyndon_array(s: list[int]) -> list[int]:
    """Length of the longest Lyndon word from each place, by grouping."""
    n, ranks = len(s), sorted(set(s))
    first = {c: k for k, c in enumerate(ranks)}
    group = [first[c] for c in s]  # of each block, by its first place
    members: list[list[int]] = [[] for _ in ranks]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(ranks)
    above, below = [*range(1, len(ranks)), -1], [*range(-1, len(ranks) - 1)]
    before = list(range(-1, n))  # first place of the block before the one that begins here
    out = [0] * n
    g = len(ranks) - 1
    while g >= 0:
        m, longer = size[g], {}
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in own:
            out[i] = m
        for i in own:
            p = before[i]
            if p >= 0 and group[p] == g:
                continue  # not the first of its stretch
            stop, copies = i + m, 1
            while stop < n and group[stop] == g:
                stop, copies = stop + m, copies + 1
            if p < 0 or out[p]:  # nothing stands before, or something greater
                continue
            longer.setdefault((group[p], copies), []).append(p)
            if stop < n:
                before[stop] = p
        for i in own:
            group[i] = -1
        for (old, copies), moved in sorted(longer.items(), reverse=True):
            new = len(size)  # just above its old group, below those with more copies, which were put there first
            size.append(size[old] + copies * m)
            members.append(moved)
            for p in moved:
                group[p] = new
            up = above[old]
            above.append(up)
            below.append(old)
            above[old] = new
            if up >= 0:
                below[up] = new
        g = below[g]
    return out


def extension(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two arrays have in common at their beginning."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def runs_of(s: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start, then period. ``min_periods`` is 3 at least."""
    found, n = set(), len(s)
    for order in (s, -s):
        size = np.array(lyndon_array(order.tolist()), np.int64)
        at = np.arange(n)
        after = at + size
        again = after < n
        again[again] = size[after[again]] == size[again]  # three periods hold two roots besides one at the run's beginning
        again[again] = s[after[again]] == s[again]
        for i in np.flatnonzero(again).tolist():
            p = int(size[i])
            root = s[i : i + p]
            if i >= p and np.array_equal(s[i - p : i], root) or not np.array_equal(root, s[i + p : i + 2 * p]):
                continue  # of the copies in a row the first is enough
            stop = i + p + extension(s[i:], s[i + p :])
            start = i - extension(s[:i][::-1], s[: i + p][::-1])
            if stop - start >= max(min_length, min_periods * p):
                found.add((start, stop - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, bounds: np.ndarray, gram: int = ANCHOR, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(text, first word, word after the last), counted over all texts, of the stretches whose words lie in grams that recur in their text."""
    if len(codes) < gram:
        return []
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h = gram_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), gram)
    inside = owner[: len(h)] == owner[gram - 1 :]
    h = mix(h + mix(owner[: len(h)].astype(np.uint64) + np.uint64(7)))
    at = np.flatnonzero(inside)
    at = at[np.argsort(h[at], kind="stable")]
    same = h[at][1:] == h[at][:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + gram, -1)
    covered = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    first, stop = edge[::2], edge[1::2]
    out = []
    for a, z in zip(first.tolist(), stop.tolist(), strict=True):
        cuts = [a, *bounds[np.searchsorted(bounds, a, "right") : np.searchsorted(bounds, z, "left")].tolist(), z]  # texts that touch
        out += [(int(owner[x]), x, y) for x, y in zip(cuts, cuts[1:], strict=False) if y - x >= min_length]
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """A row per document: id (as a string), n_words, its runs by start, then period, and the text without the words that a run holds after its first
    period, the others joined by single spaces. Words are runs of anything but ASCII white space."""
    if min_length < 3 * ANCHOR or min_periods < 3:
        raise ValueError(f"runs of less than {3 * ANCHOR} words or three periods aren't looked for")

    def run(batches):
        for batch in batches:
            for b in slices(batch, 1, SLICE_BYTES):
                yield of_batch(b)
        give_back()

    def of_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        split = pc.ascii_split_whitespace(plain_texts(b.column(1)))
        flat, owner = split.flatten(), pc.list_parent_indices(split)
        real = pc.not_equal(flat, "")  # a text that begins or ends with white space gives empty words there
        flat, owner = flat.filter(real), owner.filter(real).to_numpy(zero_copy_only=False)
        bounds = np.searchsorted(owner, np.arange(b.num_rows + 1))
        codes = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(b.num_rows)]
        change = np.zeros(len(codes) + 1, np.int64)
        for i, a, z in stretches(codes, bounds):
            for start, length, period in runs_of(codes[a:z], min_length, min_periods):
                runs[i].append((a + start - int(bounds[i]), length, period))
                change[a + start + period] += 1
                change[a + start + length] -= 1
        kept = np.cumsum(change[:-1]) <= 0
        n = np.add.reduceat(np.append(kept, False).astype(np.int64), bounds[:-1])
        n[np.diff(bounds) == 0] = 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat.filter(pa.array(kept)).cast(pa.string()))
        rows = [[{"start": s, "length": m, "period": p} for s, m, p in x] for x in runs]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), pa.array(rows, kind), pc.binary_join(lists, " ")], names=["id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, RUNS)
