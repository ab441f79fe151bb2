"""Token counts by rank-synchronous array merging: byte-level BPE over ragged NumPy arrays, counting what survives.

Method: a text is cut before each space that follows a character other than white space; the tokenizer's own pattern
never matches across such a place, so equal cuts have equal counts and each distinct one is counted once. Distinct
cuts are split into pre-tokens by the pattern; all pre-tokens of a batch are held as one array of symbols with
ragged bounds. In each round every sequence finds its lowest-rank pair and all sequences merge theirs at once; a
sequence without a mergeable pair leaves, its surviving symbols being its token count.

Defined results: null texts count as empty, with 0 bytes and 0 tokens; special strings inside texts are one token, as
the tokenizers library has it; rows are counted one by one whatever their ids; extra columns are left out; very long texts and pre-tokens are
merged whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import plain_texts, slices

#: Fixed value: the pattern of the tokenizer's byte-level pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_CUTS = 600_000
NONE = np.int32(2**31 - 1)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the
    next free one from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


class Merger:
    """Counts the symbols that are left of byte strings when all merges are done."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.first = np.array([vocabulary[s] for s in byte_symbols().values()], np.int64)
        self.base = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.base + vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.special = tuple(t["content"] for t in spec["added_tokens"])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = sizes.copy()
        sym = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), sizes)
        rank = np.full(len(sym), NONE)
        if len(sym):
            rank[:-1] = np.where(seq[1:] == seq[:-1], self._rank(sym[:-1], sym[1:]), NONE)
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            n = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            live = best < NONE
            if not live.all():  # finished sequences leave
                out[seq[starts[~live]]] = n[~live]
                stay = np.repeat(live, n)
                sym, seq, rank, n, best = sym[stay], seq[stay], rank[stay], n[live], best[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, n))
            # Places next to each other share a symbol (aaa): of each run every second one merges, from the left.
            new = np.concatenate([[True], np.diff(at) != 1])
            run = np.flatnonzero(new)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            at = place[at]
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            for p in (at, at[at > 0] - 1):  # only the pairs beside a merge change
                right = np.minimum(p + 1, len(sym) - 1)
                rank[p] = np.where((seq[right] == seq[p]) & (right > p), self._rank(sym[p], sym[right]), NONE)
        return out


class TokenCounter:
    def __init__(self, path: str, max_cuts: int = MAX_CUTS):
        self.merger, self.max_cuts = Merger(path), max_cuts
        self.pattern, self.known = regex.compile(PATTERN), {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.merger.special)) + ")") if self.merger.special else None

    def _learn(self, cuts: list[str]) -> None:
        code: dict[str, int] = {}
        own, where = [], []
        extra = np.zeros(len(cuts), np.int64)
        for i, cut in enumerate(cuts):
            parts = [cut]
            if self.split and any(s in cut for s in self.merger.special):
                parts = self.split.split(cut)
                extra[i], parts = len(parts) // 2, parts[::2]
            for part in parts:
                found = self.pattern.findall(part)
                own += [code.setdefault(t, len(code)) for t in found]
                where += [i] * len(found)
        n = self.merger.counts([t.encode() for t in code])
        total = extra + np.bincount(np.asarray(where, np.int64), n[np.asarray(own, np.int64)] if own else None, len(cuts)).astype(np.int64)
        self.known.update(zip(cuts, total.tolist(), strict=True))

    def _of(self, cuts: list[str]) -> np.ndarray:
        if len(self.known) + len(cuts) > self.max_cuts:
            self.known = {}
        if new := list(dict.fromkeys(c for c in cuts if c not in self.known)):
            self._learn(new)
        return np.fromiter((self.known[c] for c in cuts), np.int64, len(cuts))

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = plain_texts(texts)
        out = np.zeros(len(texts), np.int64)
        # A space after white space doesn't begin a cut of its own; such texts, and those with special strings that hold a space, are one cut.
        whole = pc.match_substring_regex(texts, r"[\s\v\x1c-\x1f\x{85}\p{Z}] ")
        for s in self.merger.special:
            if " " in s:
                whole = pc.or_(whole, pc.match_substring(texts, s))
        whole = whole.to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(whole):
            out[i] = self._whole(texts[int(i)].as_py())
        rows = np.flatnonzero(~whole)
        split = pc.split_pattern(texts.take(pa.array(rows)), " ")
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = pc.dictionary_encode(split.flatten())
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        heads = codes[bounds[:-1]]  # a text's first cut has no space before it
        n = self._of([f" {w}" for w in words])[codes] if words else np.zeros(0, np.int64)
        n[bounds[:-1]] = self._of([words[c] for c in heads])
        out[rows] = np.add.reduceat(n, bounds[:-1]) if len(rows) else 0
        return out

    def _whole(self, text: str) -> int:
        cuts = regex.findall(r"\s*\S+|\s+$", text)
        return int(self._of(cuts).sum())


_counters: dict[str, TokenCounter] = {}


def token_counter(path: str) -> TokenCounter:
    """One counter for each Python worker and vocabulary: the next task of the worker finds its cuts known."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id (as a string), n_bytes, n_tokens."""

    def run(batches):
        counter = token_counter(tokenizer_path)
        for batch in batches:
            for b in slices(batch, 1):
                size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(counter.count(b.column(1)))], names=["id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id string, n_bytes bigint, n_tokens bigint")
