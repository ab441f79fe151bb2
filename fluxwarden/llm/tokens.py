"""Token ids of whole texts, for tokenizers that drop white space (the packing and token-file operators use it).

Such a tokenizer encodes a text as the ids of its pre-tokens one after another, and these never reach over white space. So
each distinct word of a batch is taken apart into letters and the punctuation after them, each distinct such part is encoded once by the
tokenizers library and remembered, and a text's ids are gathered by NumPy. Words of other shapes are cut into pre-tokens by the tokenizer's
own pattern, and those that aren't plain Latin are given to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8_000_000
#: Parts that are remembered; when there are more, those of the last batch stay.
MAX_PARTS = 1_000_000
#: Words of these characters (printable ASCII and Latin letters but the one whose lower case is two characters) are cut by Arrow as
#: the tokenizer's own pattern cuts them; others go to the library whole.
SIMPLE = r"^[!-~\x{A1}-\x{12F}\x{131}-\x{24F}]+$"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed value: the tokenizer's pattern of pre-tokens.
PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"


def plain_texts(texts: pa.Array) -> pa.Array:
    """The texts with null as empty, in an array of its own: Arrow's ``ascii_lower`` gives wrong bytes for a slice of an
    array that doesn't begin at its start."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(texts.cast(pa.large_string()), "")


class WordEncoder:
    """``encode`` gives a batch's ids and where each text's begin. Memory is bounded by ``max_parts`` remembered parts of words, besides
    those of a batch."""

    def __init__(self, path: str, max_parts: int = MAX_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(names.values()) + 2, bool)  # ids that end a pre-token
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.max_parts = max_parts
        self.known, self.ids, self.starts = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pre-tokens: joined by spaces they stay pre-tokens, and each ends with an id that ends a pre-token."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), 5_000):
            part = pieces[at : at + 5_000]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[found])
            found, n = (found, np.diff(last, prepend=-1)) if len(last) == len(part) else self._whole(part)
            ids.append(found)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, parts: pa.Array) -> np.ndarray:
        """Appends new parts and says where each stands: letters as they are, others cut by the tokenizer's pattern or given to
        the library whole."""
        simple = pc.and_(pc.match_substring_regex(parts, SIMPLE), pc.invert(pc.match_substring(parts, "<|")))
        one = pc.and_(simple, pc.match_substring_regex(parts, r"^(\pL+|[[:punct:]]+)$"))
        mixed = pc.and_(simple, pc.invert(one))
        ids, sizes = self._pieces(pc.utf8_lower(parts.filter(one)).to_pylist())
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(parts.filter(mixed)), PIECE, r" \1 "))
        coded = pc.dictionary_encode(cut.flatten())
        real = pc.not_equal(coded.dictionary, "")
        piece_ids, piece_sizes = self._pieces(coded.dictionary.filter(real).to_pylist())
        n = np.zeros(len(real), np.int64)
        n[real.to_numpy(zero_copy_only=False)] = piece_sizes
        codes = coded.indices.to_numpy() if len(coded) else np.zeros(0, np.int64)
        owner = pc.list_parent_indices(cut).to_numpy(zero_copy_only=False)
        ids2, sizes2 = piece_ids[_runs((np.cumsum(n) - n)[codes], n[codes])], np.bincount(owner, n[codes], len(cut)).astype(np.int64)
        ids3, sizes3 = self._whole(parts.filter(pc.invert(simple)).to_pylist())
        order = np.concatenate([np.flatnonzero(k.to_numpy(zero_copy_only=False)) for k in (one, mixed, pc.invert(simple))])
        places = np.empty(len(parts), np.int64)
        places[order] = len(self.known) + np.arange(len(parts))
        self.known = pa.concat_arrays([self.known, parts.take(pa.array(order))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([sizes, sizes2, sizes3]))])
        self.ids = np.concatenate([self.ids, ids, ids2, ids3])
        return places

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where each part stands among the known ones; new parts are learned first, and old ones forgotten if there are too many."""
        found = pc.index_in(parts, value_set=self.known)
        new = pc.is_null(found)
        places = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        if found.null_count:
            old = pc.invert(new).to_numpy(zero_copy_only=False)
            if len(self.known) + found.null_count > self.max_parts:
                keep = places[old]
                n = np.diff(self.starts)[keep]
                self.ids, self.known = self.ids[_runs(self.starts[keep], n)], self.known.take(pa.array(keep))
                self.starts, places[old] = np.concatenate([[0], np.cumsum(n)]), np.arange(len(keep))
            places[~old] = self._learn(parts.filter(new))
        return places

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each distinct word of a batch, and their bounds."""
        stem = pc.ascii_rtrim(words, characters=PUNCTUATION)
        split = pc.and_(pc.match_substring_regex(stem, r"^\pL+$"), pc.match_substring_regex(stem, SIMPLE))
        stem = pc.if_else(split, stem, words)
        after = pc.subtract(pc.binary_length(words), pc.binary_length(stem)).to_numpy()
        tail_at = np.flatnonzero(after)
        tails = [pc.utf8_slice_codeunits(words.take(pa.array(tail_at[after[tail_at] == k])), -int(k)) for k in np.unique(after[tail_at])]
        tail_at = np.concatenate([tail_at[:0], *[tail_at[after[tail_at] == k] for k in np.unique(after[tail_at])]])
        coded = pc.dictionary_encode(pa.concat_arrays([stem, *tails]))
        at = self._places(coded.dictionary)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        both = np.full((len(words), 2), -1, np.int64)
        both[:, 0], both[tail_at, 1] = at[: len(words)], at[len(words) :]
        both = both.ravel()
        n = np.where(both >= 0, self.starts[both + 1] - self.starts[both], 0)
        return self.ids[_runs(self.starts[both], n)], np.concatenate([[0], np.cumsum(n.reshape(-1, 2).sum(1))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]]; null texts have none."""
        texts = plain_texts(texts)
        # Fewer distinct words; a special string must keep its case to be told from others.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        coded = pc.dictionary_encode(split.flatten())
        ids, starts = self._words(coded.dictionary)
        at = coded.indices.to_numpy()
        size = np.diff(starts)[at]
        return ids[_runs(starts[at], size)], np.concatenate([[0], np.cumsum(size)])[bounds]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, then the same for the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and tokenizer: the next task of the worker finds its words known."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, text_at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, a row at least."""
    n = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(n, dtype=np.int64), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop
