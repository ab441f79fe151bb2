"""Toxicity: a bag-of-words logistic regression that is penalised when swapping identity terms changes its score.

Method: features of a text are its words and their beginnings of four to six letters (present or not), so that stems
with many endings are learned. On a bounded sample of labelled documents (``max_per_label`` each, smallest hashes
first), those in ``min_df`` documents or more are kept whose document frequency differs between the labels by at least
``min_z`` standard errors, or which only toxic documents hold, at whatever sample size; and so are those of identity terms.
The l2 penalty, not the choice, deals with chance among rare ones. The weights minimise the balanced log loss, plus ``l2`` |w|^2, plus ``fairness`` times the
mean squared change of the logit over counterfactuals: every labelled sentence with an identity term, the term
swapped for each other one of its group and for none. So neutral mentions of a group don't raise a score. The model tells how many swaps there were and the penalty with and without it: where no
labelled text holds a term, there are no swaps and it is a plain regression.
The fit runs on the driver over that sample only; scoring is one pass over the texts without a shuffle.

Defined results: null and empty texts score as a text without features (the bias alone); words are cut at anything but
letters, ASCII lower case; a label table with one class only gives the model of that class's prior; repeated labels of
one id count once, toxic if any says so, and of documents with one id the text with the smallest hash; null labels and ids are not learned
from; extra columns are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, written
from .memory import give_back
from .tokens import plain_texts, slices

#: Terms that name groups, by language and kind.
ENGLISH = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "african", "latino", "arab", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("woman", "man", "women", "men", "female", "male", "girl", "boy"),
    ("disabled", "deaf", "blind", "old", "young"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french"),
)
GERMAN = (("christ", "muslim", "jude", "hindu", "buddhist", "atheist", "katholik"), ("frau", "mann", "frauen", "männer", "mädchen", "junge"), ("schwul", "lesbisch", "hetero", "bisexuell"), ("deutsche", "türken", "polen", "russen", "amerikaner", "franzosen"))
FRENCH = (("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée", "catholique"), ("femme", "homme", "femmes", "hommes", "fille", "garçon"), ("gay", "lesbienne", "bisexuel", "hétéro"), ("français", "allemand", "américain", "russe", "chinois", "arabe"))
SPANISH = (("cristiano", "musulmán", "judío", "hindú", "budista", "ateo", "católico"), ("mujer", "hombre", "mujeres", "hombres", "niña", "niño"), ("gay", "lesbiana", "bisexual", "hetero"), ("español", "mexicano", "alemán", "americano", "ruso", "chino", "árabe"))
IDENTITY = (*ENGLISH, *GERMAN, *FRENCH, *SPANISH)
MAX_PER_LABEL = 4000
MIN_DF = 3
MIN_Z = 2.0
#: Bytes of text that a task scores at once.
SLICE_BYTES = 4_000_000
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    """swaps: kinds of swap that the sample allows; mentions: texts that they were seen in; penalty and unpenalised: the mean squared change of the
    logit under swaps, of this model and of one fitted without regard to it (None unless asked for)."""

    bias: float
    weights: dict[str, float]
    swaps: int = 0
    mentions: float = 0.0
    penalty: float = 0.0
    unpenalised: float | None = None


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k)]


def feature_sets(texts: pa.Array, known: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Distinct (document, feature) pairs of a batch, and the features (of those known, where given): white-space tokens
    are coded first, so that each distinct token is cut into words once."""
    tokens = pc.ascii_split_whitespace(pc.ascii_lower(plain_texts(texts)))
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(tokens.flatten())
    code: dict[str, int] = {}
    pieces, sizes = [], []
    for token in coded.dictionary.to_pylist():
        found = [f for w in LETTERS.findall(token) for f in features_of(w) if known is None or f in known]
        pieces += [code.setdefault(w, len(code)) for w in found]
        sizes.append(len(found))
    docs, words = ragged(np.repeat(np.arange(len(texts)), lengths), coded.indices.to_numpy(), np.asarray(pieces, np.int64), np.asarray(sizes, np.int64))
    pairs = np.unique(docs * max(1, len(code)) + words)
    return pairs // max(1, len(code)), pairs % max(1, len(code)), list(code)


def ragged(owner: np.ndarray, codes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces each code by its run of ``flat``; returns owner and value of every element."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = sizes[codes]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    at = np.repeat(starts[codes] - first, n) + np.arange(n.sum())
    return np.repeat(owner, n), flat[at]


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_label: int = MAX_PER_LABEL) -> DataFrame:
    """label, text of at most ``max_per_label`` documents of each label. ``usable`` is a condition on the id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("label"))
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    some = known.where("label = 1").orderBy(*order).limit(max_per_label).unionByName(known.where("label = 0").orderBy(*order).limit(max_per_label))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(some), "id")  # 2 * max_per_label ids at most
    # One row of each id, however often it stands in the table.
    return found.groupBy("id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")


def _counts(batches):
    """label 1's documents and all documents with each feature, batch by batch."""
    for b in batches:
        d, w, words = feature_sets(b.column("text"))
        label = b.column("label").to_numpy()
        c, c1 = np.bincount(w, minlength=len(words)), np.bincount(w, label[d], len(words)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(c1), pa.array(c)], names=["word", "c1", "c"])


def fit(sample: DataFrame, identity=IDENTITY, min_z: float = MIN_Z, l2: float = 1e-4, fairness: float = 10.0, steps: int = 300, min_df: int = MIN_DF, compare: bool = False) -> ToxicityModel:
    """``sample``: label (0 or 1), text; bounded by the caller, see labelled_sample(). ``compare``: fit without the penalty as well, to tell what it did."""
    sets = written(sample.select("label", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("key")).repartition(8), "toxicity")
    totals = {r["label"]: r["n"] for r in sets.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(float(np.log((n1 + 1) / (n0 + 1))), {})
    df = sets.mapInArrow(_counts, "word string, c1 bigint, c bigint").groupBy("word").agg(F.sum("c1").alias("c1"), F.sum("c").alias("c"))
    p = F.col("c") / (n1 + n0)
    z = F.abs(F.col("c1") / n1 - (F.col("c") - F.col("c1")) / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    terms = [f for group in identity for t in group for f in features_of(t)]
    told = (F.col("c") >= min_df) & ((z >= min_z) | (F.col("c1") == F.col("c")))
    vocabulary = sorted(df.where(told | F.col("word").isin(terms)).select("word").toArrow().column(0).to_pylist())
    code = {w: i for i, w in enumerate(vocabulary)}

    def coded(batches):
        for b in batches:
            d, w, words = feature_sets(b.column("text"), code)
            own = np.array([code[x] for x in words] or [0], np.int32)[w]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(b.num_rows + 1)), pa.int32()), pa.array(own, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("key"), lists], names=["label", "key", "codes"])

    rows = sets.mapInArrow(coded, "label int, key bigint, codes array<int>").toArrow()
    rows = rows.sort_by([("label", "ascending"), ("key", "ascending")]).combine_chunks()  # whatever order the tasks end in, the sums are the same
    codes = rows.column("codes").combine_chunks()
    y = rows.column("label").to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(y)), pc.list_value_length(codes).to_numpy(zero_copy_only=False))
    col = codes.flatten().to_numpy().astype(np.int64)
    model = _train(row, col, y, vocabulary, identity, l2, fairness, steps)
    return replace(model, unpenalised=_train(row, col, y, vocabulary, identity, l2, 0.0, steps).penalty) if compare else model


def counterfactuals(counts: np.ndarray, code: dict[str, int], identity=IDENTITY) -> list[tuple[list[int], list[int], float]]:
    """Features lost, features won and number of documents: each identity term swapped for each known other of its group,
    and for none. ``counts``: documents by feature."""
    out = []
    for group in identity:
        own = {t: [code[f] for f in features_of(t) if f in code] for t in group if t in code}
        for a, mine in own.items():
            out += [(mine, own.get(b, []), float(counts[code[a]])) for b in [None, *own] if counts[code[a]] and b != a]
    return out


def _train(row, col, y, vocabulary, identity, l2, fairness, steps) -> ToxicityModel:
    """``row``, ``col``: the (document, feature) pairs; ``y``: the labels."""
    n, m = len(y), len(vocabulary)
    swaps = counterfactuals(np.bincount(col, minlength=m), {w: i for i, w in enumerate(vocabulary)}, identity)
    used = np.array(sorted({f for lost, won, _ in swaps for f in lost + won}), np.int64)
    at = {f: i for i, f in enumerate(used.tolist())}
    delta, mass = np.zeros((len(swaps), len(used))), np.array([c for *_, c in swaps])
    for k, (lost, won, _) in enumerate(swaps):
        delta[k, [at[f] for f in lost]] -= 1
        delta[k, [at[f] for f in won]] += 1
    mass /= max(1.0, mass.sum())
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, first, second = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, steps + 1):  # Adam over the whole sample
        z = np.bincount(row, w[col], n) + w[-1]
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(col, r[row], m) + 2 * l2 * w[:-1], r.sum())
        g[used] += 2 * fairness * delta.T @ (mass * (delta @ w[used]))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = {word: float(c) for word, c in zip(vocabulary, w[:-1], strict=True)}
    mentions = sum({tuple(lost): c for lost, _, c in swaps}.values())
    return ToxicityModel(float(w[-1]), weights, len(swaps), mentions, float(mass @ (delta @ w[used]) ** 2) if len(swaps) else 0.0)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` plus score and predicted; with ``keep_text=False``, without the text."""
    score_col, predicted = fresh(docs, "score", "predicted")
    at = docs.columns.index(text_col)
    fields = [f for i, f in enumerate(docs.schema.fields) if keep_text or i != at]
    schema = T.StructType([*fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    bias, weights = model.bias, model.weights

    def run(batches):
        for b in (x for batch in batches for x in slices(batch, at, SLICE_BYTES)):
            d, w, words = feature_sets(b.column(at), weights)
            known = np.array([weights[x] for x in words] or [0.0])
            z = bias + np.bincount(d, known[w], b.num_rows) if len(d) else np.full(b.num_rows, bias)
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            own = [c for i, c in enumerate(b.columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)
        give_back()

    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with its own columns, without documents that score ``threshold`` or more."""
    at = docs.columns.index(text_col)
    bias, weights = model.bias, model.weights

    def run(batches):
        for b in (x for batch in batches for x in slices(batch, at, SLICE_BYTES)):
            d, w, words = feature_sets(b.column(at), weights)
            known = np.array([weights[x] for x in words] or [0.0])
            z = bias + np.bincount(d, known[w], b.num_rows) if len(d) else np.full(b.num_rows, bias)
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))) < threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))
