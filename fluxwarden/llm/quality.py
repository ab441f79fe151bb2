"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Method: each rule looks at a few counts of the text and votes 1 (good), 0 (bad) or abstains. Rules overlap: symbols are held against
words and against characters, repetition is seen in windows and in lines, so that a lone bad vote of a weak rule can be outvoted. The table of vote
patterns (at most 3 ** number of rules rows, whatever the corpus size) goes to the driver; expectation-maximisation
over it estimates, for a latent class good/bad, the prior and each rule's accuracy per class among the
documents on which it votes. The posterior probability of "good" then replaces the usual demand that every rule must pass.

Priors on the rates keep EM from calling all of a rule's bad votes noise: they weigh as much as ``STRENGTH`` of the documents, so they bend to what the
other rules say, at every size of the corpus alike.

Everything is a DataFrame expression: no Python runs on executors.

Defined results: null and empty texts have no words, so every count is 0, every rule abstains but the length rule,
and the document fails the base rules; repeated rows are counted and returned each; extra columns are kept; an empty
table returns an empty one (the model then is the prior).
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bind, fresh, text_key, without_keys, words_of, written

WINDOW = 5
SYMBOLS = "[^#*$%&|<>]+"
SPACE = r"[\x20\x09-\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Lines with a word: what n_dup_lines is held against. The rules read it, the results don't have it.
LINES = "n_lines"
#: Votes: (name, good if, bad if); neither: the rule abstains. All counts are longs. A few repeated lines are no vote
#: against a long text, so dup_lines is a share of the lines.
RULES = (
    ("length", "n_words >= 50", "n_words < 15"),
    ("word_length", "n_words > 0 AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    ("symbols_per_word", "n_words > 0 AND 100 * n_symbols <= n_words", "n_words > 0 AND 10 * n_symbols > n_words"),
    ("symbols_per_char", "n_words > 0 AND 500 * n_symbols <= word_chars", "n_words > 0 AND 33 * n_symbols > word_chars"),
    ("dup_lines", "n_words > 0 AND n_dup_lines = 0", "n_dup_lines >= 3 AND 100 * n_dup_lines > 20 * n_lines"),
    ("repeats", "n_words > 0 AND 100 * n_repeat_words <= 2 * n_words", "n_words > 0 AND 100 * n_repeat_words > 10 * n_words"),
    ("line_shape", "n_words > 0 AND n_words >= 6 * n_lines", "n_words > 0 AND n_words < 2 * n_lines"),
)
MIN_POSTERIOR = 0.5
#: What the priors weigh, as a share of all documents; chance of a bad vote on a bad and on a good document, and of a good document, that they hold.
STRENGTH = 0.05
PRIOR_BAD = {0: 0.5, 1: 0.02}
PRIOR_GOOD = 0.9


def with_stats(docs: DataFrame, text_col: str = "text", names: Iterable[str] = (*STATS, LINES)) -> DataFrame:
    """``docs`` plus the six counts, computed row by row over the whole text without a shuffle."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines = names
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = words_of(text)

    def repeated(h: Column) -> Column:
        window = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        found = bind(window, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _repeated(w)).otherwise(F.lit(0)))
        return F.when(F.size(h) > WINDOW, found).otherwise(F.lit(0))

    of_words = bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).alias("n"), repeated(h).alias("r")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    of_lines = bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("r")))
    both, line = fresh(docs, "_words", "_lines")
    d = docs.withColumn(both, of_words).withColumn(line, of_lines)
    return d.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(both)["n"].cast("long").alias(n_words),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias(word_chars),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias(n_symbols),
        F.col(line)["r"].cast("long").alias(n_dup_lines),
        F.col(both)["r"].cast("long").alias(n_repeat),
        F.col(line)["n"].cast("long").alias(n_lines),
    )


def _repeated(wins: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort (hash, place), keep places with an equal neighbour,
    then add up what the windows at those places cover."""
    order = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def equal_neighbours(o: Column) -> Column:
        same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
        found = F.filter(o, lambda x, i: same(x, F.get(o, i - 1)) | same(x, F.get(o, i + 1)))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    places = bind(order, equal_neighbours)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        places, start,
        lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )


def vote_columns(stats: Iterable[str] = (*STATS, LINES)) -> list[Column]:
    """One int column per rule: 1 good, 0 bad, -1 abstains."""
    named = dict(zip((*STATS, LINES), stats, strict=True))
    out = []
    for _, good, bad in RULES:
        for plain, own in named.items():
            if own != plain:
                good, bad = good.replace(plain, f"`{own}`"), bad.replace(plain, f"`{own}`")
        out.append(F.when(F.expr(good), 1).when(F.expr(bad), 0).otherwise(-1))
    return out


@dataclass(frozen=True)
class VoteModel:
    """prior: of good. rates[r][y][v]: chance that rule r, when it votes, votes v (0, 1) on a document of class y. An
    abstention says nothing."""

    prior: float
    rates: tuple[dict[int, dict[int, float]], ...]
    rounds: int

    def posterior(self, votes: Iterable[int]) -> float:
        good, bad = math.log(self.prior), math.log(1 - self.prior)
        for r, v in zip(self.rates, votes, strict=True):
            if v >= 0:
                good, bad = good + math.log(r[1][v]), bad + math.log(r[0][v])
        return 1 / (1 + math.exp(min(700, max(-700, bad - good))))

    def accuracy(self, r: int) -> float:
        """How often rule r is right when it votes."""
        right = self.prior * self.rates[r][1][1] + (1 - self.prior) * self.rates[r][0][0]
        wrong = self.prior * self.rates[r][1][0] + (1 - self.prior) * self.rates[r][0][1]
        return right / (right + wrong)


def fit_votes(patterns: dict[tuple[int, ...], int], max_rounds: int = 500, tolerance: float = 1e-10, strength: float = STRENGTH) -> VoteModel:
    """EM over pattern counts, begun from the number of bad votes. The priors count as ``strength`` of the documents and one more."""
    rules, total = len(RULES), sum(patterns.values())
    weight = strength * total + 1
    q = {p: {0: 0.95, 1: 0.6}.get(sum(v == 0 for v in p), 0.1) for p in patterns}
    model, last = None, None
    for rounds in range(1, max_rounds + 1):
        prior = (sum(q[p] * n for p, n in patterns.items()) + PRIOR_GOOD * weight) / (total + weight)
        rates = []
        for r in range(rules):
            by = {y: {0: PRIOR_BAD[y] * weight, 1: (1 - PRIOR_BAD[y]) * weight} for y in (0, 1)}
            for p, n in patterns.items():
                if p[r] >= 0:
                    by[1][p[r]] += q[p] * n
                    by[0][p[r]] += (1 - q[p]) * n
            rates.append({y: {v: c / sum(by[y].values()) for v, c in by[y].items()} for y in by})
        model = VoteModel(prior, tuple(rates), rounds)
        q = {p: model.posterior(p) for p in patterns}
        if last is not None and abs(prior - last) < tolerance:
            break
        last = prior
    return model


def fit_corpus(with_counts: DataFrame, stats: Iterable[str] = (*STATS, LINES)) -> VoteModel:
    """Fit on the vote patterns of all rows; only the pattern counts leave the cluster."""
    names = [name for name, _, _ in RULES]
    votes = with_counts.select(*[v.alias(n) for v, n in zip(vote_columns(stats), names, strict=True)])
    counts = votes.groupBy(*names).agg(F.count("*").alias("n")).collect()
    return fit_votes({tuple(r[n] for n in names): r["n"] for r in counts})


def posterior_column(model: VoteModel, stats: Iterable[str] = (*STATS, LINES)) -> Column:
    """Posterior probability of good: log odds added up rule by rule."""
    odds = F.lit(math.log(model.prior) - math.log(1 - model.prior))
    for vote, r in zip(vote_columns(stats), model.rates, strict=True):
        by = {v: math.log(r[1][v]) - math.log(r[0][v]) for v in (0, 1)}
        odds = odds + F.when(vote == 1, by[1]).when(vote == 0, by[0]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed(stats: Iterable[str] = (*STATS, LINES)) -> Column:
    n_words, _, _, _, n_repeat, _ = stats
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat) > 20 * F.col(n_words))


def judge(docs: DataFrame, text_col: str = "text", min_posterior: float = MIN_POSTERIOR, model: VoteModel | None = None) -> DataFrame:
    """``docs`` plus the counts, base_failed, posterior and kept. Without a model, one is fitted on these documents
    first, in a pass of its own that shuffles vote patterns only."""
    *stats, failed, posterior, kept, lines = fresh(docs, *STATS, "base_failed", "posterior", "kept", LINES)
    stats.append(lines)
    if model is None:
        model = fit_corpus(with_stats(docs.select(F.col(text_col)), text_col))
    d = with_stats(docs, text_col, stats)
    d = d.withColumn(failed, base_failed(stats)).withColumn(posterior, posterior_column(model, stats))
    return d.withColumn(kept, ~F.col(failed) & (F.col(posterior) >= min_posterior)).drop(lines)


def keep_good(docs: DataFrame, text_col: str = "text", model: VoteModel | None = None, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """``docs`` with its own columns, without the documents that are not kept. The counts are made once and written under a key of the text, without
    it; the fit reads them, and so does the list of rejected keys, by which documents go."""
    texts = docs.select(F.col(text_col).alias("text"))
    counts = written(with_stats(texts).select(text_key(F.col("text")).alias("key"), *STATS, LINES), "stats")
    model = model or fit_corpus(counts)
    bad = base_failed() | (posterior_column(model) < min_posterior)
    return without_keys(docs, text_key(F.col(text_col)), counts.where(bad), "rejected")
