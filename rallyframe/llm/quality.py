"""Quality rules as weak supervision.

Each rule looks at counts of a whole text and votes "clean", votes "junk" or
abstains.  Expectation-maximisation over the table of vote patterns estimates,
for each class, how often each rule casts each vote; a text's posterior
probability of being clean then decides, instead of every rule having to pass.

The model is learnt from all texts: they are first grouped to vote patterns, of
which there are at most 3 ** (number of rules) whatever the input, so what reaches the
driver is bounded.

Defined cases: a null text counts as empty; an empty text has no words, fails
the base rule and is not kept; repeated rows are judged alike; an empty table
gives an empty result; other columns are passed over (`verdicts`) or handed
through untouched (`keep_clean`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_RE, free_name, staged, words_of

SYMBOLS = frozenset("#*$%&|<>")
# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for on with as was be by at this from are or an not he they "
    "le la les de des du et en un une que qui dans pour par sur au est avec "
    "der die das den dem des und von zu mit ein eine ist im für auf als nicht "
    "el los las del y se por un para con no una su lo".split()
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper_words", "n_bare_words", "n_plain_words", "n_function_words", "n_shouts", "n_distinct_words")
COUNTS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
JUNK, CLEAN, ABSTAIN = 0, 1, 2
#: The largest share of clean texts that a rule may vote against.
MISFIRES = 0.01


def repeated_words(words: list[str], width: int = 5) -> int:
    """How many words stand in windows of `width` words that are found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = h[:n].copy()
    for i in range(1, width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    # windows that share a hash are compared as words
    at = np.nonzero(np.isin(key, twice))[0].tolist()
    windows = [tuple(words[i : i + width]) for i in at]
    counts = Counter(windows)
    total = end = 0
    for i, w in zip(at, windows):
        if counts[w] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one whole text."""
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if WORD_RE.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(x.rstrip(" \t\r\x0b\x0c\"')")[-1:] in (".", "!", "?", ":", "…") for x in lines),
        sum(map(str.isupper, words)),
        sum(not w.isalnum() for w in words if len(w) < 2),
        sum(map(str.isalpha, words)),
        sum(map(FUNCTION_WORDS.__contains__, words)),
        text.count("!"),
        len(set(words)),
    )


@F.pandas_udf(COUNTS_TYPE)
def counts_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([text_counts(x) for x in batch], columns=list(COUNTS)).astype("int64")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def rules(c: Column) -> dict[str, tuple[Column, Column]]:
    """Name -> (votes junk, votes clean); neither: abstains.  Rules on single kinds of junk never vote clean.  c: the struct of counts."""
    n, share, never = c["n_words"], lambda k, of="n_words": c[k] / F.greatest(c[of], F.lit(1)), F.lit(False)
    return {
        "function_words": ((n >= 40) & (share("n_function_words") < 0.05), share("n_function_words") > 0.1),
        "plain_words": ((n >= 20) & (share("n_plain_words") < 0.55), share("n_plain_words") > 0.7),
        "ended_lines": ((c["n_lines"] >= 3) & (share("n_ended_lines", "n_lines") < 0.3), (c["n_lines"] >= 1) & (share("n_ended_lines", "n_lines") > 0.7)),
        # a text's different words grow with its length, but ever more slowly: a fifth of a thousand words, with the root beyond
        "vocabulary": ((n >= 50) & (c["n_distinct_words"] < F.least(0.2 * n, F.sqrt(40.0 * n))), (n >= 10) & (share("n_distinct_words") > 0.4)),
        "length": (n < 10, never),
        "word_length": ((share("word_chars") > 12) | (share("word_chars") < 2.5), never),
        "symbols": (share("n_symbols") > 0.3, never),
        "bare_words": (share("n_bare_words") > 0.2, never),
        "upper_case": ((n >= 30) & (share("n_upper_words") > 0.4), never),
        "shouting": (share("n_shouts") > 0.4, never),
        "repeated_words": ((n >= 20) & (share("n_repeat_words") > 0.2), never),
        "repeated_lines": ((c["n_lines"] >= 3) & (share("n_dup_lines", "n_lines") > 0.4), never),
    }


def votes(c: Column) -> Column:
    """An array of one vote a rule."""
    return F.array(*(F.when(junk, F.lit(JUNK)).when(clean, F.lit(CLEAN)).otherwise(F.lit(ABSTAIN)) for junk, clean in rules(c).values()))


@dataclass(frozen=True)
class LabelModel:
    """prior: share of clean texts.  table[k][j][v]: chance that rule j casts vote v on a text of class k (JUNK, CLEAN)."""

    prior: float
    table: tuple

    def log_odds(self, v: Column) -> Column:
        """Log odds of clean for an array of votes."""
        odds = F.lit(float(np.log(self.prior) - np.log1p(-self.prior)))
        for j, (junk, clean) in enumerate(zip(*self.table)):
            diff = [float(np.log(a) - np.log(b)) for a, b in zip(clean, junk)]
            odds = odds + F.when(v[j] == JUNK, diff[JUNK]).when(v[j] == CLEAN, diff[CLEAN]).otherwise(diff[ABSTAIN])
        return odds

    def posterior(self, v: Column) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(v)))

    def accuracies(self) -> list[float]:
        """Chance of a right vote where the rule votes, by rule."""
        out = []
        for junk, clean in zip(*self.table):
            right = self.prior * clean[CLEAN] + (1 - self.prior) * junk[JUNK]
            out.append(right / max(1e-12, right + self.prior * clean[JUNK] + (1 - self.prior) * junk[CLEAN]))
        return out


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, tolerance: float = 1e-9) -> LabelModel:
    """Fits the label model to distinct vote patterns (one a row) and how often each is found.

    Starts from rules that seldom speak against a clean text and often miss a
    junk one, and holds each rule to at most MISFIRES votes against clean texts, so
    that the classes keep their names; one pseudo-text a cell keeps every chance
    positive.
    """
    order = np.lexsort(patterns.T[::-1])
    patterns, counts = patterns[order], counts[order].astype(float)
    n_rules = patterns.shape[1]
    table = np.empty((2, n_rules, 3))
    table[CLEAN], table[JUNK] = (0.02, 0.7, 0.28), (0.3, 0.4, 0.3)
    prior, last = 0.9, -np.inf
    one_hot = np.stack([patterns == v for v in (JUNK, CLEAN, ABSTAIN)], axis=2).astype(float)
    for _ in range(rounds):
        ll = np.stack([(one_hot * np.log(table[k])).sum(axis=(1, 2)) for k in (JUNK, CLEAN)]) + np.log([[1 - prior], [prior]])
        top = ll.max(axis=0)
        mass = np.exp(ll - top)
        total = (counts * (top + np.log(mass.sum(axis=0)))).sum()
        q = mass / mass.sum(axis=0) * counts
        cells = np.einsum("kp,pjv->kjv", q, one_hot) + 1.0
        table = cells / cells.sum(axis=2, keepdims=True)
        wrong = np.minimum(table[CLEAN][:, JUNK], MISFIRES)
        table[CLEAN][:, CLEAN:] *= ((1 - wrong) / (1 - table[CLEAN][:, JUNK]))[:, None]
        table[CLEAN][:, JUNK] = wrong
        prior = float(np.clip((q[CLEAN].sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
        if abs(total - last) <= tolerance * abs(total):
            break
        last = total
    return LabelModel(prior, tuple(tuple(map(tuple, table[k])) for k in (JUNK, CLEAN)))


def fit(counted: DataFrame, counts: str = "counts") -> LabelModel:
    """The label model of all rows of a table with a column of counts."""
    rows = counted.groupBy(votes(F.col(counts)).alias("v")).count().collect()  # at most 3 ** rules rows
    if not rows:
        return em(np.zeros((0, len(rules(F.col(counts)))), int), np.zeros(0))
    return em(np.array([r["v"] for r in rows]), np.array([r["count"] for r in rows]))


def verdicts(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, the votes, posterior (of clean), base_failed, kept; a row for each row of docs."""
    counted = staged(docs.select("doc_id", counts_of("text").alias("counts")))
    model = fit(counted)
    c = F.col("counts")
    failed = base_failed(c["n_words"], c["n_repeat_words"])
    return counted.select("doc_id", *(c[k].alias(k) for k in COUNTS), votes(c).alias("votes"), model.posterior(votes(c)).alias("posterior"), failed.alias("base_failed"), (~failed & (model.posterior(votes(c)) >= threshold)).alias("kept"))


def keep_clean(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, that pass the base rule and have a posterior of at least threshold."""
    name = free_name(docs, "counts")
    counted = staged(docs.withColumn(name, counts_of(F.col("text"))))
    model = fit(counted, name)
    c = F.col(name)
    return counted.where(~base_failed(c["n_words"], c["n_repeat_words"]) & (model.posterior(votes(c)) >= threshold)).drop(name)
