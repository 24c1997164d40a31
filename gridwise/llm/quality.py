"""Quality rules that vote or abstain, combined by a latent-class model fitted without labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwise.llm.rows import own_columns, with_features
from gridwise.shared import stored

#: Counted as symbols.
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"
_WORD = re.compile("[^\x20\x09-\x0d]+")

#: Words of a run in which distinct words are counted: over a whole text their share would fall with its length alone.
RUN_WORDS = 1000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_run_distinct_words", "n_stutters", "n_capitals", "n_shouts", "n_bars", "n_sentence_ends", "n_plain_words"]


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS; words are runs of characters other than space and \\x09 to \\x0D.  n_run_distinct_words adds up
    the distinct words of each RUN_WORDS words from the start to the end of the text."""
    if not text:
        return (0,) * len(COUNTS)
    words = _WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        covered = bytearray(len(words))
        for i, w in enumerate(windows):
            if w in often:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    capitals = sum(map(str.isupper, words))
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        sum(len(set(words[i : i + RUN_WORDS])) for i in range(0, len(words), RUN_WORDS)),
        sum(map(str.__eq__, words, words[1:])),
        capitals,
        text.count("!!"),
        words.count("|"),
        sum(w[-1] in ".!?" for w in words),
        sum(map(str.isalpha, words)),
    )


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *COUNTS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _share(n: Column, of: Column) -> Column:
    return n / F.greatest(of, F.lit(1))


def _bad_if(condition: Column) -> Column:
    return F.when(condition, -1).otherwise(0)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(at: str = "") -> dict[str, Column]:
    """Name -> vote: 1 good, -1 bad, 0 abstains.  Rules overlap on purpose: a kind of damage shows in several of them, and none
    decides alone.  Most vote either way and abstain in between; `length`, `distinct_words`, `word_length` and `sentences` are
    rough, and are often wrong about a text that nothing else objects to.  Thresholds are ratios, or hold for runs of a fixed length.  `at` comes
    before the names of the counts."""
    n = {c: F.col(at + c) for c in COUNTS}
    share = lambda c: _share(n[c], n["n_words"])
    symbols, chars, windows, lines = share("n_symbols"), share("word_chars"), share("n_repeat_words"), share("n_dup_lines")
    distinct, ends, plain, of_chars = share("n_run_distinct_words"), share("n_sentence_ends"), share("n_plain_words"), _share(n["n_symbols"], n["word_chars"])
    prose = distinct.between(0.25, 1) & chars.between(3, 11) & (ends >= 0.02)
    return {
        "prose": F.when(prose & (n["n_words"] >= 50), 1).otherwise(0),
        "length": _vote(n["n_words"] >= 80, n["n_words"] < 30),
        "symbols": _vote(symbols <= 0.02, symbols >= 0.1),
        "symbol_chars": _vote(of_chars <= 0.002, of_chars >= 0.04),
        "plain_words": _vote(plain >= 0.7, plain <= 0.55),
        "repeated_windows": _vote(windows <= 0.02, windows >= 0.2),
        "repeated_lines": _vote(lines == 0, lines >= 0.02),
        "stutter": _vote(share("n_stutters") <= 0.02, share("n_stutters") >= 0.1),
        "capitals": _vote(share("n_capitals") <= 0.02, share("n_capitals") >= 0.2),
        "shouts": _vote(n["n_shouts"] == 0, share("n_shouts") >= 0.02),
        "table_bars": _vote(n["n_bars"] == 0, share("n_bars") >= 0.05),
        "variety": _bad_if(distinct <= 0.15),
        "distinct_words": _vote(distinct >= 0.65, distinct <= 0.5),
        "word_length": _vote(chars.between(4, 7), ~chars.between(3.5, 7.5)),
        "sentences": _vote(ends.between(0.04, 0.3), ends <= 0.03),
    }


class RuleModel:
    """A hidden class (good or bad) behind the votes, fitted by expectation-maximisation.

    Estimated are the share of good documents and how often each rule votes bad, abstains and votes good on documents of
    either class; a vote, or an abstention, weighs the logarithm of the ratio of its two chances, so a rule that is often
    wrong weighs little.  No vote is a veto: the posterior adds them up.  All rules start alike, and pseudo-documents
    of that start (a fiftieth of all, 20 at least) keep the classes' meaning on small tables.
    """

    #: At the start, chances of a bad vote, an abstention and a good vote, on bad and on good documents; share of good ones.
    START, SHARE = np.array([[0.3, 0.1, 0.6], [0.01, 0.09, 0.9]]), 0.8

    def __init__(self, share: float, chances: np.ndarray):
        self.share, self.chances = share, chances  # chances[class, rule, vote + 1]

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> RuleModel:
        """patterns: distinct vectors of votes; counts: how many documents have each."""
        model = cls(cls.SHARE, np.repeat(cls.START[:, None, :], patterns.shape[1], axis=1))
        if not len(counts):
            return model
        votes = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
        pseudo = max(20.0, 0.02 * counts.sum())
        for _ in range(steps):
            good = model.posterior(patterns)
            chances = np.empty_like(model.chances)
            for c, weight in ((0, counts * (1 - good)), (1, counts * good)):
                chances[c] = (np.tensordot(weight, votes, 1) + pseudo * cls.START[c]) / (weight.sum() + pseudo)
            model = cls((counts @ good + pseudo * cls.SHARE) / (counts.sum() + pseudo), chances)
        return model

    def weights(self) -> np.ndarray:
        """Log odds of good that a bad vote, an abstention and a good vote of each rule carry."""
        return np.log(self.chances[1] / self.chances[0])

    def accuracy(self) -> np.ndarray:
        """Chance that a bad and that a good vote of each rule is right."""
        bad, good = (1 - self.share) * self.chances[0], self.share * self.chances[1]
        return np.stack([bad[:, 0] / (bad + good)[:, 0], good[:, 2] / (bad + good)[:, 2]], axis=1)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = math.log(self.share / (1 - self.share)) + sum((patterns == v) @ self.weights()[:, v + 1] for v in (-1, 0, 1))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_rules(votes: DataFrame) -> RuleModel:
    """Fits the model to all documents: only distinct vote vectors and their counts (at most 3 to the power
    of the number of rules) reach the driver."""
    names = [c for c in votes.columns if c.startswith("vote_")]
    rows = votes.groupBy(*names).count().collect()
    return RuleModel.fit(np.array([r[:-1] for r in rows]).reshape(len(rows), len(names)), np.array([r[-1] for r in rows], float))


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, one vote a rule, base_failed, posterior and kept for each row of `docs`.

    A document is kept if it has at least 50 words, at most half of them in repeated windows, and a posterior of
    at least `threshold`.  Null and empty texts have no words and are not kept.  Rows with a null or repeated doc_id
    are judged each for itself; an empty table gives no rows; other columns are not read.
    """
    votes = _stored_votes(docs)
    posterior = _posterior(fit_rules(votes), {r: F.col(f"vote_{r}") for r in rules()})
    out = votes.withColumn("base_failed", _failed()).withColumn("posterior", posterior)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that `quality` keeps, with their columns, whatever those are called.  The model is fitted first; then each row
    is judged by its own text, so null and repeated doc_ids make no difference."""
    model = fit_rules(_stored_votes(docs))
    counts, name = with_features(docs, dict.fromkeys(COUNTS, "long"), lambda: text_counts)
    return counts.filter(~_failed(f"{name}.") & (_posterior(model, rules(f"{name}.")) >= threshold)).select(*own_columns(docs))


def _failed(at: str = "") -> Column:
    return (F.col(f"{at}n_words") < 50) | (100 * F.col(f"{at}n_repeat_words") > 50 * F.col(f"{at}n_words"))


def _posterior(model: RuleModel, votes: dict[str, Column]) -> Column:
    odds = F.lit(math.log(model.share / (1 - model.share)))
    for vote, weight in zip(votes.values(), model.weights().tolist(), strict=True):
        odds = odds + F.when(vote == -1, weight[0]).when(vote == 1, weight[2]).otherwise(weight[1])
    return 1 / (1 + F.exp(-odds))


def _stored_votes(docs: DataFrame) -> DataFrame:
    return stored(counted(docs).withColumns({f"vote_{r}": vote.cast("int") for r, vote in rules().items()}), "quality-votes")
