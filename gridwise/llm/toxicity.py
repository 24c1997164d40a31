"""Toxicity by a weighted pattern grammar: transducers over words and over clauses, composed.

A word transducer (a character trie whose entries may end in an open stem) turns each word of a clause into a symbol:
insult or threat (with a weight), target, negation, reported speech, or any other word.  Three small transducers read those symbols:
one marks what a negation reaches, one marks what stands in reported speech, one pairs insults and threats with a
target before or after them.  Composed, they are one grammar whose best path through a clause says which patterns it matches and
what they weigh.  Insult entries come from a small fixed list and, with their weights, from the labels; a logistic model over the
matched patterns of a document's clauses, none of which may lower the score, turns them into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwise.llm.rows import own_columns, with_features
from gridwise.shared import stored

# Word lists of the grammar, in the four languages of the corpus.
INSULTS = "idiot moron clown pathetic worthless scum trash loser stupid disgusting dumb imbecile fool jerk bastard dumm dummkopf idioten abschaum versager ekelhaft stupide imbécile crétin ordure minable estúpido imbécil basura escoria patético inútil".split()
THREATS = "kill hurt destroy beat crush töten verletzen zerstören schlagen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours they them he she him her this that these those du dich dir ihr euch sie er tu toi te vous ils elle lui usted tú ti ellos ella él".split()
NEGATIONS = "not no never isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say told called claims claimed wrote quoted sagte sagt behauptet schrieb dit disait affirme écrit dijo dice afirma escribió".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "I", "H", "T", "N", "R", "."
#: Weight of a listed insult or threat; learned entries have their own.
LISTED = 2.0
#: A negation reaches so many words ahead.
REACH = 3
#: Patterns that the grammar tells apart, and what each is worth when paths through a clause are compared; how much each adds to a
#: document's score is learned.
PATTERNS = {"bare": 1.0, "directed": 1.5, "threat": 1.5, "reported": 0.5, "negated": 0.25}
#: Labelled rows that a fit looks at, at most; learned entries at most; letters of a stem.
MAX_LABELLED, MAX_ENTRIES, STEM = 20_000, 4096, (3, 8)
FEATURES = ["total", *PATTERNS, "highest", "clauses", "rate"]

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]+")
_CLAUSE_END = frozenset(".!?;:\n")


class WordTransducer(dict):
    """word -> (class, weight) or None, read off a character trie; answers are kept in a bounded table."""

    ENTRIES = 200_000

    def __init__(self, learned: list[tuple[str, float]]):
        super().__init__()
        self.root: dict = {}
        for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for w in words:
                self.enter(w, kind, 0.0)
        for kind, words in ((INSULT, INSULTS), (THREAT, THREATS)):
            for w in words:
                self.enter(w, kind, LISTED)
        for entry, weight in learned:
            self.enter(entry, INSULT, weight)

    def enter(self, entry: str, kind: str, weight: float) -> None:
        """An entry that ends in * is a stem: it accepts any word that goes on after it."""
        state = self.root
        for c in entry.rstrip("*"):
            state = state.setdefault(c, {})
        state["*" if entry.endswith("*") else "$"] = (kind, weight)

    def __missing__(self, word: str) -> tuple[str, float] | None:
        state, stem = self.root, None
        for c in word:
            stem = state.get("*", stem)
            state = state.get(c)
            if state is None:
                break
        found = (state or {}).get("$", stem)
        if len(self) >= self.ENTRIES:
            self.clear()
        self[word] = found
        return found


class Machine:
    """A finite-state transducer: moves[state, symbol] lists (next state, output); paths begin in any start and end in a final."""

    def __init__(self, starts: set, finals: set, moves: dict[tuple, list[tuple]]):
        self.starts, self.finals, self.moves = starts, finals, moves

    def then(self, other: Machine) -> Machine:
        """The composition: what this machine puts out, the other one reads."""
        starts = {(a, b) for a in self.starts for b in other.starts}
        moves: dict[tuple, list[tuple]] = {}
        open_states, seen = list(starts), set(starts)
        symbols = {x for _, x in self.moves}
        while open_states:
            a, b = state = open_states.pop()
            for symbol in symbols:
                to = [((x, y), out) for x, middle in self.moves.get((a, symbol), ()) for y, out in other.moves.get((b, middle), ())]
                if to:
                    moves[state, symbol] = to
                new = {x for x, _ in to} - seen
                seen |= new
                open_states += new
        return Machine(starts, {(a, b) for a, b in seen if a in self.finals and b in other.finals}, moves)


def negation_machine() -> Machine:
    """Marks insults and threats up to REACH words after a negation."""
    moves = {}
    for left in range(REACH + 1):
        after = max(0, left - 1)
        for symbol in (TARGET, REPORT, OTHER):
            moves[left, symbol] = [(after, symbol)]
        moves[left, NEGATION] = [(REACH, NEGATION)]
        for harm in (INSULT, THREAT):
            moves[left, harm] = [(after, harm + "-" if left else harm)]
    return Machine({0}, set(range(REACH + 1)), moves)


def report_machine() -> Machine:
    """Marks insults and threats after a word of reported speech."""
    harms = [h + m for h in (INSULT, THREAT) for m in ("", "-")]
    moves = {(state, x): [(state, x)] for state in (0, 1) for x in (TARGET, NEGATION, OTHER)}
    moves |= {(state, REPORT): [(1, REPORT)] for state in (0, 1)}
    moves |= {(0, h): [(0, h)] for h in harms} | {(1, h): [(1, h + "r")] for h in harms}
    return Machine({0}, {0, 1}, moves)


def target_machine() -> Machine:
    """Puts out the pattern of each insult and threat, by whether the clause has a target: a path that starts in `promised` counts on one
    that is yet to come, and ends only if it came.  A threat without a target is none."""
    harms = [h + m + r for h in (INSULT, THREAT) for m in ("", "-") for r in ("", "r")]
    moves = {(state, x): [(state, None)] for state in ("none", "seen", "promised") for x in (NEGATION, REPORT, OTHER)}
    moves |= {("none", TARGET): [("seen", None)], ("seen", TARGET): [("seen", None)], ("promised", TARGET): [("seen", None)]}
    for h in harms:
        marked = "negated" if "-" in h else "reported" if "r" in h else None
        moves["none", h] = [("none", None if h[0] == THREAT else marked or "bare")]
        for state in ("seen", "promised"):
            moves[state, h] = [(state, marked or ("threat" if h[0] == THREAT else "directed"))]
    return Machine({"none", "promised"}, {"none", "seen"}, moves)


GRAMMAR = negation_machine().then(report_machine()).then(target_machine())


def clause_patterns(symbols: list[tuple[int, str, float]], grammar: Machine = GRAMMAR) -> tuple[float, dict[str, float]]:
    """Score of the best path through a clause and the weight that each pattern has on it; symbols: (position, symbol, weight) of
    the words that are not OTHER, in order."""
    paths: dict = {s: (0.0, ()) for s in grammar.starts}
    before = -1
    for at, symbol, weight in symbols:
        for x in [OTHER] * min(at - before - 1, REACH) + [symbol]:  # further words change no state
            step: dict = {}
            for state, (score, matched) in paths.items():
                for to, pattern in grammar.moves.get((state, x), ()):
                    new = (score + weight * PATTERNS[pattern], (*matched, (pattern, weight))) if pattern else (score, matched)
                    if to not in step or new[0] > step[to][0]:
                        step[to] = new
            paths = step
        before = at
    score, matched = max((paths[s] for s in paths if s in grammar.finals), key=lambda p: p[0])
    by: dict[str, float] = {}
    for pattern, weight in matched:
        by[pattern] = by.get(pattern, 0.0) + weight
    return score, by


def document_features(text: str | None, words: WordTransducer, grammar: Machine = GRAMMAR) -> tuple[float, ...]:
    """The FEATURES of a whole text: its clause scores together, the weight of each pattern, the highest clause score, clauses that match, and their rate."""
    if not text:
        return (0.0,) * len(FEATURES)
    tokens = _TOKEN.findall(text.lower())
    classes = list(map(words.__getitem__, tokens))
    harmful = [i for i, c in enumerate(classes) if c and c[0] in (INSULT, THREAT)]
    by, total, highest, clauses, done = dict.fromkeys(PATTERNS, 0.0), 0.0, 0.0, 0, -1
    for i in harmful:  # only clauses with something to score are read in full
        if i <= done:
            continue
        a = b = i
        while a and tokens[a - 1][0] not in _CLAUSE_END:
            a -= 1
        while b < len(tokens) and tokens[b][0] not in _CLAUSE_END:
            b += 1
        done = b
        score, matched = clause_patterns([(k - a, *classes[k]) for k in range(a, b) if classes[k]], grammar)
        for pattern, weight in matched.items():
            by[pattern] += weight
        total, highest, clauses = total + score, max(highest, score), clauses + (score > 0)
    return (math.log1p(total), *(math.log1p(x) for x in by.values()), highest, math.log1p(clauses), 50 * total / (len(tokens) + 50))


def featured(docs: DataFrame, learned: list[tuple[str, float]]) -> DataFrame:
    """The columns of `docs` other than text, with the FEATURES of the text."""
    keep = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTransducer(learned)
        for batch in batches:
            rows = [document_features(t, words) for t in batch.column(0).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*(f.name for f in keep), *FEATURES])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{c} double" for c in FEATURES)])
    return docs.select(F.col("text").cast("string"), *(f"`{f.name}`" for f in keep)).mapInArrow(run, schema)


def learned_entries(labelled: DataFrame) -> list[tuple[str, float]]:
    """Words and stems that labels set apart: (entry, log odds), the strongest first, at most MAX_ENTRIES.

    An entry must occur in three toxic documents at least and be clearly more frequent in toxic ones; a stem must beat
    what its own whole words already say.  Listed words are never learned: their meaning is fixed.
    """
    low, high = STEM

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                count: dict[str, list[int]] = {}
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
                    seen |= {w[:k] + "*" for w in seen for k in range(low, min(high, len(w) - 1) + 1)}
                    for entry in seen:
                        count.setdefault(entry, [0, 0])[toxic] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), *(pa.array([c[i] for c in count.values()], pa.int64()) for i in (0, 1))], names=["entry", "clean", "toxic"])

    totals = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    counts = labelled.select("text", "toxic").mapInArrow(parts, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strong = counts.filter("toxic >= 3").withColumn("odds", odds).filter((F.col("odds") - 1.5 * error > 0.7) & (F.col("odds") > 1.4))
    rows = strong.orderBy(F.desc(F.col("odds") - error), "entry").limit(4 * MAX_ENTRIES).collect()
    fixed = {*INSULTS, *THREATS}
    chosen: dict[str, float] = {}
    for r in rows:
        if r.entry in fixed or any(f.startswith(r.entry[:-1]) for f in fixed if r.entry.endswith("*")):
            continue
        chosen[r.entry] = min(4.0, r.odds)
    return list(chosen.items())[:MAX_ENTRIES]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic model; the last weight is the constant.  No other weight is below 0: a
    feature that would be is left out and the rest fitted again."""
    w = _newton(x, y, penalty, steps)
    if (low := np.flatnonzero(w[:-1] < 0)).size:
        worst = low[np.argmin(w[low])]
        rest = logistic(np.delete(x, worst, axis=1), y, penalty, steps)
        return np.insert(rest, worst, 0.0)
    return w


def _newton(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """Entries of the grammar and the weights of the document score."""

    def __init__(self, entries: list[tuple[str, float]], weights: np.ndarray):
        self.entries, self.weights = entries, weights

    @classmethod
    def fit(cls, labelled: DataFrame) -> ToxicityModel:
        """`labelled`: text, toxic and fold, of `training_rows`.  Entries learned on even folds give the features on which
        odd folds fit the weights, so no document is scored by entries that it suggested itself; the entries of the
        final model come from all folds."""
        rows = stored(labelled.filter("text IS NOT NULL"), "toxic-labelled")
        even = rows.filter("fold % 2 = 0")
        held = featured(rows.filter("fold % 2 <> 0"), learned_entries(even)).select("toxic", *FEATURES).collect()
        x = np.array([r[1:] for r in held], float).reshape(len(held), len(FEATURES))
        y = np.array([r[0] for r in held], float)
        # listed words speak for themselves where labels say nothing
        prior_x = np.array([document_features(t, WordTransducer([])) for t in ("you idiot", "stupid loser trash", "the day", "a walk by the sea")])
        x, y = np.vstack([x, prior_x]), np.concatenate([y, [1, 1, 0, 0]])
        return cls(learned_entries(rows), logistic(x, y))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The columns of `docs` other than text, the FEATURES, `score` (0 to 1) and `predicted` (1 if score >= 0.5).

    Null and empty texts match nothing and get the score of that.  Every row is scored by itself, so copies get
    equal scores; an empty table gives no rows; extra columns pass through.
    """
    out = featured(docs, model.entries).withColumn("score", _probability(model))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs` with a score under a half, with their columns, whatever those are called.  Each row is judged by its own text."""
    entries = model.entries

    def reader():
        words = WordTransducer(entries)
        return lambda text: document_features(text, words)

    rated, name = with_features(docs, dict.fromkeys(FEATURES, "double"), reader)
    return rated.filter(_probability(model, f"{name}.") < 0.5).select(*own_columns(docs))


def _probability(model: ToxicityModel, at: str = "") -> Column:
    *weights, z = model.weights.tolist()
    for name, weight in zip(FEATURES, weights, strict=True):
        z = F.col(at + name) * weight + z
    return 1 / (1 + F.exp(-z))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """text, toxic and fold of labelled documents that may be learned from: crc32 of doc_id as text, modulo 5, is not
    0 (it is their fold).  At most `max_labelled`, those with the smallest hashes of their id; so the ids that are
    broadcast to find their texts are bounded too.  A document with clashing labels is toxic."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    own = labels.select("doc_id", "toxic").filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold != 0)
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "toxic", fold.alias("fold"))
