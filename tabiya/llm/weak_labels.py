"""Quality classifier from a weak-label model and a hashed linear scorer.

Several heuristic labellers look at a document and vote good, bad, or nothing. Expectation maximisation estimates, from
how the votes agree, each labeller's accuracy and each document's probability of being good. Documents with the same
votes have the same probability, so the model needs only the number of documents with each pattern of votes, at most
3**labellers of them, however many documents there are. A linear scorer over hashed features is then trained on those
probabilities and alone decides about every document.

Two things are told apart, by labellers of their own: quality, from measurements of the text; and toxicity, from word
lists of four languages (each silent about texts in the others), insults next to a second person, and shouting. Where
people have labelled some documents, they are one more labeller of each, silent about all others, whose accuracy is
estimated like the rest. The quality scorer looks at shares of words and buckets of the measurements; the toxicity
scorer at which words and beginnings of words are there at all, those that differ clearly between the two kinds of
documents. So it also finds what no list holds.

Counts of patterns cover all documents. The scorers are trained on TRAIN_DOCS documents at most, chosen by a hash of
their id, those with labels of people first; that is the operator's one bounded sample. Scores are for all.

The toxicity scorer and the posteriors are found together, in TOGETHER rounds of the same expectation maximisation: a
document's posterior is what the scorer says of it before any vote, times what its votes say; the scorer is trained on
these, each document weighing as much as its votes, and the scorer's opinion, have moved it from the average one.
A document about which the labellers know nothing thus starts without weight, whether people have labelled many
documents, few, or none.

Defined results: a null or empty text is voted bad by the length labeller only; equal texts get equal scores; a null id
is scored like any other but never in the sample; people's labels that are null, of unknown documents, or as often good
as bad count for nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.llm.common import table

TRAIN_DOCS, FEATURES, ROUNDS, STEPS, TOGETHER = 6_000, 1 << 18, 60, 80, 4
#: Lengths of word beginnings that are features; how clearly (in standard errors), how much (in natural logarithms) and
#: in how many documents a feature must differ to be one of the toxicity scorer.
BEGINNINGS, CLEARLY, MUCH, OFTEN = (4, 6), 4.0, 1.5, 3
BAD, GOOD, NONE = 0, 1, 2
#: Function words, second persons and common insults of four languages: fixed lists that labellers use.
FUNCTION_WORDS = {
    "en": "the of and to in is that for on with as are at be this was",
    "fr": "un une le la les de des et en est que qui dans pour pas sur",
    "es": "el los las del y que por con una para es en de la se un",
    "de": "der die das und den von zu mit sich ist im nicht ein eine auf des",
}
PERSONS = "you your you're u du dich dir dein ihr euch tu toi ton vous votre tú ti tus eres vosotros".split()
INSULTS = {
    "en": "idiot idiots moron morons scum loser losers pathetic disgusting worthless stupid trash clown garbage dumb filth vermin imbecile pig ugly",
    "fr": "idiote imbécile crétin abruti connard ordure minable dégoûtant bouffon raclure débile",
    "es": "idiota imbécil estúpido estúpida escoria basura perdedor patético asqueroso inútil payaso tonto",
    "de": "dummkopf trottel abschaum versager dreckskerl ekelhaft widerlich blöd wertlos arschloch schwachkopf",
}
LANGUAGES = tuple(INSULTS)
_SPACES, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_POINTS = b".,!?;:\"'()" + _SYMBOLS
_UPPER = bytes(range(65, 91))


def _by_word(lists: dict[str, str]) -> dict[bytes, tuple[int, ...]]:
    return {w.encode(): tuple(i for i, name in enumerate(lists) if w in lists[name].split()) for name in lists for w in lists[name].split()}


_COMMON, _INSULT, _PERSON = _by_word(FUNCTION_WORDS), _by_word(INSULTS), frozenset(w.encode() for w in PERSONS)
_MARKED = {w + end: at for w, at in _INSULT.items() for end in (b"", b".", b",", b"!", b"?", b";", b":")}
_INSULTING = frozenset(_MARKED)


def measure(text: str | None) -> tuple[dict[str, float], list[bytes]]:
    """What the labellers look at, and the lower-cased words."""
    raw = (text or "").encode()
    low = raw.lower()
    words = low.split()
    n, share = len(words), 1 / max(1, len(words))
    lines = [line.strip() for line in low.split(b"\n")]
    lines = [line for line in lines if line]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    ascii_letters = without(_UPPER) + without(bytes(range(97, 123)))
    distinct = set(words)
    common = Counter(map(_COMMON.get, words))
    del common[None]
    said = words if len(raw) == len(raw.translate(None, _SYMBOLS)) else low.translate(None, _SYMBOLS).split()
    insults = [] if _INSULTING.isdisjoint(said) else [i for i, w in enumerate(said) if w in _MARKED]
    near = sum(any(w in _PERSON for w in said[max(0, i - 3) : i + 4]) for i in insults)
    measured = {
        "words": n,
        "symbols": without(_SYMBOLS) * share,
        "marks": raw.count(b"!") * share,
        "distinct": len(distinct) * share,
        "twice": sum(map(bytes.__eq__, words, words[1:])) * share,
        "length": len(low.translate(None, _SPACES)) * share,
        "upper": without(_UPPER) / max(1, ascii_letters),
        "same_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "ends": sum(line.endswith((b".", b"!", b"?", b":", b'"')) for line in lines) / max(1, len(lines)),
        "common": common.total() * share,
        "insults": len(insults),
        "directed": near,
    }
    for i, name in enumerate(LANGUAGES):
        measured[f"common_{name}"] = sum(n for at, n in common.items() if i in at) * share
        measured[f"insults_{name}"] = sum(i in _MARKED[said[at]] for at in insults)
    return measured, words


def _between(name: str, bad: Callable[[float], bool], good: Callable[[float], bool], least: int = 20) -> Callable[[dict], int]:
    def vote(m: dict[str, float]) -> int:
        if m["words"] < least:
            return NONE
        return BAD if bad(m[name]) else GOOD if good(m[name]) else NONE

    return vote


@dataclass(frozen=True)
class Task:
    """What is to be told apart, by which labellers. People's labels are a labeller after these."""

    name: str
    labellers: tuple[Callable[[dict], int], ...]

    def votes(self, m: dict[str, float]) -> int:
        """All votes but people's as one number, a base-3 digit each."""
        return sum(vote(m) * 3**i for i, vote in enumerate(self.labellers))

    @property
    def people(self) -> int:
        """What a vote of people counts in such a number."""
        return 3 ** len(self.labellers)


def digits(pattern: np.ndarray, n: int) -> np.ndarray:
    return np.stack([pattern // 3**i % 3 for i in range(n)], axis=-1)


QUALITY = Task(
    "quality",
    (
        _between("words", lambda x: x < 1, lambda x: x >= 60, 0),
        _between("symbols", lambda x: x > 0.15, lambda x: x < 0.03),
        _between("marks", lambda x: x > 0.15, lambda x: x < 0.05),
        _between("distinct", lambda x: x < 0.2, lambda x: x > 0.4),
        _between("twice", lambda x: x > 0.1, lambda x: x < 0.03),
        _between("length", lambda x: x < 2.5 or x > 14, lambda x: 3.5 < x < 10),
        _between("upper", lambda x: x > 0.3, lambda x: x < 0.1),
        _between("same_lines", lambda x: x > 0.5, lambda x: x < 0.1),
        _between("ends", lambda x: x < 0.3, lambda x: x > 0.7),
        _between("common", lambda x: x < 0.03, lambda x: x > 0.12),
    ),
)


def _listed(language: str) -> Callable[[dict], int]:
    """A word list may call any text bad, but only texts in its own language good."""
    return lambda m: BAD if m[f"insults_{language}"] else GOOD if m[f"common_{language}"] > 0.08 else NONE


#: GOOD means free of insults.
TOXICITY = Task(
    "toxicity",
    (
        *map(_listed, LANGUAGES),
        lambda m: BAD if m["directed"] else NONE if m["insults"] else GOOD,
        lambda m: NONE if m["words"] < 20 else BAD if m["upper"] > 0.5 and m["marks"] > 0.05 else GOOD if m["upper"] < 0.1 and m["marks"] < 0.02 else NONE,
    ),
)
TASKS = (QUALITY, TOXICITY)


@dataclass(frozen=True)
class LabelModel:
    """For each labeller, how often a vote of it is right on good and on bad documents; and the share of good documents.
    From these follows the probability of good for any pattern of votes."""

    right_on_good: np.ndarray
    right_on_bad: np.ndarray
    balance: float

    def probability(self, patterns: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
        """An alarm never speaks for good: where it would, the labeller counts for nothing. prior: of each document, in
        place of the share of good ones."""
        votes = digits(patterns, len(self.right_on_good))
        voted, alarm = votes != NONE, votes == BAD
        useful = self.right_on_bad > 1 - self.right_on_good
        gain = np.where(alarm, np.log((1 - self.right_on_good) / self.right_on_bad), np.log(self.right_on_good / (1 - self.right_on_bad))) * voted * useful
        before = np.clip(self.balance if prior is None else prior, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(np.log(before / (1 - before)) + gain.sum(axis=-1), -50, 50)))

    def moved(self, p: np.ndarray) -> np.ndarray:
        """How far these probabilities are from the share of good documents, of the way to certainty; from 0 to 1."""
        return np.where(p >= self.balance, (p - self.balance) / (1 - self.balance), (self.balance - p) / self.balance)

    @staticmethod
    def fit(task: Task, counts: dict[int, int]) -> LabelModel:
        """Each kind of bad document alarms only some labellers, so a labeller has two accuracies: one would take the
        silence of all the others for agreement that the document is good. It starts from `one alarm is enough` and
        lets the votes correct that; pseudo-counts say that labellers are right on good documents."""
        patterns = np.array(sorted(counts), np.int64)
        n = np.array([counts[p] for p in patterns.tolist()], float)
        votes = digits(patterns, len(task.labellers) + 1)
        voted, alarm = votes != NONE, votes == BAD
        p = np.where(alarm.sum(axis=1) == 0, 0.95, np.where(alarm.sum(axis=1) == 1, 0.3, 0.05))
        for _ in range(ROUNDS):
            good, bad = (p * n)[:, None] * voted, ((1 - p) * n)[:, None] * voted
            on_good = ((good * ~alarm).sum(axis=0) + 49) / (good.sum(axis=0) + 50)
            on_bad = ((bad * alarm).sum(axis=0) + 1) / (bad.sum(axis=0) + 2)
            made = LabelModel(on_good, on_bad, float(((p * n).sum() + 1) / (n.sum() + 2)))
            p = made.probability(patterns)
        return made


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = zlib.crc32(word) & (FEATURES - 1)
        return found


def marks_of(word: bytes) -> list[int]:
    """The features of a word that is there: itself and its beginnings."""
    bare = word.strip(_POINTS)
    found = [zlib.crc32(bare, 1) & (FEATURES - 1)]
    for n in BEGINNINGS:
        if len(bare) > n:
            found.append(zlib.crc32(bare[:n], 2) & (FEATURES - 1))
    return found


_HASHES = _Hashes()
_STATS = ("symbols", "marks", "distinct", "twice", "length", "upper", "same_lines", "ends", "common")


def quality_features(m: dict[str, float], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words, and of the measurements' buckets."""
    buckets = [zlib.crc32(b"%s=%d" % (s.encode(), round(np.log2(m[s] * 128 + 1) * 2))) % FEATURES for s in _STATS]
    buckets.append(zlib.crc32(b"words=%d" % round(np.log2(m["words"] + 1) * 2)) % FEATURES)
    return np.fromiter(map(_HASHES.__getitem__, words), np.int64, len(words)), np.array(buckets)


def weighed(m: dict[str, float], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same as distinct places and their weights: all words together weigh 4, a bucket 0.3."""
    places, buckets = quality_features(m, words)
    at, back = np.unique(np.concatenate([places, buckets]), return_inverse=True)
    return at, np.bincount(back, np.concatenate([np.full(len(places), 4 / max(1, len(places))), np.full(len(buckets), 0.3)]), len(at))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], weight: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression on the probabilities, by full gradients with per-feature step sizes; a row is places, their
    weights and the probability; `weight` is of each row; the last weight found is the intercept."""
    w, seen = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    if not rows:
        return w
    at = np.concatenate([np.append(places, FEATURES) for places, _, _ in rows])
    value = np.concatenate([np.append(weights, 1.0) for _, weights, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(p) + 1 for p, _, _ in rows])
    target, counts = np.array([t for _, _, t in rows]), np.ones(len(rows)) if weight is None else weight / max(weight.mean(), 1e-9)
    for _ in range(STEPS):
        score = np.bincount(row, w[at] * value, len(rows))
        wrong = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - target
        wrong *= counts
        gradient = np.bincount(at, wrong[row] * value, FEATURES + 1) / len(rows) + 1e-6 * w
        seen += gradient**2
        w -= 0.5 * gradient / np.sqrt(seen)
    return w


def telling(rows: list[np.ndarray], p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Whether a feature differs clearly between good and bad documents; rows: the places of each."""
    at = np.concatenate([np.zeros(0, np.int64), *rows])
    row = np.repeat(np.arange(len(rows)), [len(places) for places in rows])
    on_good, on_all = np.bincount(at, (weight * p)[row], FEATURES), np.bincount(at, weight[row], FEATURES)
    n_good, n_all = (weight * p).sum(), weight.sum()
    a, b = on_good + 0.5, on_all - on_good + 0.5
    odds = np.log(a / (n_good + 1)) - np.log(b / (n_all - n_good + 1))
    return (np.abs(odds) > np.maximum(MUCH, CLEARLY * np.sqrt(1 / a + 1 / b))) & (on_all >= OFTEN)


def trained_together(model: LabelModel, patterns: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The toxicity scorer's weights; rows: places of the features of each document of the sample."""
    p, w = model.probability(patterns), np.zeros(FEATURES + 1)
    for _ in range(TOGETHER if len(rows) else 0):
        weight = model.moved(p)
        used = telling(rows, p, weight)
        kept = [places[used[places]] for places in rows]
        w = train([(places, np.ones(len(places)), t) for places, t in zip(kept, p.tolist(), strict=True)], weight)
        said = np.array([w[FEATURES] + w[places].sum() for places in kept])
        p = model.probability(patterns, 1 / (1 + np.exp(-np.clip(said, -50, 50))))
    return w


def _sigmoid(score: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(score, -50, 50))))


class _Marks(dict):
    """A word's features that have a weight; of most words none."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.used = set(np.flatnonzero(w[:-1]).tolist())

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        marks = marks_of(word)
        found = self[word] = () if self.used.isdisjoint(marks) else tuple(self.used.intersection(marks))
        return found


def quality_score(w: np.ndarray, m: dict[str, float], words: list[bytes]) -> float:
    places, buckets = quality_features(m, words)
    return _sigmoid(w[FEATURES] + 0.3 * w[buckets].sum() + (4 * w[places].mean() if len(places) else 0.0))


def toxicity_score(w: np.ndarray, marks: _Marks, words: list[bytes]) -> float:
    found = set().union(*filter(None, map(marks.__getitem__, set(words))))
    return 1 - _sigmoid(w[FEATURES] + w[list(found)].sum()) if found else 1 - _sigmoid(w[FEATURES])


def votes(docs: DataFrame) -> DataFrame:
    """doc_id and the votes for both tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [measure(text)[0] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([t.votes(m) for m in seen], pa.int64()) for t in TASKS]], names=["doc_id", *(t.name for t in TASKS)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, quality long, toxicity long")


def people_votes(labels: DataFrame) -> DataFrame:
    """doc_id and people's votes: one row for each document that has labels (quality 1 is good, toxic 1 is bad)."""
    vote = lambda good: F.when(good > 0.5, GOOD).when(good < 0.5, BAD).otherwise(NONE)
    each = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    return each.select("doc_id", vote(F.col("q")).alias("of_quality"), vote(1 - F.col("t")).alias("of_toxicity"))


def _with_people(rows: DataFrame, people: DataFrame) -> DataFrame:
    """rows with people's votes in both patterns, and whether there are any."""
    joined = rows.join(people, "doc_id", "left").withColumn("labelled", F.col("of_quality").isNotNull())
    for task in TASKS:
        joined = joined.withColumn(task.name, F.col(task.name) + task.people * F.coalesce(f"of_{task.name}", F.lit(NONE)))
    return joined.drop("of_quality", "of_toxicity")


def patterns(docs: DataFrame, people: DataFrame) -> DataFrame:
    """task, pattern and n: how many documents have each pattern of votes. Only votes are joined with people's."""
    each = F.explode(F.array(*[F.struct(F.lit(t.name).alias("task"), F.col(t.name).alias("pattern")) for t in TASKS])).alias("v")
    return _with_people(votes(docs), people).select("labelled", each).groupBy("labelled", "v.task", "v.pattern").agg(F.count("*").alias("n"))


def _place(column: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("weak|"), F.col(column).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def sample(docs: DataFrame, people: DataFrame, n_labelled: int, n_other: int) -> DataFrame:
    """votes and features of about TRAIN_DOCS documents (fewer than that in all but freak cases)."""
    most = 0.95 * TRAIN_DOCS
    share = lambda room, n: int(min(1.0, max(0.0, room) / max(1, n)) * 2**32)
    chosen_people = F.broadcast(people.where(_place("doc_id") < share(most, n_labelled)))  # TRAIN_DOCS rows at most
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    others = plain.where(_place("doc_id") < share(most - n_labelled, n_other)).join(people, "doc_id", "left_anti")
    chosen = plain.join(chosen_people.select("doc_id"), "doc_id", "left_semi").unionByName(others)
    names = ["doc_id", "quality", "toxicity", "places", "weights", "marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                m, words = measure(text)
                places, weights = weighed(m, words)
                marks = np.array(sorted(set().union(*map(marks_of, set(words)))), "<u4")
                out.append((doc_id, *[t.votes(m) for t in TASKS], places.astype("<u4").tobytes(), weights.astype("<f4").tobytes(), marks.tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    found = chosen.mapInArrow(run, "doc_id long, quality long, toxicity long, places binary, weights binary, marks binary")
    return _with_people(found, chosen_people)


@dataclass(frozen=True)
class Classifier:
    labels: dict[str, LabelModel]
    weights: dict[str, np.ndarray]

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame | None = None) -> Classifier:
        """labels: doc_id, quality and toxic (0 or 1) of the documents that people have looked at."""
        spark = docs.sparkSession
        people = people_votes(spark.createDataFrame([], "doc_id long, quality int, toxic int") if labels is None else labels)
        rows = patterns(docs, people).collect()  # at most 2 * (3**11 + 3**7) rows, in practice a few hundred
        if not rows:
            return Classifier({}, {})
        counts: dict[str, dict[int, int]] = {t.name: {} for t in TASKS}
        for r in rows:
            counts[r["task"]][r["pattern"]] = counts[r["task"]].get(r["pattern"], 0) + r["n"]
        made = {t.name: LabelModel.fit(t, counts[t.name]) for t in TASKS}
        n = {labelled: sum(r["n"] for r in rows if r["task"] == "quality" and r["labelled"] == labelled) for labelled in (True, False)}
        some = sorted(sample(docs, people, n[True], n[False]).collect(), key=lambda r: (r["doc_id"], r["places"]))
        ids = lambda blob: np.frombuffer(blob, "<u4").astype(np.int64)
        quality = [(ids(r["places"]), np.frombuffer(r["weights"], "<f4").astype(float), p) for r, p in zip(some, made["quality"].probability(np.array([r["quality"] for r in some], np.int64)).tolist(), strict=True)]
        toxicity = trained_together(made["toxicity"], np.array([r["toxicity"] for r in some], np.int64), [ids(r["marks"]) for r in some])
        return Classifier(made, {"quality": train(quality), "toxicity": toxicity})

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, votes and the label model's probability for quality, the scorers' good and toxic, and keep, which
        the scorers decide."""
        sent = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: Classifier = sent.value
            marks = _Marks(made.weights["toxicity"]) if made.weights else None
            likely = lru_cache(None)(lambda pattern: float(made.labels["quality"].probability(np.int64(pattern + NONE * QUALITY.people))))  # a few hundred patterns
            for batch in batches:
                out = []
                for text in batch.column(1).to_pylist():
                    m, words = measure(text)
                    pattern = QUALITY.votes(m)
                    good, toxic = quality_score(made.weights["quality"], m, words), toxicity_score(made.weights["toxicity"], marks, words)
                    out.append((np.base_repr(pattern, 3).zfill(len(QUALITY.labellers))[::-1], likely(pattern), good, toxic, good >= 0.5 and toxic < 0.5))
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "votes", "label_probability", "good_score", "toxic_score", "keep"])

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, votes string, label_probability double, good_score double, toxic_score double, keep boolean")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Classifier.fit(docs, table(spark, sf_dir, "labels")).score(docs)
