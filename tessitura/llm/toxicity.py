"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding disguises.

Folding: compatibility forms undone, lower case, marks over letters dropped, look-alike letters of
other alphabets replaced, and digits or signs that stand for letters replaced before a letter, and
at the end of a word if nothing else stands there (`!` and `|` end a sentence, not a word). A text
is then its words (runs of letters), joined by blanks.

The lexicon is learned from labelled documents: a word, or a stem `abc*` that words begin with, is a
candidate if it stands between many different pairs of neighbours in toxic documents (copies of one
document give one pair), and its weight is the log odds of document shares in toxic and clean
documents. A word that several entries match counts once, by the largest weight. Two-word phrases with a
lexicon word that clean documents hold and toxic ones don't are exceptions: hits inside are not
counted. The score is a logistic function of the weight sum and of that sum per 100 words.

Null and empty texts have no hits and get the score of such texts. Without labels of both kinds the
lexicon is empty and the score is the share of toxic labels, 0 without any. A document with several
labels counts as toxic if one says so. Repeated documents are scored alike.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import Stages, bounded_sample, prepare, remainder

WORD = re.compile(r"[^\W\d_]+")
# Letters of other alphabets that look like Latin ones, and what they look like.
LOOKALIKES = dict(zip("аеорсхуіјѕԁһӏκοανρτυιєвмтнкґ", "aeopcxyijsdhlkoavptuiebmthkr"))
# Digits and signs that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
_INSIDE = re.compile("[" + re.escape("".join(STANDS_FOR)) + r"]{1,3}(?=[^\W\d_])")
_AT_END = re.compile(r"(?<=[^\W\d_])[" + re.escape("".join(c for c in STANDS_FOR if c not in "!|")) + r"]{1,3}(?!\w)")
_MARKS = re.compile(r"[\u0300-\u036f]+")
_TABLE = {ord(a): b for a, b in LOOKALIKES.items()}
# Everyday phrases in which a usual lexicon word is harmless.
EXCEPTIONS = ("clown fish", "trash bin", "trash can", "pond scum")


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()).translate(_TABLE)
    text = _INSIDE.sub(_letters, text.lower())
    return _AT_END.sub(_letters, text)


def _letters(found: re.Match) -> str:
    return "".join(STANDS_FOR[c] for c in found.group())


def folded_words(text: str | None) -> list[str]:
    return WORD.findall(fold(text)) if text else []


def entries_of(word: str):
    """The lexicon entries that match a word: itself, and its stems of 4 to 8 letters."""
    yield word
    for n in range(4, min(8, len(word)) + 1):
        yield word[:n] + "*"


class ToxicityModel:
    """Lexicon with weights, exception phrases and the coefficients of the score."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...], share: float):
        self.weights, self.exceptions = weights, exceptions
        self.centre, self.scale = np.zeros(2), np.ones(2)
        self.slopes, self.intercept = np.zeros(2), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def hits(self, words: list[str]) -> list[float]:
        """Weights of the words that the lexicon matches outside exception phrases."""
        if not self.weights or not words:
            return []
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self.automaton.add_word(f" {phrase} ", (len(phrase), None))
            for entry, weight in self.weights.items():
                pattern = f" {entry[:-1]}" if entry.endswith("*") else f" {entry} "
                self.automaton.add_word(pattern, (len(pattern) - 2, weight))
            self.automaton.make_automaton()
        best: dict[int, float] = {}
        covered = []
        for end, (size, weight) in self.automaton.iter(f" {' '.join(words)} "):
            if weight is None:
                covered.append((end - size, end))
            else:
                at = end - size
                best[at] = max(weight, best.get(at, 0.0))
        covered.sort()
        starts, ends = [a - 1 for a, _ in covered], list(accumulate((b for _, b in covered), max))
        before = {at: bisect_right(starts, at) for at in best}
        return [w for at, w in best.items() if not before[at] or ends[before[at] - 1] <= at]

    def features(self, words: list[str]) -> np.ndarray:
        total = sum(self.hits(words))
        return np.log1p([total, 100.0 * total / max(len(words), 20)])

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.1) -> None:
        """Logistic regression by Newton's method."""
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([(x - self.centre) / self.scale, np.ones(len(x))])
        beta = np.zeros(3)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            grad = z.T @ (y - p) - ridge * beta
            beta += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(3), grad)
        self.slopes, self.intercept = beta[:2], float(beta[2])

    def score(self, text: str | None) -> float:
        x = float(self.slopes @ ((self.features(folded_words(text)) - self.centre) / self.scale)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, y) of about `bound` labelled documents at most, chosen by a hash of the id."""
    chosen = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = bounded_sample(chosen, F.col("doc_id"), bound)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")


def train_toxicity(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", max_train: int = 12_000, contexts: int = 6, odds: float = 1.5
) -> ToxicityModel:
    """Learns lexicon, exceptions and score from at most about `max_train` labelled documents, which bound
    the words and phrases as well: all that pass `contexts` and `odds` are taken."""
    stages = Stages(docs.sparkSession)
    rows = stages.write(labelled_sample(docs, labels, label, max_train).repartition(16))
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = sum(v for k, v in n.items() if k == 1), sum(v for k, v in n.items() if k != 1)
    if not bad or not good:
        stages.drop(rows)
        return ToxicityModel({}, EXCEPTIONS, 1.0 if bad else 0.0)

    def neighbours(batches):
        for batch in batches:
            seen = set()
            for text in batch["text"]:
                words = ["", *folded_words(text), ""]
                for a, b, c in zip(words, words[1:], words[2:]):
                    context = zlib.crc32(f"{a} {c}".encode())
                    seen.update((entry, context) for entry in entries_of(b))
            if seen:
                yield pd.DataFrame(list(seen), columns=["word", "context"])

    candidates = (
        rows.where("y = 1").mapInPandas(neighbours, "word string, context long").distinct().groupBy("word").agg(F.count("*").alias("n"))
        .where(F.col("n") >= contexts)
    )
    known = frozenset(r.word for r in candidates.collect())

    def shares(batches):
        for batch in batches:
            count = Counter((w, y == 1) for text, y in zip(batch["text"], batch["y"]) for w in known.intersection(e for b in set(folded_words(text)) for e in entries_of(b)))
            if count:
                yield pd.DataFrame([(w, t, c) for (w, t), c in count.items()], columns=["word", "bad", "n"])

    counts: dict[str, dict[bool, int]] = {}
    for r in rows.mapInPandas(shares, "word string, bad boolean, n long").groupBy("word", "bad").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r.word, {})[r.bad] = r.n
    weights = {w: float(np.log((c.get(True, 0) + 0.5) / (bad + 1)) - np.log((c.get(False, 0) + 0.5) / (good + 1))) for w, c in counts.items()}
    lexicon = {w: weights[w] for w in sorted(weights) if weights[w] >= odds}

    def phrases(batches):
        for batch in batches:
            count: Counter = Counter()
            for text, y in zip(batch["text"], batch["y"]):
                words = folded_words(text)
                count.update({(f"{a} {b}", y == 1) for a, b in zip(words, words[1:]) if not lexicon.keys().isdisjoint((*entries_of(a), *entries_of(b)))})
            if count:
                yield pd.DataFrame([(p, t, c) for (p, t), c in count.items()], columns=["phrase", "bad", "n"])

    kept = rows.mapInPandas(phrases, "phrase string, bad boolean, n long").groupBy("phrase").agg(
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("g")
    )
    learned = [r.phrase for r in kept.where("b = 0 and g >= 5").orderBy("phrase").collect()]
    model = ToxicityModel(lexicon, (*EXCEPTIONS, *learned), bad / (bad + good))

    def features(batches):
        for batch in batches:
            x = np.array([model.features(folded_words(t)) for t in batch["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": (batch["y"] == 1).astype(float)})

    table = rows.mapInPandas(features, "a double, b double, y double").toPandas()
    model.fit(table[["a", "b"]].to_numpy(), table["y"].to_numpy())
    stages.drop(rows)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text: str = "text", into: str = "toxicity") -> DataFrame:
    """`docs` with a column `into`: the score from 0 to 1."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) for t in texts], dtype=float)

    return docs.withColumn(into, score(F.col(text)))


def toxicity_report(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, limit: float = 0.5, **options) -> DataFrame:
    """Learns from the rows outside the held-out fold; per document doc_id, held_out, score, predicted."""
    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id"), folds) == held).alias("held_out"))
    open_labels = labels.where(remainder(F.col("doc_id"), folds) != held)
    model = train_toxicity(rows, open_labels, **options)
    scored = score_toxicity(rows, model, into="score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= limit).cast("int").alias("predicted"))
