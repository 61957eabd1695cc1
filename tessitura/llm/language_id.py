"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased letters; every run of other characters is one blank. The n-grams of
one to three characters are hashed into `buckets` cells. Training counts cells per language over
a sample of bounded size, and the log-probability matrix (languages x cells) is broadcast.
The language of a text is that of the largest log prior plus sum of its n-grams' log-probabilities.
The texts of an Arrow batch are scored together: their n-grams are the rows of a sparse matrix
(text x cell) in compressed form, which is multiplied with the matrix of log-probabilities.

The score is the posterior of that language, with the evidence scaled to that of at most `EVIDENCE`
n-grams; otherwise it would be 1 for every longer text. It takes no part in the choice.

A null text, or one without a letter, is `und` with score 0. Null languages are never learned.
Without training rows every text is `und`. Ties go to the language first in order. Repeated rows are
scored alike, and count as often as they stand in the training rows. An empty table gives no rows;
other columns, whatever their names, pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import bounded_sample, prepare, remainder

#: Letters of the basic plane, and what stands for every other character.
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)
#: Characters worked on at a time, so that a very long text needs bounded memory.
CHUNK = 1 << 18
#: So many n-grams count in a score at most.
EVIDENCE = 60.0
#: N-grams that one matrix product takes at most, but for those of one piece of a text.
PRODUCT = 1 << 20


def letters_of(text: str) -> np.ndarray:
    """Code points, lower-cased; each run of non-letters is one blank (32)."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = code < 0x10000
    if low.all():
        letter = _LETTER[code]
    else:
        letter = np.empty(len(code), dtype=bool)
        letter[low] = _LETTER[code[low]]
        high, at = np.unique(code[~low], return_inverse=True)
        letter[~low] = np.array([chr(c).isalpha() for c in high])[at]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, code, np.uint32(32))[keep | (np.arange(len(code)) == 0)]


def ngram_cells(letters: np.ndarray, buckets: int, known: int = 0) -> np.ndarray:
    """Cells of all n-grams of 1, 2 and 3 letters, but for single blanks, that end after the first `known` letters."""
    c = letters.astype(np.uint64)
    one = c[known:][letters[known:] != 32]
    c, two_known = c[max(0, known - 2) :], max(0, min(known, 2) - 1)
    two = (c[two_known:-1] << np.uint64(21) | c[two_known + 1 :]) if len(c) > two_known + 1 else c[:0]
    three = (c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]) if len(c) > 2 else c[:0]
    parts = [one + np.uint64(1 << 63), two + np.uint64(1 << 62), three]
    grams = np.concatenate(parts)
    mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def text_cells(text: str, buckets: int):
    """Arrays of cells, a bounded piece of the text at a time; n-grams over the ends of pieces count once."""
    held = np.zeros(0, np.uint32)
    for start in range(0, len(text), CHUNK):
        letters = letters_of(text[start : start + CHUNK])
        if len(held) and held[-1] == 32 and letters[0] == 32:
            letters = letters[1:]
        joined = np.concatenate([held, letters])
        yield ngram_cells(joined, buckets, len(held))
        held = joined[-2:]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class LanguageModel:
    """Broadcastable: languages, log priors, log-probabilities (cells x languages)."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, alpha: float):
        self.langs = langs
        self.prior = np.log((docs + 1.0) / (docs.sum() + len(langs))) if langs else np.zeros(0)
        total = counts.sum(axis=1, keepdims=True) + alpha * counts.shape[1]
        self.table = np.log((counts + alpha) / total).T.astype(np.float32).copy() if langs else np.zeros((1, 0), np.float32)

    def predict(self, texts) -> tuple[list[str], list[float]]:
        """Languages and scores of texts (strings or None)."""
        total, seen = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        known = [bool(self.langs) and bool(t) and has_letter(t) for t in texts]
        rows, cells, held = [], [], 0

        def product():
            """The held rows of the matrix (text x cell) times the matrix of log-probabilities."""
            starts = np.concatenate([[0], np.cumsum([len(c) for c in cells])[:-1]])
            sums = np.add.reduceat(np.take(self.table, np.concatenate(cells), axis=0), starts, axis=0, dtype=np.float64)
            np.add.at(total, rows, sums)
            np.add.at(seen, rows, [len(c) for c in cells])

        for i, t in enumerate(texts):
            for piece in text_cells(t, len(self.table)) if known[i] else ():
                if len(piece):
                    rows.append(i)
                    cells.append(piece)
                    held += len(piece)
                if held > PRODUCT:
                    product()
                    rows, cells, held = [], [], 0
        if rows:
            product()
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if self.langs:
            best = np.argmax(self.prior + total, axis=1)
            scaled = self.prior + total * np.minimum(1.0, EVIDENCE / np.maximum(seen, 1))[:, None]
            top = scaled.max(axis=1)
            share = np.exp(scaled[np.arange(len(texts)), best] - top) / np.exp(scaled - top[:, None]).sum(axis=1) if len(texts) else []
            for i in np.flatnonzero(known):
                langs[i], scores[i] = self.langs[best[i]], float(share[i])
        return langs, scores


def train_language_model(
    rows: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", buckets: int = 1 << 15, alpha: float = 0.1, max_train: int = 20_000
) -> LanguageModel:
    """Counts cells per language in the tasks; the driver gets at most languages x buckets sums.

    `max_train`: about so many documents are used, chosen by a hash of `key`, if there are more.
    """
    prepare(rows.sparkSession)
    chosen = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("g"))
    chosen = bounded_sample(chosen, F.col("k"), max_train).select("t", "g")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for t, g in zip(batch["t"], batch["g"]):
                held = sums.setdefault(g, np.zeros(buckets, np.int64))
                docs[g] = docs.get(g, 0) + 1
                for cells in text_cells(t, buckets):
                    held += np.bincount(cells, minlength=buckets)
        for g, held in sums.items():
            cells = np.flatnonzero(held)
            yield pd.DataFrame({"g": g, "cell": cells, "n": held[cells]})
            yield pd.DataFrame({"g": [g], "cell": [-1], "n": [docs[g]]})

    sums = chosen.mapInPandas(count, "g string, cell long, n long").groupBy("g", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["g"].unique().tolist())
    counts, docs = np.zeros((len(langs), buckets)), np.zeros(len(langs))
    at = sums["g"].map({g: i for i, g in enumerate(langs)}).to_numpy(dtype=np.int64) if len(sums) else np.zeros(0, np.int64)
    cell, n = sums["cell"].to_numpy(dtype=np.int64), sums["n"].to_numpy(dtype=float)
    docs[at[cell < 0]] = n[cell < 0]
    counts[at[cell >= 0], cell[cell >= 0]] = n[cell >= 0]
    return LanguageModel(langs, counts, docs, alpha)


def identify_language(docs: DataFrame, model: LanguageModel, *, text: str = "text", into: str = "language") -> DataFrame:
    """`docs` with a struct column `into`: lang_pred and score (0 to 1)."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = sent.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn(into, predict(F.col(text)))


def language_report(docs: DataFrame, *, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """Learns from the rows outside the held-out fold; per document doc_id, held_out, lang_pred, score."""
    rows = docs.select("doc_id", "text", "lang", (remainder(F.col("doc_id"), folds) == held).alias("held_out"))
    model = train_language_model(rows.where(~F.col("held_out")), **options)
    return identify_language(rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "language.lang_pred", "language.score")
