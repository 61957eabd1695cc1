"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Every text becomes statistics of its characters, words and lines. Standardised and mapped by random
cosines they approximate a Gaussian kernel. Each partition sums its share of the normal equations of
a ridge regression on the label; the sums are added and solved. On training rows that the regression
has not seen, isotonic regression turns its output into probabilities.

Null and empty texts have statistics of zeros and a score like any other. Without labels of both
kinds the score is the share of the label 1, 0 without any. A document with several labels counts as
1 if one says so. Repeated documents are scored alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import Stages, bounded_sample, prepare, remainder

_KIND = np.zeros(256, np.int64)  # 0 other sign, 1 lower, 2 upper, 3 digit, 4 blank, 5 sentence sign, 6 line end, 7 not ASCII
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[32, 9]] = 4
_KIND[[ord(c) for c in ".,;:?'\""]] = 5
_KIND[[10, 13]] = 6
_KIND[128:] = 7
SIZE = 20


def text_statistics(text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(SIZE)
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=histogram, minlength=8) / n
    share = histogram[histogram > 0] / n
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    different = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split("\n")
    return np.array(
        [
            np.log1p(n),
            np.log1p(len(words)),
            *kinds,
            -(share * np.log(share)).sum(),
            lengths.mean(),
            lengths.std(),
            different / m,
            np.log1p(different) / np.log1p(m),
            again / m,
            sum(map(str.isupper, words)) / m,
            sum(not w[-1].isalnum() for w in words) / m,
            1 - len(set(lines)) / len(lines),
            np.log1p(len(lines)),
        ]
    )


class QualityModel:
    """Standardisation, random cosines, ridge weights and the calibration curve."""

    def __init__(self, share: float, cosines: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.share = share
        self.centre, self.scale = np.zeros(SIZE), np.ones(SIZE)
        self.directions = rng.standard_normal((SIZE, cosines)) * np.sqrt(1.0 / SIZE)
        self.phases = rng.random(cosines) * 2 * np.pi
        self.weights: np.ndarray | None = None
        self.curve: tuple[np.ndarray, np.ndarray] | None = None

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -5, 5)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.column_stack([waves, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.raw(x), *self.curve), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the non-decreasing curve nearest to y over x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, sum of y, weight
    for a, b in zip(x[order], y[order]):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def with_statistics(docs: DataFrame, *, text: str = "text", into: str = "statistics") -> DataFrame:
    prepare(docs.sparkSession)

    @pandas_udf("array<double>")
    def statistics(texts: pd.Series) -> pd.Series:
        return pd.Series([text_statistics(t) for t in texts], dtype=object)

    return docs.withColumn(into, statistics(F.col(text)))


def train_quality(statistics: DataFrame, labels: DataFrame, *, label: str = "quality", max_train: int = 40_000, ridge: float = 1.0, parts: int = 8) -> QualityModel:
    """Learns from (doc_id, statistics) and labels; at most about `max_train` labelled documents,
    chosen by a hash of the id, in `parts` partitions. The driver gets the sums of each part."""
    chosen = bounded_sample(labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y")), F.col("doc_id"), max_train)
    rows = statistics.select("doc_id", "statistics").join(F.broadcast(chosen), "doc_id")
    held = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("c")).cast("binary")) % 3 == 0
    stages = Stages(statistics.sparkSession)
    rows = stages.write(rows.select("statistics", (F.col("y") == 1).cast("double").alias("y"), held.alias("held")).repartition(parts))

    def moments(batches):
        s = np.zeros((3, SIZE))
        y = 0.0
        for batch in batches:
            x = np.stack(batch["statistics"]) if len(batch) else np.zeros((0, SIZE))
            s += [np.full(SIZE, len(x)), x.sum(axis=0), (x * x).sum(axis=0)]
            y += batch["y"].sum()
        yield pd.DataFrame({"n": [s[0].tolist()], "s": [s[1].tolist()], "q": [s[2].tolist()], "y": [y]})

    sums = rows.mapInPandas(moments, "n array<double>, s array<double>, q array<double>, y double").toPandas()
    n = np.stack(sums["n"]).sum(axis=0) if len(sums) else np.zeros(SIZE)
    ones = sums["y"].sum() if len(sums) else 0.0
    if n[0] < 10 or ones in (0.0, n[0]):
        stages.drop(rows)
        return QualityModel(float(ones / n[0]) if n[0] else 0.0)
    model = QualityModel(float(ones / n[0]))
    model.centre = np.stack(sums["s"]).sum(axis=0) / n
    model.scale = np.sqrt(np.maximum(np.stack(sums["q"]).sum(axis=0) / n - model.centre**2, 1e-12)) + 1e-6
    width = len(model.phases) + 1
    balance = (n[0] - ones) / ones

    def equations(batches):
        a, b = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            if len(batch):
                z, y = model.fourier(np.stack(batch["statistics"])), batch["y"].to_numpy()
                w = np.where(y == 1, balance, 1.0)
                a += (z * w[:, None]).T @ z
                b += (z * w[:, None]).T @ (2 * y - 1)
        yield pd.DataFrame({"a": [a.ravel().tolist()], "b": [b.tolist()]})

    parts_sums = rows.where("not held").mapInPandas(equations, "a array<double>, b array<double>").toPandas()
    a = sum(np.array(v) for v in parts_sums["a"]).reshape(width, width)
    model.weights = np.linalg.solve(a + ridge * np.eye(width), sum(np.array(v) for v in parts_sums["b"]))

    def outputs(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"r": model.raw(np.stack(batch["statistics"])), "y": batch["y"]})

    seen = rows.where("held").mapInPandas(outputs, "r double, y double").toPandas().sort_values(["r", "y"])
    model.curve = isotonic(seen["r"].to_numpy(), seen["y"].to_numpy()) if len(seen) else (np.array([-1.0, 1.0]), np.array([0.0, 1.0]))
    stages.drop(rows)
    return model


def score_quality(statistics: DataFrame, model: QualityModel, *, into: str = "score") -> DataFrame:
    """Rows with a column `statistics` and a column `into`: the score from 0 to 1."""
    sent = statistics.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(np.stack(x)) if len(x) else [], dtype=float)

    return statistics.withColumn(into, score(F.col("statistics")))


def quality_report(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2, limit: float = 0.7, **options) -> DataFrame:
    """Learns from the rows outside the held-out fold; per document doc_id, held_out, score, predicted."""
    stages = Stages(docs.sparkSession)
    rows = stages.write(with_statistics(docs.select("doc_id", "text")).select("doc_id", "statistics"))
    model = train_quality(rows, labels.where(remainder(F.col("doc_id"), folds) != held), **options)
    scored = score_quality(rows, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
