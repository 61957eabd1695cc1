"""Secret candidates and the forest on reviewed findings that it has not seen."""

from __future__ import annotations

import time

import pytest

from tessitura.llm import findings, secret_scan

from .conftest import documents, prose


def test_nothing_to_find(spark, rng):
    plain = documents(spark, [(1, "plain words only"), (1, "plain words only"), (None, None), (3, "")])
    model = secret_scan.train_secret_model(plain)
    out = secret_scan.scan_secrets(plain, model).collect()
    assert len(out) == 4 and all(r.secrets.n_candidates == 0 and r.secrets.redacted == r.text for r in out)
    none = spark.createDataFrame([], "value string, before string, after string, path string, label int")
    assert secret_scan.train_secret_model(plain, none).scores([("a" * 20, "", "", None)]).tolist() == [0.0]
    assert secret_scan.secret_report(plain.limit(0)).count() == 0


def test_held_out_lines():
    """Every fourth reviewed line is kept from the forest in turn."""
    hit = wrong = missed = 0
    for fold in range(4):
        model = secret_scan.SecretModel(secret_scan.RandomForest(), [w for w in (*findings.FILLER, *findings.NAMES) if len(w) > 3])
        secret_scan.fit_findings(model, secret_scan.reviewed_findings(lambda n: n % 4 != fold))
        held = secret_scan.reviewed_findings(lambda n: n % 4 == fold)
        for label, score in zip(held["label"], model.scores(list(held[["value", "before", "after", "path"]].itertuples(index=False, name=None)))):
            hit += int(label == 1 and score >= 0.5)
            wrong += int(label == 0 and score >= 0.5)
            missed += int(label == 1 and score < 0.5)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


def test_given_findings(spark, rng):
    """A table of findings is learned from, whatever the library's own ones say."""
    rows = [(f"zz{i}k" * 6, "ticket :", "", "s1", 1) for i in range(40)] + [(f"zz{i}k" * 6, "token =", "", "s1", 0) for i in range(40)] + [(None, "", "", "", 1), ("x", None, None, None, None)]
    table = spark.createDataFrame(rows, "value string, before string, after string, path string, label int")
    model = secret_scan.train_secret_model(documents(spark, [(1, prose(rng, 5))]), table, max_findings=60)
    assert model.scores([("zz9k" * 6, "ticket :", "", "s1")])[0] > 0.5 > model.scores([("zz9k" * 6, "token =", "", "s1")])[0]


@pytest.mark.parametrize("line", ['password = "hunter2!pass"', "DB_PASSWORD=hunter2!pass # x", "pwd: 'hunter2!pass'", "secret=hunter2!pass."])
def test_signs_in_values(line):
    assert [c[2] for c in secret_scan.candidates(line)] == ["hunter2!pass"]


def test_blocks_and_runs():
    block = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(["aB3/" * 16] * 4) + "\n-----END RSA PRIVATE KEY-----"
    assert [c[2] for c in secret_scan.candidates(f"key:\n{block}\nend")] == [block]
    assert list(secret_scan.candidates("verylongidentifiername.foo1")) == []


@pytest.mark.parametrize("piece", ["a.b.", "key=abc", "x", "://a:bbbbbbbb", 'key="', "-----BEGIN KEY-----", ":='\"", "password: ", "=", "aaaaaaaaaaaaaaaaaaaaa=", "key:...."])
def test_time_is_linear(piece):
    times = []
    for size in (100_000, 1_000_000):
        text, began = piece * (size // len(piece)), time.process_time()
        sum(1 for _ in secret_scan.candidates(text))
        times.append(time.process_time() - began)
    assert times[1] < max(1.0, 30 * times[0])


def test_long_values_count_whole():
    """What follows the first few thousand signs of a value is part of its statistics."""
    start = "a" * 5_000
    plain, other = (secret_scan.finding_features(start + end, "", "", None, None) for end in ("a" * 5_000, "A1" * 2_500))
    assert plain[0] == other[0] == 10_000 and plain[1] == 0 and other[1] == other[3] == 0.25
