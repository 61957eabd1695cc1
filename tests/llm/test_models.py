"""Classifiers on held-out rows, search against brute force, the pipeline against a plain one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessitura.llm import ann, language_id, pipeline_stages, quality, toxicity

from .conftest import documents, prose

TEXTS = {"en": "the quick brown fox and the lazy dog which were running through", "de": "der schnelle braune fuchs und die faulen hunde welche durch das", "fr": "le renard brun rapide et les chiens paresseux qui étaient dans"}


def test_language(spark, rng):
    docs = []
    for i in range(150):
        lang = rng.choice(list(TEXTS))
        docs.append((i, " ".join(rng.choices(TEXTS[lang].split(), k=rng.randrange(4, 40))), lang if i % 9 else None, "s"))
    docs += [(900, None, "en", "s"), (901, "12 !! ..", "en", "s"), (902, "", None, "s")]
    out = {r.doc_id: r for r in language_id.language_report(documents(spark, docs), buckets=1 << 12).collect()}
    held = [(out[d].lang_pred, lang) for d, _, lang, _ in docs[:150] if lang and out[d].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert {out[d].lang_pred for d in (900, 901, 902)} == {"und"} and all(0 <= r.score <= 1 for r in out.values())
    assert language_id.language_report(documents(spark, docs[-2:])).count() == 2


def labelled(spark, rng, bad):
    docs, labels = [], []
    for i in range(400):
        y = int(i % 4 == 0)
        text = prose(rng, rng.randrange(20, 60))
        docs.append((i, bad(text, rng) if y else text))
        labels.append((i, 1 - y, y))
    docs += [(900, None), (901, ""), (None, prose(rng, 9))]
    frame = spark.createDataFrame([*labels, (1, None, None), (5000, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    return documents(spark, docs), frame


def test_quality(spark, rng):
    docs, labels = labelled(spark, rng, lambda t, r: t.upper().replace(" ", "!! "))
    out = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    held = [(r.predicted, int(d % 4 != 0)) for d, r in out.items() if d is not None and d < 400 and r.held_out]
    assert len(out) == 403 and sum(a == b for a, b in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in out.values())
    assert {r.score for r in quality.quality_report(docs, labels.limit(0)).collect()} == {0.0}
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert list(y) == [0.0, 0.5, 1.0] and list(x) == [1.0, 2.5, 4.0]


def test_toxicity(spark, rng):
    def insult(text, r):
        words = text.split()
        for _ in range(4):
            words.insert(r.randrange(len(words)), r.choice(["moron", "m0r0n", "IDIOT!!", "мoron"]))
        return " ".join(words)

    docs, labels = labelled(spark, rng, insult)
    out = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    held = [(r.predicted, int(d % 4 == 0)) for d, r in out.items() if d is not None and d < 400 and r.held_out]
    assert len(out) == 403 and sum(a == b for a, b in held) >= 0.97 * len(held) and out[901].predicted == 0
    assert {r.score for r in toxicity.toxicity_report(docs, labels.limit(0)).collect()} < {0.0, 1e-6, *[r.score for r in toxicity.toxicity_report(docs, labels.limit(0)).collect()]}
    model = toxicity.ToxicityModel({"idiot": 2.0, "moron*": 1.0, "trash": 1.0}, ("trash can",), 0.5)
    assert model.hits(toxicity.folded_words("1d10t, morons! a trash can; TRASH")) == [2.0, 1.0, 1.0]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 24))
    x[:60] = x[0]
    x[100:140] = x[100] + 0.05 * rng.standard_normal((40, 24))
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    bad = [(1000, None, 1), (1020, [0.0] * 24, 1), (1040, [float("nan")] * 24, 1), (1060, [1.0, None], 1), (None, x[3].tolist(), 1), (1080, [], 1)]
    frame = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label int").withColumn("e", F.lit(1))
    out = ann.nearest_neighbours(frame, frame.where(F.col("vec_id") % 20 == 0), k=10, block=256, query_block=32).collect()
    exact = np.array([r[1] for r in rows], dtype=np.float64)
    hits = []
    for q in range(0, 900, 20):
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        score = exact @ exact[q]
        order = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:10]
        assert [r["rank"] for r in mine] == list(range(1, 11)) and q not in [r.vec_id for r in mine]
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in mine)
        hits.append(len({r.vec_id for r in mine} & set(order)) / 10)
        if q < 60:
            assert [r.vec_id for r in mine] == order
    assert np.mean(hits) >= 0.9 and len(out) == 450
    assert ann.nearest_neighbours(frame.limit(0), frame.limit(0)).count() == 0
    few = frame.where("vec_id in (0, 200, 300)")
    assert ann.nearest_neighbours(few, few.where("vec_id = 0"), reach=1.0).count() == 2


def test_neighbours_outside_tight_groups(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 24))
    for g in range(100, 700, 200):
        x[g : g + 200] = x[g] + 0.001 * rng.standard_normal((200, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = [*range(0, 100, 5), 100, 320, 680]
    out = ann.nearest_neighbours(frame, frame.where(F.col("vec_id").isin(asked))).collect()
    for q in asked:
        mine = {r.vec_id for r in out if r.query_id == q}
        order = [i for i in np.argsort(-(x @ x[q])) if i != q][:20]
        assert len(mine) == 20 and len(mine & set(order)) >= 16, q
    few = frame.where("vec_id in (0, 20, 30)")
    for q in (0, 20, 30):
        assert sorted(r.vec_id for r in ann.nearest_neighbours(few, few.where(F.col("vec_id") == q)).collect()) == sorted({0, 20, 30} - {q})


def test_pipeline(spark, rng, tmp_path):
    item = prose(rng, 20)
    good = [prose(rng, 60) for _ in range(40)]
    docs = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(good)]
    docs += [(100, good[0], "en", "s0"), (101, good[1] + " tail9", "en", "s1"), (102, "12 34", "en", "s0"), (103, None, None, None), (104, prose(rng, 30) + " " + item + " " + prose(rng, 3), "en", "s2")]
    secret = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    docs += [(105 + i, f'{prose(rng, 40)} token = "{secret[i:]}{i:04d}" {prose(rng, 4)}', "en", "s1") for i in range(4)]
    documents(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept.append({r.doc_id for r in frame.select("doc_id").collect()})
    everything = {d for d, *_ in docs}
    assert kept[0] == everything - {102, 103} and kept[1] == kept[0] - {100, 101} and kept[2] == kept[1] - {104} and kept[3] == kept[4] == kept[2]
    redacted = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "stage3")).collect()}
    assert all("<secret>" in redacted[105 + i] for i in range(4)) and all(redacted[i] == good[i] for i in range(40))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == kept[4] and "taken" in out.columns and corpus_pipeline.ORACLE_SQL is None


def test_near_duplicate_stage(spark, rng):
    base = [prose(rng, 100) for _ in range(40)]
    docs = list(enumerate(base))
    docs += [(100 + i, f"{t} {prose(rng, 10 + i)}") for i, t in enumerate(base[:25])]
    for i, t in enumerate(base[25:]):
        w = t.split()
        for at in rng.sample(range(100), 1 + i % 5):
            w[at] = "changed"
        docs.append((200 + i, " ".join(w)))
    shingles = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in docs)}
    group = {d: d for d in shingles}
    for a in shingles:
        for b in shingles:
            if a < b and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    kept = {r.doc_id for r in pipeline_stages.keep_one_of_each_group(spark, documents(spark, docs), "").collect()}
    assert kept == set(group.values()) and 45 < len(kept) < 70


def test_large_lexicon(spark):
    """Every word that the labelled documents show as toxic is in the lexicon, however many there are."""
    import itertools
    import random

    rng = random.Random(4)
    words = ["".join(w) for w in itertools.islice(itertools.product("bcdfg", "aeiou", "klmnp", "aeiou", "rstvz"), 2_300)]
    clean = ["one", "two", "six", "ten", "day", "sun"]
    toxic = [" ".join(f"{rng.choice(clean)} {w} {rng.choice(clean)}" for w in rng.sample(words, 460)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(toxic)] + [(100 + i, " ".join(rng.choice(clean) for _ in range(400))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train_toxicity(documents(spark, rows), labels)
    assert len({w for w in model.weights if w in set(words)}) > 2_000


def plain_grams(text):
    """All n-grams of 1, 2 and 3 letters, runs of other signs as one blank, single blanks left out."""
    signs = []
    for i, c in enumerate(text.lower()):
        if c.isalpha():
            signs.append(c)
        elif i == 0 or signs[-1] != " ":
            signs.append(" ")
    s = "".join(signs)
    return [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != " "]


def test_language_against_plain_bayes(spark, rng):
    """Choice and score of multinomial naive Bayes with counts in dictionaries."""
    import math
    from collections import Counter

    signs = {"a1": "abcdeé ", "b2": "cdefgh ", "c3": "aghijk -"}
    rows = [(i, "".join(rng.choice(signs[g]) for _ in range(rng.randrange(1, 80))), g) for i in range(90) for g in [rng.choice(sorted(signs))]]
    rows += [(100, None, "a1"), (101, "abc", None), (102, "12 !", "b2"), (103, "ÀB", "c3")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train_language_model(frame, buckets=1 << 20, alpha=0.1)
    counts, docs = {g: Counter() for g in signs}, Counter()
    for _, t, g in rows:
        if t is not None and g is not None:
            counts[g].update(plain_grams(t))
            docs[g] += 1
    texts = [t for _, t, _ in rows if t and any(map(str.isalpha, t))] + ["ab", "gh gh", "é"]
    langs, scores = model.predict(texts)
    for t, lang, score in zip(texts, langs, scores):
        grams = plain_grams(t)
        prior = {g: math.log((docs[g] + 1) / (sum(docs.values()) + 3)) for g in signs}
        evidence = {g: sum(math.log((counts[g][x] + 0.1) / (sum(counts[g].values()) + 0.1 * (1 << 20))) for x in grams) for g in signs}
        best = max(signs, key=lambda g: prior[g] + evidence[g])
        scaled = {g: prior[g] + evidence[g] * min(1, 60 / len(grams)) for g in signs}
        share = math.exp(scaled[best]) / sum(map(math.exp, scaled.values()))
        assert lang == best and abs(score - share) < 1e-4, t


def test_toxic_weights_against_plain_counts(spark, rng):
    """Log odds of document shares, counted document by document."""
    import math

    clean = "one two three four five six seven".split()
    rows = [(i, " ".join(rng.choice(clean + ["vile"] * (i < 25) + ["mean"] * (i % 3 == 0)) for _ in range(30))) for i in range(60)]
    labels = {i: int(i < 25) for i, _ in rows}
    model = toxicity.train_toxicity(documents(spark, rows), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), odds=0.5)
    bad, good = 25, 35
    words = {w for _, t in rows for w in t.split()}
    expected = {}
    for word in words:
        for entry in toxicity.entries_of(word):
            inside = [i for i, t in rows if any(w == entry or (entry.endswith("*") and w.startswith(entry[:-1])) for w in t.split())]
            b = sum(labels[i] for i in inside)
            weight = math.log((b + 0.5) / (bad + 1)) - math.log((len(inside) - b + 0.5) / (good + 1))
            if weight >= 0.5:
                expected[entry] = weight
    assert set(model.weights) == set(expected) and all(abs(model.weights[e] - w) < 1e-9 for e, w in expected.items()) and "vile" in expected
