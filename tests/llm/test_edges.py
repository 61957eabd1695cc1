"""Very long texts, ties, repeated rows, null ids, empty tables, and parts of operators against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessitura.llm import ann, decontaminate, jaccard_join, language_id, license_scan, quality, suffix_dedup, toxicity

from .conftest import documents, prose
from .test_dedup import brute_components, brute_spans
from .test_scans import words


def test_factors_against_brute_force():
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 99, 300).tolist())
    length, n = 20, 281
    array = np.frombuffer(data, np.uint8)
    levels = suffix_dedup.prefix_ranks(array, length)
    order = np.lexsort((np.arange(n), levels[-1][1][:n]))
    shared = np.concatenate([[0], suffix_dedup.common_prefixes(array, levels, order[:-1], order[1:], length)])
    previous, following = suffix_dedup.longest_factors(order, shared)

    def common(a, b):
        return next((k for k in range(length) if data[a + k] != data[b + k]), length)

    for at, p, f in zip(order, previous, following):
        assert p == max((common(at, i) for i in range(at)), default=0)
        assert f == max((common(at, i) for i in range(at + 1, n)), default=0)


def test_long_text_and_text_ids(spark, rng):
    long = prose(rng, 60_000)
    rows = [("a", long), ("b", prose(rng, 40) + long[1000:1300]), ("b", "x" * 700), (None, "x" * 300)]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    out = suffix_dedup.remove_repeats(frame, keep="none").collect()
    cover = brute_spans([t.encode() for _, t in rows], 200, False)
    assert sorted((r.n_bytes, r.n_removed) for r in out) == sorted((len(t), int(c.sum())) for (_, t), c in zip(rows, cover))
    first = {r.n_bytes: r.n_removed for r in suffix_dedup.remove_repeats(frame, keep="first").collect()}
    assert sum(first.values()) < sum(r.n_removed for r in out)
    joined = jaccard_join.jaccard_components(spark.createDataFrame([("k", long), ("c", long + " end"), ("z", "one"), (None, long)], "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.component_id) for r in joined) == [("", "c"), ("c", "c"), ("k", "c"), ("z", "z")]


def test_hot_bucket_in_blocks(spark, rng):
    """Many sets that share half of their shingles, in blocks of eight and without the map of signatures."""
    common = prose(rng, 30)
    rows = [(i, f"{common} {prose(rng, 20)}") for i in range(60)]
    rows += [(100 + i, f"{common} {rows[i][1].split(' ', 30)[30]} z") for i in range(0, 60, 3)]
    for options in ({"block": 8}, {"most_bits": 0}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, rows), **options).collect()}
        assert got == brute_components(rows, 85)


def test_blocks_compare_each_pair_once():
    seen = []
    for i, j in ((0, 0), (0, 1), (1, 1)):
        members = [m for m in range(8) if m % 2 in (i, j)]
        maps = [jaccard_join.parity_map(np.arange(20, dtype=np.uint64) << np.uint64(7)) for _ in members]
        seen += jaccard_join.near_in_block(5, i, j, members, members, [20] * len(members), maps, [None] * len(members), [m % 2 for m in members], 85, False)
    assert len(seen) == len(set(seen)) == 28


def test_language_pieces_and_signs(monkeypatch):
    text = "Ab, c\U0001f600d!! Ünï  x" * 9 + "\U00020000\u4e2d."
    whole = np.sort(np.concatenate(list(language_id.text_cells(text, 1 << 12))))
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(language_id, "CHUNK", size)
        assert (np.sort(np.concatenate(list(language_id.text_cells(text, 1 << 12)))) == whole).all()
    monkeypatch.undo()
    assert language_id.letters_of("a\U0001f600b").tolist() == [97, 32, 98] and len(language_id.letters_of("\U00020000")) == 1
    counts = np.random.default_rng(0).integers(0, 50, (3, 1 << 12)).astype(float)
    model = language_id.LanguageModel(["a", "b", "c"], counts, np.array([50.0, 3, 1]), 0.1)
    texts = [text, None, "", "12", "z", text * 50, "\U0001f600"]
    together = model.predict(texts)
    assert together == tuple(map(list, zip(*((p[0][0], p[1][0]) for p in (model.predict([t]) for t in texts)))))
    total = model.prior + sum(model.table[c].sum(axis=0, dtype=np.float64) for c in language_id.text_cells(text, 1 << 12))
    assert together[0][0] == "abc"[int(np.argmax(total))] and together[0][1:4] == ["und"] * 3 and together[0][6] == "und"
    equal = language_id.LanguageModel(["x", "y"], np.ones((2, 64)), np.ones(2), 0.1)
    assert equal.predict(["tie"])[0] == ["x"]


@pytest.mark.parametrize("written", ["IDIOT", "𝐈𝐃𝐈𝐎𝐓", "ìdîot", "ｉｄｉｏｔ", "1d10t", "idi0t!", "ІDІОТ", "i\u0301diot"])
def test_folding(written):
    assert toxicity.folded_words(f"you {written} there!!") == ["you", "idiot", "there"]


def test_hits_in_long_texts(rng):
    model = toxicity.ToxicityModel({"trash": 1.0, "idio*": 2.0}, ("trash can", "can do", "big trash can do"), 0.5)
    assert len(model.hits(["trash", "can", "trash"] * 100_000)) == 100_000
    for _ in range(200):
        text = [rng.choice(("big", "trash", "can", "do", "idiots")) for _ in range(12)]
        line = f" {' '.join(text)} "
        spans = [(at, at + len(p) + 1) for p in model.exceptions for at in range(len(line)) if line.startswith(f" {p} ", at)]
        at, right = 0, []
        for w in text:
            weight = {"trash": 1.0, "idiots": 2.0}.get(w)
            if weight and not any(a <= at < b for a, b in spans):
                right.append(weight)
            at += len(w) + 1
        assert model.hits(text) == right


def test_folding_at_the_end():
    assert toxicity.folded_words("a55 bad! 10 x2y c4ts") == ["ass", "bad", "x", "y", "cats"]


def test_decontamination_by_join(spark, rng):
    items = [(i, prose(rng, n)) for i, n in enumerate((30, 12, 10, 4, 1))] + [(None, prose(rng, 15)), (7, None), (8, "!!"), (1, prose(rng, 11)), (2, "Été déjà vu " * 4)]
    docs = [(i, prose(rng, 40)) for i in range(5)] + [(20 + i, f"{prose(rng, 9)}, {t or ''}! {prose(rng, 3)} {t}") for i, (_, t) in enumerate(items)]
    docs += [(90, None), (91, ""), (20, docs[5][1]), (None, docs[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(spark, docs).withColumn("windows", F.lit(1)).withColumn("text_key", F.lit(2))
    by_search = decontaminate.contamination_report(frame, bench).collect()
    assert sorted(map(str, by_search)) == sorted(map(str, decontaminate.contamination_report(frame, bench, search_words=0).collect()))
    assert {"windows", "text_key", "hits", "rid"} <= set(decontaminate.mark_contaminated(frame, bench, search_words=0).columns)
    assert decontaminate.contamination_report(frame.limit(0), bench).count() == 0


def test_licence_places_against_every_start(spark, rng):
    """All acceptable places of all templates, tried one by one, give the same labels."""
    texts = [t for _, t, _ in license_scan.TEMPLATES]
    docs = [(i, f"{prose(rng, 9)} {t} {prose(rng, 9)}") for i, t in enumerate(texts)]
    for i, t in enumerate(texts):  # words changed and left out
        w = t.split()
        for at in rng.sample(range(len(w)), max(1, len(w) // 6)):
            w[at] = "changed"
        docs.append((100 + i, " ".join(w)))
    docs += [(200, " ".join(f"{prose(rng, 20)} {t}" for t in texts)), (201, None), (202, "mit license " * 300), (200, "again")]
    frame = documents(spark, docs)
    index = license_scan.TemplateIndex(license_scan.licence_word_idf(frame))
    got = sorted((r.doc_id, r.labels) for r in license_scan.license_report(frame).collect())
    want = []
    for d, t in docs:
        w = [x.encode() for x in words(t)]
        found = {label for _, label in index.base(w)}
        for k, (label, template, keys) in enumerate(index.templates):
            for start in range(-len(template), len(w)):
                if label not in found and index.share(w, k, start, 1) >= 0.7 and all(index.stands(w, key, start - 1, start + len(template) + 1) for key in keys):
                    found.add(label)
        want.append((d, ",".join(sorted(found))))
    assert got == sorted(want) and dict(got[-3:-1])[201] == ""
    many = next(r for r in license_scan.license_report(frame).collect() if r.doc_id == 200 and r.n_words > 5)
    assert set(many.labels.split(",")) == {label for label, _, _ in license_scan.TEMPLATES}


def test_neighbour_lengths_ties_and_repeats(spark):
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2), 0.001 * i]) for i in range(60)] + [(100 + i, [1.0, i + 1.0]) for i in range(4)] + [(5, [0.0, 0.0, 1.0, 0.005])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest_neighbours(frame, frame.where("vec_id in (3, 100)"), k=5)
    got = {q: [(r.vec_id, r.score) for r in sorted(out.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in (3, 100)}
    assert [v for v, _ in got[100]] == [103, 102, 101] and len(got[3]) == 5
    # 300 different vectors, all at the same inner product with the query
    flat = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)] + [(1000, [2.0, 0.0])], "vec_id long, embedding array<double>")
    tied = ann.nearest_neighbours(flat, flat.where("vec_id = 1000"), k=20).orderBy("rank").collect()
    assert [r.vec_id for r in tied] == list(range(20))


def test_empty_tables(spark, rng):
    none = documents(spark, [(1, "a")]).limit(0)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert language_id.language_report(none).count() == quality.quality_report(none, labels).count() == toxicity.toxicity_report(none, labels).count() == 0
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert ann.nearest_neighbours(vectors, vectors.limit(0)).count() == 0


def test_repeated_rows_are_scored_alike(spark, rng):
    docs = documents(spark, [(i % 20, prose(rng, 20) if i < 40 else "same text here") for i in range(80)] + [(500, "word " * 400_000)] * 2)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] * 2, "doc_id long, quality int, toxic int")
    for report in (language_id.language_report(docs), quality.quality_report(docs, labels), toxicity.toxicity_report(docs, labels), license_scan.license_report(docs)):
        rows = [r for r in report.collect()]
        long = [str(r) for r in rows if r.doc_id == 500]
        assert len(rows) == 82 and len(long) == 2 and long[0] == long[1]


def test_pipeline_keeps_what_it_should(spark, rng, tmp_path):
    """Repeated and null ids, an extra column, clashing names and no candidates for secrets."""
    texts = [prose(rng, 60) for _ in range(6)]
    rows = [(1, texts[0], "x1"), (1, texts[1], "x2"), (None, texts[2], "x3"), (None, texts[3], "x4"), (5, texts[4], "x5"), (5, texts[4], "x5"), (6, texts[4], "x6"), (None, texts[5], "x7"), (None, texts[5], "x7"), (9, "12 34", "x8"), (10, None, "x9")]
    frame = spark.createDataFrame([(d, t, "en", f"s{i % 2}", len(t or ""), x, i, 1.5) for i, (d, t, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, seen string, size int, `a.b` double")
    frame = frame.withColumn("size", F.lit(3))
    frame.where("seen <> 'x5'").unionByName(frame.where("seen = 'x5'").withColumn("source", F.lit("s0"))).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such words here at all my friend of old days")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.seen for r in out) == ["x1", "x2", "x3", "x4", "x5", "x7"]
    assert {r.text for r in out} == set(texts) and {"seen", "size", "a.b", "size_", "taken", "rate"} <= set(out[0].asDict()) and all(0 <= r.taken <= 2 * r.size_ for r in out)
    frame.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
