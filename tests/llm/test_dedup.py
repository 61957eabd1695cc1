"""Substring deduplication and the Jaccard join against brute force."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tessitura.llm import jaccard_join, suffix_dedup

from .conftest import documents, prose


def brute_spans(texts, length, keep_first):
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].append((d, i))
    cover = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places[1:] if keep_first else places:
                cover[d][i : i + length] = True
    return cover


@pytest.mark.parametrize("keep,split", [("none", 4096), ("first", 4096), ("none", 2), ("first", 2)])
def test_remove_repeats(spark, rng, keep, split):
    shared = prose(rng, 14)
    rows = [(i, f"{prose(rng, 8)} {shared} {prose(rng, 8)}") for i in range(6)]
    rows += [(10, rows[0][1]), (11, "z" * 150), (12, None), (13, ""), (14, "né " * 40), (15, shared + shared), (16, shared[:47]), (17, rows[1][1][20:90] + "é" + prose(rng, 5)), (18, prose(rng, 400))]
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(documents(spark, rows), length=48, keep=keep, split=split).collect()}
    texts = [(t or "").encode() for _, t in rows]
    assert len(out) == len(rows)
    for (doc_id, _), t, cover in zip(rows, texts, brute_spans(texts, 48, keep == "first")):
        kept = bytes(b for b, c in zip(t, cover) if not c)
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        r = out[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), int(cover.sum()), runs), doc_id
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and bytes(r.kept) == kept


def test_repeated_rows_and_empty_table(spark, rng):
    text = prose(rng, 60)
    out = suffix_dedup.remove_repeats(documents(spark, [(1, text), (1, text), (None, text)]), keep="none").collect()
    assert [r.n_removed for r in out] == [len(text)] * 3
    assert suffix_dedup.remove_repeats(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_matched_starts_against_sorting():
    rng = np.random.default_rng(1)
    contexts = [bytes(rng.integers(97, 99, 40).tolist()) for _ in range(6)]
    earlier, later = suffix_dedup.matched_starts(contexts, [29] * 6, [(0, i, 0) for i in range(6)], 12)
    where = [(c, i) for c in range(6) for i in range(29)]
    for c in range(6):
        for i in range(29):
            same = [p for p in where if contexts[p[0]][p[1] : p[1] + 12] == contexts[c][i : i + 12]]
            assert earlier[c][i] == (same[0] != (c, i)) and later[c][i] == (same[-1] != (c, i))


def brute_components(rows, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    at = {d: d for d in sets}
    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                low, high = sorted((at[a], at[b]))
                at = {d: low if c == high else c for d, c in at.items()}
    return {d: (len(sets[d]), at[d]) for d in sets}


def test_jaccard_components(spark, rng):
    rows = []
    for group in range(10):
        base = prose(rng, rng.choice([6, 12, 30, 120, 400])).split()
        for copy in range(6):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 60) + 2)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            if copy == 3:
                words += prose(rng, max(1, len(base) // 12)).split()
            rows.append((100 - len(rows), " ".join(words).upper() if copy == 2 else "  ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "one two"), (204, "ONE two"), (205, "two one"), (206, rows[0][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, rows), block=4).collect()}
    assert got == brute_components(rows, 85)


def test_first_and_last_of_a_bucket_are_compared_once(spark, rng, monkeypatch):
    """Whatever shares a signature with one or two others is settled by the first comparison."""
    rows, left, mixed = [], [], jaccard_join.mixed_members
    for _ in range(12):
        base = prose(rng, 60).split()
        for copy in range(3):
            rows.append((len(rows), " ".join(base[: 30 + 15 * copy] + prose(rng, 30 - 15 * copy).split())))

    def members(*args):
        left.append((found := mixed(*args)).count())
        return found

    monkeypatch.setattr(jaccard_join, "mixed_members", members)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()}
    assert got == brute_components(rows, 85) and left == [0, 0], left


def test_jaccard_odd_tables(spark, rng):
    text = prose(rng, 50)
    out = jaccard_join.jaccard_components(documents(spark, [(5, text), (5, text), (None, text), (3, None)])).collect()
    assert sorted(r.component_id for r in out) == [3, 5, 5, 5]
    assert jaccard_join.jaccard_components(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    signer = jaccard_join.Signer(85)
    for n in (7, 9, 16, 40, 150, 700):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for _ in range(40):
            out = int(rng.integers(0, n // 7 + 1))
            into = int(rng.integers(0, n // 7 + 1))
            if 100 * (n - out) < 85 * (n + into) or not out + into:
                continue
            b = np.unique(np.concatenate([rng.permutation(a)[: n - out], rng.integers(0, 2**63, into).astype(np.uint64)]))
            assert len(np.intersect1d(signer.signatures(a), signer.signatures(b)))


def test_packed_signatures_keep_what_the_map_reads():
    values = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64) * np.uint64(2)
    held = jaccard_join.pack(values)
    assert len(held) == 300 and (jaccard_join.unpack(held) == values >> np.uint64(16) << np.uint64(16)).all()
    assert len(jaccard_join.unpack(b"")) == 0 and jaccard_join.pack(values[:0]) == b""
