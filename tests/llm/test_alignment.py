"""Token alignment against byte ranges compared pair by pair."""

from __future__ import annotations

import hashlib
import os
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.llm import token_alignment as ta

from .conftest import documents, prose

pytestmark = pytest.mark.skipif(not os.path.exists(ta.BYTE_BPE), reason="no tokenizer files here")

ODD = ["<|endoftext|> <s> </s> <unk> <0x41>", "tab\tnew\n\nline \r\n end  ", "▁ literal", "é 日本語 \U0001F600  x", " lead", "x" * 3_000, "  " * 40 + "y", "don't we'll I'd", "a\x00b", "1234567 89,5", "\u0085​"]


@pytest.fixture(scope="module")
def sides():
    return tuple(load(open(path, "rb").read()) for load, path in ((ta.byte_level, ta.BYTE_BPE), (ta.byte_fallback, ta.PIECE_BPE)))


def brute(sides, text):
    """(n_a, n_b, groups, links) by comparing all byte ranges; None where a side does not render the text."""
    a, b = (side.encode([text])[0] for side in sides) if text else ([], [])
    if not text or any(side.spell(ids) != b" " + text.encode() for side, ids in zip(sides, (a, b))):
        return None
    spans = []
    for side, ids in zip(sides, (a, b)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(side.bytes[i]), i))
            at = own[-1][1]
        spans.append(own)
    groups, x, y = [], 0, 0
    for end in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
        u, v = (sum(e <= end for _, e, _ in own) for own in spans)
        groups.append(f"{','.join(map(str, a[x:u]))}|{','.join(map(str, b[y:v]))}")
        x, y = u, v
    return len(a), len(b), groups, [(i, j) for s, e, i in spans[0] for c, d, j in spans[1] if s < d and c < e]


@pytest.mark.parametrize(("memo", "memo_ids"), [(200_000, 48), (0, 48), (10, 3)])
def test_windows(sides, rng, memo, memo_ids):
    aligner = ta.Aligner(*sides, memo, memo_ids)
    for text in [*ODD, *(prose(rng, 40) for _ in range(10)), "Ünï çödé wörds " * 9]:
        right = brute(sides, text)
        row = aligner.documents([text], True)[0]
        if right is None:
            assert row[:5] == (0, 0, 0, 0, "") and "▁" in text
            continue
        n_a, n_b, groups, links = right
        assert row[:4] == (n_a, n_b, len(groups), len(links)) and row[7] == ";".join(groups)
        assert dict(zip(row[5].tolist(), row[6].tolist())) == Counter(i * ta.SHIFT + j for i, j in links)


def test_both_encoders_agree(sides, rng):
    plain = ta.byte_level(open(ta.BYTE_BPE, "rb").read(), False)
    texts = ODD + [prose(rng, 200) for _ in range(20)]
    assert plain.encode(texts) == sides[0].encode(texts)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(sides, text):
    right = brute(sides, text)
    row = ta.Aligner(*sides).documents([text], True)[0]
    assert row[:4] == ((right[0], right[1], len(right[2]), len(right[3])) if right else (0, 0, 0, 0))
    assert not right or row[7] == ";".join(right[2])
    assert ta.byte_level(open(ta.BYTE_BPE, "rb").read(), False).encode([text]) == sides[0].encode([text])


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_report(spark, sides, rng, broadcast_rows):
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(40)] + [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(200, None), (201, ""), (0, rows[0][1]), (None, rows[1][1]), (None, None), (202, "the the the"), (203, "the " * 4_000)]
    right = [brute(sides, t) if len(t or "") < 9_000 else None for _, t in rows]
    whole = ta.Aligner(*sides).documents([rows[-1][1]], True)[0]
    groups = whole[7].split(";")
    pairs = {(k // ta.SHIFT, k % ta.SHIFT): int(n) for k, n in zip(whole[5], whole[6])}
    right[-1] = (whole[0], whole[1], groups, [p for p, n in pairs.items() for _ in range(n)])
    held = Counter(p for r in right if r for p in set(r[3]))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    expected = []
    for (doc_id, _), r in zip(rows, right):
        n_a, n_b, groups, links = r or (0, 0, [], [])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if r else ""
        expected.append((doc_id, n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    got = ta.alignment_report(documents(spark, rows), broadcast_rows=broadcast_rows)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, expected))


def test_columns_and_empty_table(spark, sides):
    frame = documents(spark, [(1, "some words"), (2, None)]).withColumn("pair", F.lit(1)).withColumn("tokens", F.lit("old")).withColumn("row", F.lit(3))
    got = {r.doc_id: r for r in ta.align_tokens(frame, groups=True, chunk=1).collect()}
    assert got[1].tokens.groups == ";".join(brute(sides, "some words")[2]) and got[1].pair == 1 and got[1].row == 3
    assert got[2].tokens.n_a == 0 and got[2].tokens.groups == "" and set(got[2].asDict()) == set(frame.columns)
    assert ta.alignment_report(frame.limit(0)).count() == 0


def test_equal_hashes_of_different_windows(sides, rng):
    texts = [prose(rng, 60) for _ in range(6)] + ODD[:3]
    for memo in (0, 7, 200_000):
        aligner = ta.Aligner(*sides, memo)
        aligner.mixed = [m * 0 for m in aligner.mixed]  # windows of equal sizes share a hash
        for some in (texts, texts[::-1], [*texts, prose(rng, 60)]):
            for text, row in zip(some, aligner.documents(some, True)):
                right = brute(sides, text)
                assert row[7] == (";".join(right[2]) if right else "")
                assert not right or dict(zip(row[5].tolist(), row[6].tolist())) == Counter(i * ta.SHIFT + j for i, j in right[3])
        assert len(aligner.known.names) <= memo


def test_alignment_costs_little_beside_encoding(sides, rng):
    """Rare words, hence new windows, are aligned at once, without a step in Python for each token."""
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 12))) for _ in range(400)) for _ in range(150)]

    def seconds(work):
        begun = time.process_time()
        work()
        return time.process_time() - begun

    encoding = min(seconds(lambda: [side.encode(texts) for side in sides]) for _ in range(3))
    assert min(seconds(lambda: ta.Aligner(*sides).documents(texts, False)) for _ in range(3)) < 4 * encoding  # 6 before
