"""The in/out pairs of FIXTURES.md, and name functions against a plain statement of their rule."""

from __future__ import annotations

import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from tessitura.functions import keys, names

CASES = {
    "normalize_name": [
        (None, ""), ("", ""), ("   ", ""), ("W. A. Mozart", "w a mozart"), ("w. a. mozart", "w a mozart"), ("W A Mozart", "w a mozart"),
        ("w-a-mozart", "w a mozart"), ("  W.  A.   Mozart  ", "w a mozart"), ("José", "jose"),
    ],
    "clean_name": [
        ("W. A. Mozart!!", "W A Mozart"), ("Mozart…", "Mozart"), ("A minor Alexander Gillet 1779", "A minor Alexander Gillet"), ("Jose  Maria   López", "Jose Maria López"),
        ("O'Connor", "O Connor"), ("-By Mr Clark", "By Mr Clark"), ("Jean-Baptiste Lully", "Jean-Baptiste Lully"), (None, ""),
    ],
    "extract_name": [
        ("Attributed to William Bird", "William Bird"), ("Tune is A Gigg by William Bird", "William Bird"), ("Claude Debussy arr. Andrew Hearn", "Claude Debussy"),
        ("Claude Debussy [arranged from]", "Claude Debussy"), ("Mozart", "Mozart"), ("A bluegrass song gone haywire", None), ("", None), ("76", None), (None, None),
    ],
    "is_mojibake": [
        ("ÐÐÐºÐ ÐÐÑ", True), ("çå ååª Kataoka Kenta", True), ("a�", True), ("Wolfgang Amadeus Mozart", False), ("Пётр Ильич Чайковский", False), ("武満徹", False),
        ("José María", False), (None, False),
    ],
    "classify_name": [
        ("Wolfgang Amadeus Mozart", "correct"), ("Bach, Johann Sebastian", "correct"), ("76", "incorrect"), ("123456", "incorrect"), ("Claude Debussy arr. Andrew Hearn", "incorrect"),
        ("Attr. to William Bird", "incorrect"), ("Stetsenko (1882-1922)", "incorrect"), ("By Mr Clark", "incorrect"), ("L blanke arr OKNEM", "incorrect"),
        ("Original music by John Welsman", "incorrect"), ("Mozart", "not_reviewed"), ("Stetsenko", "not_reviewed"), ("Пётр Ильич Чайковский", "not_reviewed"), (None, "incorrect"),
    ],
    "catalogue_prefix": [("K. 15h", "K"), ("BWV 846", "BWV"), ("Hob. XVI:1", "Hob"), ("Op. 15", None), ("K", None), ("A minor ...", None), ("", None), (None, None)],
    "name_key": [("W.A. Mozart", "wa mozart"), ("Sean O Neill", "s oneill"), ("Anon.", "anonymous"), ("123", ""), ("Bach (Erben)", "b erben"), (None, "")],
    "clean_null": [(" x ", "x"), ("NaN", None), ("-", None), (None, None)],
    "display_name_from_attribution": [("Bach (junior) 1750", "Bach"), (None, "")],
}


@pytest.mark.parametrize("function", CASES)
def test_pairs(spark, function):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES[function])], "i int, x string")
    got = [r[1] for r in rows.select("i", getattr(names, function)(F.col("x"))).orderBy("i").collect()]
    assert got == [y for _, y in CASES[function]]


def test_labels(spark):
    rows = spark.createDataFrame([(0, "Traditional"), (1, "Wolfgang Amadeus Mozart"), (2, "after Bach"), (3, "J S"), (4, '"Foo Bar"'), (5, "Mozart"), (6, "Irish Reel")], "i int, x string")
    got = [r[1].label for r in rows.select("i", names.candidate_label(F.col("x"))).orderBy("i").collect()]
    assert got == ["no_persona", "real", "qualifier", "no_persona", "no_persona", "review", "no_persona"]


def test_normalize_against_plain_rule(spark):
    words = [chr(c) + "x Ab-" + chr(c + 1) for c in range(0xC0, 0x250, 2)]

    def plain(s: str) -> str:
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
        return " ".join("".join(" " if c in names.PUNCTUATION else c for c in s).split())

    rows = spark.createDataFrame([(w,) for w in words], "x string")
    assert [r[1] for r in rows.select("x", names.normalize_name(F.col("x"))).collect()] == [plain(w) for w in words]


def test_uuid5_and_files(spark):
    row = spark.createDataFrame([("key:ü", "a/b/./Qm.x.mxl", "Qmhash.mxl", "Sinfonia 40", "W.A. Mozart")], "k string, p string, f string, t string, c string").select(
        keys.uuid5(F.col("k")), keys.content_key(F.col("p")), keys.format_of(F.col("p")), keys.download_name(F.col("f"), F.col("t"), F.lit(None), F.col("c")), keys.download_name(F.col("f"), F.lit(None), F.lit(None), F.lit(None))
    ).first()
    assert list(row) == [str(uuid.uuid5(keys.IDENTITY_NAMESPACE, "key:ü")), "Qm.x", "MusicXML", "W.A. Mozart - Sinfonia 40.mxl", "Qmhash.mxl"]


def test_sql_functions(spark):
    names.register_functions(spark)
    row = spark.sql("select normalize_name('W. A. Mozárt'), clean_name('-By Mr. Clark'), is_mojibake('çå'), classify_name('Bach, J S'), catalogue_prefix('K. 15h')").first()
    assert list(row) == ["w a mozart", "By Mr Clark", True, "correct", "K"]


def test_no_python_in_plan(spark):
    rows = spark.createDataFrame([("x",)], "x string")
    plan = rows.select(names.extract_name(F.col("x")), names.candidate_label(F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
