"""Which texts look the same and which do not."""

import pytest

from folio.llm import looks

SAME = [
    ("می‌‌کند", "می‌کند"), ("قرا‌ر", "قرار"), ("رﺍه", "راه"), ("پاﻻیه", "پالایه"), ("کﻼینت", "کلاینت"), ("يک", "یک"), ("كار", "کار"), ("هفتۀ", "هفتهٔ"), ("مصطفى", "مصطفی"), ("٣۴", "۳۴"), ("Ａ１", "A1"), ("Lοrmer", "Lormer"),
    ("a b", "a b"), ("a b", "a b"), ("M‍x", "Mx"), ("é", "é"), ("a​b﻿", "ab"), ("x\r\ny", "x\ny"), ("آ", "آ"), ("يي‌ ", "یي "),
]
DIFFERENT = [("می‌کند", "میکند"), ("قوي", "قوی"), ("ك", "ک"), ("٤", "۴"), ("4", "۴"), ("Lormer", "lormer"), ("é", "e"), ("a b", "ab"), ("a  b", "a b"), ("x²", "x2"), ("بﺍ", "با"), ("ه‍", "ه"), ("ر", "ز"), ("a", "a.")]


def forms(spark, texts):
    df = spark.createDataFrame([(str(k), t, "other") for k, t in enumerate(texts)], "id string, t string, f0 string")
    rows = looks.with_forms(df, "id", ["t"]).collect()
    return [r.t_form for r in sorted(rows, key=lambda r: int(r.id))]


def test_pairs(spark):
    got = forms(spark, [t for pair in SAME + DIFFERENT for t in pair])
    pairs = list(zip(got[::2], got[1::2], strict=True))
    wrong = [p for p, (a, b) in zip(SAME, pairs[: len(SAME)], strict=True) if a != b] + [p for p, (a, b) in zip(DIFFERENT, pairs[len(SAME) :], strict=True) if a == b]
    assert not wrong


def test_null_empty_and_idempotent(spark):
    assert forms(spark, [None, ""]) == [None, ""]
    once = forms(spark, [a for a, _ in SAME])
    assert forms(spark, once) == once


@pytest.mark.parametrize("rows", [[], [("1", None, "a"), ("2", "", "a"), ("3", "a​", "a"), ("3", "a​", "a"), ("4", "a", "a"), ("5", "a", "b")]])
def test_found(spark, rows):
    df = spark.createDataFrame(rows, "id string, latest_translation string, approved_text string")
    assert [r.page_id for r in looks.same_look(df).collect()] == (["3"] if rows else [])
