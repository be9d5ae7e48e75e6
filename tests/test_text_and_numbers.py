import hashlib
import unicodedata

from conftest import rows
from pyspark.sql import functions as F

from hearken.functions import hashing, privacy, text
from hearken.functions.fixed_values import APP_MENTION, AXIS_SIGNAL, RESET_SIGNAL, STOPWORDS
from hearken.functions.numeric import percent, round_even, to_number, to_whole
from hearken.functions.survey import leading_scale, picked_any
from hearken.operators import cleaning, search


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_clean_keeps_hangul_letters_and_digits(spark):
    assert one(spark, " 앱이!! 자꾸\t꺼져요ㅠㅠ (v2.1) ", text.clean_text) == "앱이 자꾸 꺼져요 v2 1"
    assert one(spark, None, text.clean_text) is None


def test_cleaning_pipeline(spark):
    raw = spark.createDataFrame(
        [
            (1, "정말 너무!", 1), (2, "연결이 안 돼요", 2), (3, "연결이,안 돼요!!", 1),
            (4, "짧다", 1), (5, None, 1), (6, "정말 너무 그냥", 5),
        ],
        "seq long, review string, rating int",
    )
    kept = cleaning.clean_reviews(raw)
    assert rows(kept, "seq") == [(2,)]  # 3 repeats 2, 1 and 6 are stopwords only, 4 is short
    assert kept.first()["tokens"] == ["연결이", "안", "돼요"]


def test_stopwords_match_whole_tokens_only(spark):
    assert one(spark, "앱 앱에서 사용 사용자", lambda c: text.tokens(c, STOPWORDS)) == ["앱에서", "사용자"]


def test_word_pairs(spark):
    grams = one(spark, "Ab cd e ef", lambda c: text.one_and_two_grams(text.words(c)))
    assert grams == ["ab", "cd", "ef", "ab cd", "cd ef"]
    assert one(spark, "", lambda c: text.one_and_two_grams(text.words(c))) == []


def test_patterns_cover_unicode_space_and_null(spark):
    assert one(spark, "이전　설치 문의", lambda c: text.matches(c, AXIS_SIGNAL["A_집이바뀜"]))
    assert one(spark, None, lambda c: text.matches(c, APP_MENTION)) is False
    assert one(spark, "등록한 제품이 다 날아갔어요", lambda c: text.matches(c, RESET_SIGNAL))
    assert not one(spark, "제품 등록이 쉽네요", lambda c: text.matches(c, RESET_SIGNAL))


def test_axis_yield_and_order_of_testimonies(spark):
    hits = spark.createDataFrame(
        [
            (1, "A_집이바뀜", "이사 후 씽큐 연결", False), (2, "A_집이바뀜", "이사 사은품 씽큐", False),
            (3, "D_계정거부", "씽큐 계정 없이 제가 썼어요", True), (4, "A_집이바뀜", "이사했더니 씽큐 포기", False),
            (5, "B_사람기기바뀜", "이사 씽큐", False),
        ],
        "seq long, axis string, review string, sponsored boolean",
    )
    flagged = search.with_flags(hits)
    table = {r["axis"]: r for r in search.axis_yield(flagged, list(AXIS_SIGNAL)).collect()}
    assert table["A_집이바뀜"]["valid_n"] == 2 and table["A_집이바뀜"]["valid_pct"] == 66.7
    assert table["B_사람기기바뀜"]["verdict"] == "redesign"
    ordered = search.testimonies(search.with_tone(flagged.filter("valid")))
    assert [r["seq"] for r in ordered.collect()] == [4, 3, 1]


def test_rounding_is_half_even_on_the_binary_value(spark):
    for value, digits, expected in [(1.015, 2, 1.01), (0.25, 1, 0.2), (2.5, 0, 2.0), (0.35, 1, 0.4)]:
        assert one(spark, value, lambda c: round_even(c, digits), "double") == expected
    assert one(spark, 0, lambda c: percent(F.lit(1), c), "int") is None


def test_number_coercion(spark):
    cells = {"1.5": 1.5, " 7 ": 7.0, "1e3": 1000.0, "nan": None, "inf": None, "1d": None, "": None, "x": None, ".5": 0.5, "1e999": None}
    for cell, expected in cells.items():
        assert one(spark, cell, to_number) == expected
    assert one(spark, "1.5", to_whole) is None
    assert one(spark, "12.0", to_whole) == 12


def test_survey_codes(spark):
    assert one(spark, "4 자주 있다", leading_scale) == 4
    assert one(spark, "10 점", leading_scale) == 1
    assert one(spark, "6 점", leading_scale) is None
    assert one(spark, "없음, 가민", picked_any) == 1
    assert one(spark, "없음", picked_any) == 0
    assert one(spark, None, picked_any) == 0


def test_fingerprint_ignores_row_order_but_not_content(spark):
    data = [(1, "a"), (2, None), (3, ""), (4, "b")]
    def hash_of(x):
        return hashing.fingerprint(spark.createDataFrame(x, "seq long, review string"), ["seq", "review"]).first()["content_hash"]

    assert hash_of(data) == hash_of(data[::-1])
    assert hash_of(data) != hash_of([(1, "a"), (2, ""), (3, None), (4, "b")])
    assert hash_of(data) != hash_of(data + [(5, "c")])


def test_redaction_hides_the_value(spark):
    value = "hong@example.com"
    shown = one(spark, value, privacy.redact)
    assert shown == f"<str len=16 #{hashlib.sha256(value.encode()).hexdigest()[:4]}>"


def test_identifier_rules_see_through_full_width_and_hidden_characters(spark):
    texts = ["ｈｏｎｇ＠ｅｘａｍｐｌｅ.com", "hong﻿@x.com", "010-1234-5678", "900101-1234567", "성명: 홍", "ok", "가" * 257]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, v string")
    df = df.withColumn("f", privacy.compatibility_form(F.col("v")))
    assert [r["f"] for r in df.orderBy("id").collect()] == [unicodedata.normalize("NFKC", t) for t in texts]
    rules = privacy.value_rules(F.col("v"), F.col("f"))
    found = {r["id"]: [k for k in rules if r[k]] for r in df.select("id", *[c.alias(k) for k, c in rules.items()]).collect()}
    assert found[0] == ["email"] and "hidden_characters" in found[1]
    assert found[2] == ["phone"] and "national_id" in found[3]
    assert found[4] == ["identifier_phrase"] and found[5] == [] and found[6] == ["too_long"]


def test_compatibility_form_agrees_with_nfkc(spark):
    import unicodedata

    texts = ["plain", "한글 리뷰", "한글 ａｂｃ", "ᄒ" + "ᅡ" + "ᆫ", "가" + "ᆨ", "①②", "e" + "\u0301", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["f"] for r in df.select("i", privacy.compatibility_form(F.col("t")).alias("f")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
