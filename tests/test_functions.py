import pytest
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.functions import values
from foliant.operators import lexical

NUMBERS = {
    "123": 123, "-123.5": -123.5, "1,234,567": 1234567, "1,234.56": 1234.56, "  25.6%  ": 25.6, "$1,200": 1200, "NT$ 3,400": 3400, "nt$3400": 3400, "￥500": 500, "-$5": -5, "$-5": -5, "(1,200)": -1200, "0": 0, "0.5": 0.5, "+7": 7,
}
NOT_NUMBERS = ["", "1,23", "1,2345", ",123", "1.2.3", "1.", ".5", "%", "$", "1e5", "007", "0912345678", "2025/01/05", "1 2"]
DATES = {"2025/1/5": "2025-01-05 00:00:00", "2025-01-05 13:45": "2025-01-05 13:45:00", "2025/01/05 13:45:09": "2025-01-05 13:45:09", "2025-01-05T08:00:00": "2025-01-05 08:00:00"}
NOT_DATES = ["2025/13/01", "2025/02/30", "01/05/2025", "20250105", "12:30"]


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in [*NUMBERS, *NOT_NUMBERS]], "v string").select("v", values.parse_number(F.col("v")).alias("n"))
    assert {r.v: r.n for r in df.collect()} == NUMBERS | dict.fromkeys(NOT_NUMBERS)


def test_dates(spark):
    df = spark.createDataFrame([(x,) for x in [*DATES, *NOT_DATES]], "v string").select("v", values.parse_date(F.col("v")).alias("d"))
    assert {r.v: r.d for r in df.collect()} == DATES | dict.fromkeys(NOT_DATES)


def test_names():
    got = values.sql_names(["金額(元)", "1月", "a b", "A_B", " ", "", "金額(元)", "Q1-2025", "日期"])
    assert got == ["金額_元_", "c_1月", "a_b", "A_B_2", "column_5", "column_6", "金額_元__2", "Q1_2025", "日期"]


@pytest.mark.parametrize(("x", "text"), [(1280000.0, "1280000"), (0.30000000000000004, "0.3"), (1e20, "1E+20"), (None, "NULL")])
def test_display(x, text):
    assert values.format_double(x) == text


@pytest.mark.parametrize(
    ("query", "match", "like"),
    [
        ("去年給客戶的報價單", 7, ()), ("報價", 0, ("報價",)), ("Ｑ３營收", 0, ("q3", "營收")), ("foo AND bar NOT baz*", 5, ()), ("", 0, ()), ("a", 0, ()),
    ],
)
def test_query_terms(query, match, like):
    q = lexical.build_query(query)
    assert (len(q.match), q.like) == (match, like)


def test_query_words():
    assert lexical.build_query("ABC-123 規格") == lexical.KeywordQuery(("abc-123",), ("規格",))
    q = lexical.build_query("-- foo- _bar ... 12")
    assert (q.match, q.like) == (("foo", "bar"), ("12",))
    assert len(lexical.build_query(" ".join(f"word{i:03d}" for i in range(50))).match) == 32
    assert len(lexical.build_query(" ".join(f"{chr(97 + i)}{chr(97 + i)}" for i in range(20))).like) == 8


def test_substring_is_literal(spark):
    docs = spark.createDataFrame([(1, "100% sure"), (2, "100 sure"), (3, "a_b"), (4, "axb"), (5, None)], "doc_id long, text string")
    assert [r.doc_id for r in lexical.substring_hits(docs, ("0%",), "doc_id", "text", 9).collect()] == [1]
    assert [r.doc_id for r in lexical.substring_hits(docs, ("a_b",), "doc_id", "text", 9).collect()] == [3]


def test_overlapping_occurrences_and_graphemes(spark):
    df = spark.createDataFrame([("aaaa", "e\u0301x👨‍👩‍👧")], "a string, b string")
    r = df.select(tx.occurrences(F.col("a"), "aa").alias("n"), tx.grapheme_length(F.col("b")).alias("g")).first()
    assert (r.n, r.g) == (3, 3)


def test_masks(spark):
    df = spark.createDataFrame([("api_key=abc123 user=x", r"C:\Users\Ann\x /home/bob/y", "/data/a/b/c.txt", "=1+1")], "a string, b string, c string, d string")
    r = df.select(tx.mask_secrets(F.col("a")), tx.mask_profiles(F.col("b")), tx.mask_folders(F.col("c"), ["/data/a", "/data/a/b"]), tx.csv_safe(F.col("d")), tx.middle_ellipsis(F.col("c"), 7)).first()
    assert list(r) == ["api_key=*** user=x", r"C:\Users\***\x /home/***/y", "<folder2>/c.txt", "'=1+1", "/da…txt"]


def test_candidates_hold_all_matches(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "help"), (3, "hello"), (4, "ab")], "doc_id long, text string")
    found = lexical.candidates(lexical.postings(docs), ("hello",))
    assert {r.doc_id for r in found.collect()} == {1, 3}


def test_ranges():
    assert values.parse_range("B2:D9") == (2, 2, 9, 4) and values.parse_range("x") is None
    assert [values.column_name(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]
    assert all(values.column_number(values.column_name(n)) == n for n in range(1, 900))


def test_simple_texts_are_their_own_graphemes():
    import random

    import regex

    from foliant.functions.text import graphemes, simple

    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("ab\r\n\t\x00\x7f\x85\xa9\xad\xaeéſʰ˿́‍👍🏽漢각") for _ in range(rng.randint(0, 8)))
        assert graphemes(t) == regex.findall(r"\X", t)
    assert simple("".join(map(chr, range(0x300))).replace("\r", "")) and not simple("\r\n") and not simple("é")
    assert len(regex.findall(r"\X", "".join(map(chr, range(0x300))).replace("\r", ""))) == 0x300 - 1
