"""Literal cases of the column expressions."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import numbers, records, text, urls


def evaluate(spark, build, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("given, want", [
    ("129.90", 129.9), ("49", 49.0), (None, None), ("abc", None), ("999999", None), ("1000000", None), ("0", None), ("-5", None),
    ("NaN", None), ("inf", None), ("5d", None), (" 7 ", 7.0), ("1_000", 1000.0), ("1e3", 1000.0), (".5", 0.5),
])
def test_parse_price(spark, given, want):
    assert evaluate(spark, numbers.parse_price, given) == want


@pytest.mark.parametrize("given, want", [("1,234.50", 1234.5), ("999,999", None), ("0", None), ("-3", None), (None, None), ("abc", None)])
def test_offer_price(spark, given, want):
    assert evaluate(spark, numbers.parse_price_offer, given) == want


@pytest.mark.parametrize("given, want", [("₪ 1,234.50 only", 1234.5), ("free", None), ("1.2.3", None)])
def test_digits_price(spark, given, want):
    assert evaluate(spark, numbers.parse_price_digits, given) == want


def test_rest_price_lets_the_sentinel_through(spark):
    assert evaluate(spark, numbers.parse_price_rest, "999999") == 999999.0


@pytest.mark.parametrize("given, want", [
    (None, []), ("", []), ("  ", []), ("Springfield", ["Springfield"]), ("TLV", ["TLV", 'ת"א והסביבה', "תל אביב-יפו"]),
    ("תל-אביב", ["תל-אביב", 'ת"א והסביבה', "תל אביב-יפו"]), ("בחיפה", ["בחיפה", "חיפה והסביבה"]),
    ("ירושלים והסביבה", ["ירושלים והסביבה"]),
])
def test_expand_city(spark, given, want):
    assert evaluate(spark, text.expand_city, given) == want


@pytest.mark.parametrize("given, want", [("300.7", "301"), ("300.0", "300"), ("2.5", "2"), ("3.5", "4"), ("cheap", "cheap")])
def test_clean_int_label(spark, given, want):
    assert evaluate(spark, numbers.clean_int_label, given) == want


@pytest.mark.parametrize("given, want", [('["a","","b"]', ["a", "b"]), ("[", []), (None, []), ("{}", []), ("[]", [])])
def test_json_list(spark, given, want):
    assert evaluate(spark, records.json_list, given) == want


@pytest.mark.parametrize("given, want", [
    ("new fox shoes", "Fox"), ("foxy shoes", None), ("my IPHONE case", "Apple"), ("ge   oven", "GE"), ("LG tv", "LG"), ("algae", None), (None, None),
])
def test_detect_brand(spark, given, want):
    assert evaluate(spark, text.detect_brand, given) == want


def test_chain_order_and_accents(spark):
    chain = lambda c: text.detect_chain(c, F.lit(None).cast("string"))
    assert evaluate(spark, chain, "FOX HOME mall") == "FOX"
    assert evaluate(spark, chain, "CAFÉ CAFÉ") == "Cafe Cafe"


def test_category_is_a_substring_match(spark):
    path = lambda c: text.classify_category(c, F.lit("spa"))
    assert evaluate(spark, path, "Spring water") == "אופנה > תכשיטים"
    assert evaluate(spark, path, "unknown") == "ספא ויופי"
    assert evaluate(spark, lambda c: text.classify_category(c, F.lit("other")), "unknown") is None


def test_overlap_bounds(spark):
    score = lambda c: text.word_overlap(c, F.lit("Sony WH headphones"), F.lit("Sony"))
    assert evaluate(spark, score, "sony headphones") == 0.9
    assert evaluate(spark, score, "bose earbuds") == 0.4
    assert evaluate(spark, score, " sony bose ") == pytest.approx(0.65)


def test_keyword_patterns_keep_wildcards(spark):
    k = evaluate(spark, text.keyword_patterns, "a 50% Off_x y")
    assert (k["term"], k["word1"], k["word2"]) == ("%a 50% Off_x y%", "%50%%", "%Off_x%")


@pytest.mark.parametrize("given, want", [("Main 7, Haifa", "Haifa"), ("Main 7", None), ("Main, 12b", None), ("Main, ", None), ("a, " + "x" * 31, None)])
def test_city_from_address(spark, given, want):
    assert evaluate(spark, text.city_from_address, given) == want


def test_urls(spark):
    assert evaluate(spark, urls.base_url, "https://shop.example.com/x?utm=1") == "https://shop.example.com"
    assert evaluate(spark, urls.slug, "https://www.a-b.example.com/x") == "a_b_example_com"
    assert evaluate(spark, urls.looks_like_product_url, "https://x.example.com/PRODUCTS/1") is True
    assert evaluate(spark, urls.looks_like_product_url, "https://x.example.com/about?u=/product/1") is False
    assert evaluate(spark, lambda c: urls.is_external(c, ["p.example.com"]), "https://p.example.com/1") is False


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(numbers.cosine(F.col("a"), F.col("b")).alias("c"), numbers.cosine(F.col("a"), F.col("b"), clamp=True).alias("d")).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (0.0, 0.0)]
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="vector lengths differ"):
        bad.select(numbers.cosine(F.col("a"), F.col("b"))).collect()


@pytest.mark.parametrize("actual, expected, want", [
    ({"brand": '"Sony WH"'}, {"brand": '"sony"'}, True), ({"brand": '"Bose"'}, {"brand": '"s"'}, True), ({}, {"brand": '""'}, False),
    ({"p": "104"}, {"p": "100"}, True), ({"p": "106"}, {"p": "100"}, False), ({"b": "true"}, {"b": "1"}, False), ({"b": "true"}, {"b": "true"}, True),
    ({"a": "1"}, {}, True),
])
def test_args_superset(spark, actual, expected, want):
    df = spark.createDataFrame([(actual, expected)], "a map<string,string>, e map<string,string>")
    met = records.args_superset(records.typed_args(F.col("a")), records.typed_args(F.col("e")))
    assert df.select(met.alias("m")).first()["m"] is want


def test_json_from_noise(spark):
    nested = 'x {"a": {"b": 1}} y'
    assert evaluate(spark, records.json_from_noise, nested) is None
    assert str(evaluate(spark, lambda c: F.to_json(records.json_from_noise(c, greedy=True)), nested)) == '{"a":{"b":1}}'
