"""Analyzers and their steps, of query strings and of columns."""

import pytest
from pyspark.sql import functions as F

from fathom.functions import analysis
from fathom.functions.analysis import STOCK, custom
from fathom.functions.distance import glob, osa, whole_regex


def terms(spark, analyzer, text):
    return [t for t, _ in analyzer.analyze(spark, text)]


@pytest.mark.parametrize(
    ("name", "text", "wanted"),
    [
        ("lucene.standard", "It's 3.14, Mr. O'Neil_x: a-b", ["it's", "3.14", "mr", "o'neil_x", "a", "b"]),
        ("lucene.simple", "Ab3c D", ["ab", "c", "d"]),
        ("lucene.whitespace", "A-b  C", ["A-b", "C"]),
        ("lucene.keyword", "A b", ["A b"]),
        ("lucene.stop", "The cat and A dog", ["cat", "dog"]),
        ("lucene.english", "The dogs' running cats", ["dog", "run", "cat"]),
        ("lucene.cjk", "日本語x", ["日本", "語", "x"]),
    ],
)
def test_stock(spark, name, text, wanted):
    assert terms(spark, STOCK[name], text) == wanted


def made(tokenizer, *filters, chars=()):
    return custom({"name": "mine", "tokenizer": tokenizer, "tokenFilters": list(filters), "charFilters": list(chars)})


@pytest.mark.parametrize(
    ("analyzer", "text", "wanted"),
    [
        (made({"type": "whitespace"}, {"type": "asciiFolding"}), "Ångström Straße", ["Angstrom", "Strasse"]),
        (made({"type": "whitespace"}, {"type": "asciiFolding", "originalTokens": "include"}), "é a", ["e", "é", "a"]),
        (made({"type": "whitespace"}, {"type": "edgeGram", "minGram": 2, "maxGram": 3}), "abcd x", ["ab", "abc"]),
        (made({"type": "whitespace"}, {"type": "nGram", "minGram": 2, "maxGram": 2}), "abc", ["ab", "bc"]),
        (made({"type": "whitespace"}, {"type": "shingle", "minShingleSize": 2, "maxShingleSize": 2}), "a b c", ["a b", "b c"]),
        (made({"type": "whitespace"}, {"type": "length", "min": 2, "max": 3}), "a bb cccc", ["bb"]),
        (made({"type": "whitespace"}, {"type": "limitTokenCount", "maxTokenCount": 1}), "a b", ["a"]),
        (made({"type": "whitespace"}, {"type": "regex", "pattern": "b+", "replacement": "-", "matches": "first"}), "abbab", ["a-ab"]),
        (made({"type": "whitespace"}, {"type": "regex", "pattern": "b+", "replacement": "-", "matches": "all"}), "abbab", ["a-a-"]),
        (made({"type": "whitespace"}, {"type": "reverse"}, {"type": "stopword", "tokens": ["cba"]}), "abc de", ["ed"]),
        (made({"type": "regexSplit", "pattern": "[,;]"}, {"type": "trim"}), "a, b;c", ["a", "b", "c"]),
        (made({"type": "regexCaptureGroup", "pattern": "<(\\w+)>", "group": 1}), "<a> <b>", ["a", "b"]),
        (made({"type": "uaxUrlEmail"}), "see http://x.org/a?b=1 or me@x.org", ["see", "http://x.org/a?b=1", "or", "me@x.org"]),
        (made({"type": "edgeGram", "minGram": 1, "maxGram": 2}), "abc", ["a", "ab"]),
        (made({"type": "whitespace"}, {"type": "keywordRepeat"}, {"type": "porterStemming"}, {"type": "removeDuplicates"}), "runs x", ["run", "x"]),
        (made({"type": "whitespace"}, {"type": "icuFolding"}), "ÀÉ ﬁx", ["ae", "fix"]),
        (made({"type": "whitespace"}, {"type": "spanishPluralStemming"}, {"type": "lowercase"}), "Casas", ["casa"]),
        (made({"type": "whitespace"}, {"type": "porterStemming"}, {"type": "edgeGram", "minGram": 2, "maxGram": 2}, {"type": "icuNormalizer"}), "running", ["ru"]),
        (made({"type": "standard"}, chars=[{"type": "htmlStrip"}]), "<p>a&amp;b</p><script>x</script>", ["a", "b"]),
        (made({"type": "whitespace"}, chars=[{"type": "mapping", "mappings": {"&": "and"}}]), "a & b", ["a", "and", "b"]),
        (made({"type": "whitespace"}, chars=[{"type": "icuNormalize"}]), "ＡＢ c", ["ab", "c"]),
        (made({"type": "whitespace"}, {"type": "wordDelimiterGraph"}), "PowerShot500", ["Power", "Shot", "500"]),
    ],
)
def test_steps(spark, analyzer, text, wanted):
    assert terms(spark, analyzer, text) == wanted
    # A column is analysed alike, beside nulls and empty texts.
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string")
    got = {r["i"]: [x["term"] for x in r["tok"]] for r in analyzer.added(df, F.col("t"), "tok").collect()}
    assert got == {1: wanted, 2: [], 3: []}


def test_autocomplete_grams(spark):
    assert terms(spark, analysis.autocomplete(STOCK["lucene.standard"], "edgeGram", 2, 4, True), "Ab écran")[:2] == ["ab", "ab"]
    assert "ran" in terms(spark, analysis.autocomplete(STOCK["lucene.standard"], "rightEdgeGram", 2, 4, True), "écran")


def test_distance_and_patterns():
    assert [osa("abcd", x, 2) for x in ("abcd", "abdc", "acd", "xabcd", "dcba")] == [0, 1, 1, 1, 3]
    import re

    assert re.match(glob("a*c?\\*"), "abbcx*") and not re.match(glob("a?"), "a")
    assert re.match(whole_regex('a@"."'), "axyz.")
    with pytest.raises(ValueError):
        whole_regex("~a")


def test_words_from_a_text_in_lower_case(spark):
    """Whole texts in lower case give what each word in lower case gives, for every character, in words and alone."""
    c = spark.range(1, 0x110000).where("id < 55296 OR id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    df = c.select(F.concat(F.lit("aB"), "c", F.lit("Cd "), "c", F.lit(" x"), "c", F.lit(" Éa")).alias("t"))
    more = spark.createDataFrame([("",), (None,), ("ΟΔΟΣ ΣΑΣ",), ("İI ıi",), (f"Ab {'X' * 40_000} cD",), (f"Ab {'é' * 9_000} cD",), ("x " * 20_000,)], "t string")
    each = F.transform(F.filter(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.octet_length(w) <= 32766), lambda w, k: F.struct(F.lower(w).alias("term"), k.alias("pos")))
    found = df.union(more).select(each.alias("want"), analysis.STOCK["lucene.simple"].words(F.col("t")).alias("w")).select("want", analysis.placed(F.col("w")).alias("got"))
    assert found.where("NOT (want <=> got)").count() == 0
