"""Queries that hold each step of text analysis, and scores of text operators, against SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.analysis import STOCK, Analyzer, custom
from fathom.functions.scores import quantized_length
from fathom.plans import query as q
from fathom.registry import FACETS, NAMES, ORACLE_SQL, QUERIES, SIDEWAYS, TOK, bm25, by, documents, idf, orders, parts, query, read, stats, tf

# Steps of analysis: the terms of a text of each part, joined

#: What a part's text is: "cold widget Brand#13, economy x24.5".
TEXT = "p_name || ' ' || p_brand || ', ' || lower(p_type) || ' x' || CAST(p_size AS VARCHAR(9)) || '.5'"
PIECES = "[split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'Brand', substr(p_brand, 7), lower(p_type), 'x' || p_size || '.5']"
SPACED = f"string_split({TEXT}, ' ')"
WORDS = "string_split(p_name, ' ')"


def made(*filters: dict, tokenizer: dict | str = "whitespace", chars: tuple = ()) -> Analyzer:
    return custom({"name": "made", "tokenizer": {"type": tokenizer} if isinstance(tokenizer, str) else tokenizer, "tokenFilters": list(filters), "charFilters": list(chars)})


def analysed_by(name: str, analyzer: Analyzer, terms: str, text: str = TEXT, positions: bool = False) -> None:
    """Registers the terms that an analyzer makes of a text of each part; `terms` is the list of them in SQL."""

    def run(spark, sf_dir):
        df = read(spark, sf_dir, "part").select("p_partkey", F.expr(text.replace("VARCHAR(9)", "STRING")).alias("text"))
        shown = (lambda t: F.concat(t["term"], F.lit("@"), t["pos"].cast("string"))) if positions else lambda t: t["term"]
        return analyzer.added(df, F.col("text"), "tokens").select("p_partkey", F.array_join(F.transform("tokens", shown), "|").alias("terms"))

    QUERIES[f"analysis_{name}"] = run
    ORACLE_SQL[f"analysis_{name}"] = f"SELECT p_partkey, coalesce(array_to_string({terms}, '|'), '') AS terms FROM part"


analysed_by("tokenizer_standard", made(tokenizer="standard"), f"list_transform({PIECES}, lambda w, k: w || '@' || (k - 1))", positions=True)
analysed_by("tokenizer_whitespace", made(), SPACED)
analysed_by("tokenizer_keyword", made(tokenizer="keyword"), f"[{TEXT}]")
analysed_by("tokenizer_edge_gram", made(tokenizer={"type": "edgeGram", "minGram": 2, "maxGram": 5}), f"list_transform(range(2, 6), lambda n: substr({TEXT}, 1, n))")
analysed_by("tokenizer_n_gram", made(tokenizer={"type": "nGram", "minGram": 2, "maxGram": 2}), "list_transform(range(1, length(p_name)), lambda n: substr(p_name, n, 2))", "p_name")
analysed_by("tokenizer_regex_split", made(tokenizer={"type": "regexSplit", "pattern": "[#, ]+"}), f"string_split_regex({TEXT}, '[#, ]+')")
analysed_by("tokenizer_regex_capture_group", made(tokenizer={"type": "regexCaptureGroup", "pattern": "#([0-9]+)", "group": 1}), "[substr(p_brand, 7)]")
analysed_by("tokenizer_url_email", made(tokenizer="uaxUrlEmail"), "['see', 'https://x.org/' || p_partkey || '?a=1', 'or', 'me.' || p_size || '@x.org']", "'see https://x.org/' || p_partkey || '?a=1 or <me.' || p_size || '@x.org>'")
analysed_by("filter_lowercase", made({"type": "lowercase"}), f"list_transform({SPACED}, lambda w: lower(w))", TEXT)
analysed_by("filter_edge_gram", made({"type": "edgeGram", "minGram": 2, "maxGram": 3}), f"flatten(list_transform({WORDS}, lambda w: list_transform(range(2, least(3, length(w)) + 1), lambda n: w[1:n])))", "p_name")
analysed_by("filter_n_gram", made({"type": "nGram", "minGram": 3, "maxGram": 3}), f"flatten(list_transform({WORDS}, lambda w: list_transform(range(1, length(w) - 1), lambda n: substr(w, n, 3))))", "p_name")
analysed_by("filter_shingle", made({"type": "shingle", "minShingleSize": 2, "maxShingleSize": 2}), "[p_name]", "p_name")
analysed_by("filter_stopword", made({"type": "stopword", "tokens": ["RED", "bolt"]}), f"list_filter({WORDS}, lambda w: w NOT IN ('red', 'bolt'))", "p_name")
analysed_by("filter_stopword_case", made({"type": "stopword", "tokens": ["RED", "bolt"], "ignoreCase": False}), f"list_filter({WORDS}, lambda w: w NOT IN ('RED', 'bolt'))", "p_name")
analysed_by("filter_length", made({"type": "length", "min": 5, "max": 6}), f"list_filter({WORDS}, lambda w: length(w) BETWEEN 5 AND 6)", "p_name")
analysed_by("filter_limit_token_count", made({"type": "limitTokenCount", "maxTokenCount": 3}), f"({SPACED})[1:3]")
analysed_by("filter_regex_all", made({"type": "regex", "pattern": "[aeiou]+", "replacement": "_", "matches": "all"}), f"list_transform({WORDS}, lambda w: regexp_replace(w, '[aeiou]+', '_', 'g'))", "p_name")
analysed_by("filter_regex_first", made({"type": "regex", "pattern": "[aeiou]+", "replacement": "_", "matches": "first"}), f"list_transform({WORDS}, lambda w: regexp_replace(w, '[aeiou]+', '_'))", "p_name")
analysed_by("filter_reverse", made({"type": "reverse"}), f"list_transform({WORDS}, lambda w: reverse(w))", "p_name")
analysed_by("filter_trim", made({"type": "trim"}, tokenizer="keyword"), "[p_name]", "'  ' || p_name || '   '")
analysed_by("filter_remove_duplicates", made({"type": "removeDuplicates"}, {"type": "flattenGraph"}, tokenizer="keyword"), "[p_name]", "p_name")
analysed_by("filter_english_possessive", made({"type": "englishPossessive"}), f"{WORDS}", "split_part(p_name, ' ', 1) || '''s ' || split_part(p_name, ' ', 2) || '’s'")
analysed_by("filter_ascii_folding", made({"type": "asciiFolding"}), f"list_concat({WORDS}, ['Strasse', 'ueAEoe', 'EeA'])", "p_name || ' Straße ueÆœ ÉèÅ'")
analysed_by("filter_ascii_folding_both", made({"type": "asciiFolding", "originalTokens": "include"}), f"list_concat({WORDS}, ['cafe', 'café'])", "p_name || ' café'")
analysed_by("filter_icu_folding", made({"type": "icuFolding"}), f"list_concat({WORDS}, ['strasse', 'fix', 'ea'])", "upper(p_name) || ' STRAßE ﬁx Éå'")
analysed_by("filter_icu_normalizer", made({"type": "icuNormalizer", "normalizationForm": "nfkc"}), f"list_concat({WORDS}, ['fix', 'AB'])", "p_name || ' ﬁx ＡＢ'")
analysed_by("filter_porter", made({"type": "porterStemming"}), "[CAST(p_partkey AS VARCHAR), 'run', 'poni', 'relat', 'hope', 'adjust', 'vile', 'electr']", "p_partkey || ' running ponies relational hoping adjustable vilely electricity'")
analysed_by("filter_english_minimal", made({"type": "englishMinimalStemming"}), "[CAST(p_partkey AS VARCHAR), 'dog', 'pony', 'glass', 'bus', 'shoes']", "p_partkey || ' dogs ponies glass bus shoes'")
analysed_by("filter_spanish_plural", made({"type": "spanishPluralStemming"}), "[CAST(p_partkey AS VARCHAR), 'casa', 'luz', 'flor']", "p_partkey || ' casas luces flores'")
analysed_by("filter_word_delimiter", made({"type": "wordDelimiterGraph", "delimiterOptions": {"preserveOriginal": True}}), "['Wi-Fi' || p_size || '@0', 'Wi@0', 'Fi@1', p_size || '@2', 'PowerShot@3', 'Power@3', 'Shot@4', 'end@5']", "'Wi-Fi' || p_size || ' PowerShot end'", positions=True)
analysed_by("filter_word_delimiter_catenated", made({"type": "wordDelimiterGraph", "delimiterOptions": {"concatenateWords": True, "splitOnNumerics": False}}), "['Wi@0', 'WiFi@0', 'Fi@1', 'a' || p_size || '@2']", "'Wi-Fi a' || p_size", positions=True)
analysed_by("char_html_strip", made(chars=({"type": "htmlStrip"},)), f"list_concat(list_concat({WORDS}, ['&', p_brand]), ['ééé', 'a<b', '&zzz;', '😀'])", "'<p class=\"x\">' || p_name || '</p> &amp; <b>' || p_brand || '</b><!-- no --> &eacute;&#233;&#xE9; a&lt;b &zzz; &#x1F600;<script>no</script>'")
analysed_by("char_html_strip_but", made(chars=({"type": "htmlStrip", "ignoredTags": ["b"]},)), f"list_concat({WORDS}, ['<b>' || p_brand || '</b>'])", "'<p>' || p_name || '</p><b>' || p_brand || '</b>'")
analysed_by("char_mapping", made(chars=({"type": "mapping", "mappings": {"a": "b", "b": "c", "ll": "L", "#": " no. "}},)), "string_split(translate(replace(p_name, 'll', 'L'), 'ab', 'bc') || ' Brbnd no. ' || substr(p_brand, 7), ' ')", "p_name || ' ' || p_brand")
analysed_by("char_icu_normalize", made(chars=({"type": "icuNormalize"},)), f"list_concat(['ab'], {WORDS})", "'ＡＢ ' || upper(p_name)")
analysed_by("char_persian", made(chars=({"type": "persian"},)), f"{WORDS}", "replace(p_name, ' ', '‌')")
analysed_by("stock_english", STOCK["lucene.english"], "['dog', 'run', CAST(p_size AS VARCHAR)]", "'The dog''s RUNNING ' || p_size")
analysed_by("stock_stop", STOCK["lucene.stop"], WORDS, "'The ' || upper(p_name) || ' and 7'")
analysed_by("stock_cjk", STOCK["lucene.cjk"], "['日本', '語', CAST(p_size AS VARCHAR)]", "'日本語 ' || p_size")
analysed_by("override_stem_exclusion", custom({"name": "mine", "baseAnalyzer": "lucene.english", "stemExclusionSet": ["running"], "stopwords": ["of"]}), "['running', 'the', 'dog', CAST(p_size AS VARCHAR)]", "'running of the dogs ' || p_size")
analysed_by("override_stopwords", custom({"name": "mine", "baseAnalyzer": "lucene.standard", "stopwords": ["red"], "ignoreCase": True}), f"list_filter({WORDS}, lambda w: w <> 'red')", "upper(p_name)")

# Scores of operators that expand or place terms

by(
    parts, {"text": {"path": "p_name", "query": "widgte", "fuzzy": {"maxEdits": 1}}}, name="text_fuzzy_score",
    sql=f"""WITH {NAMES}, v AS (SELECT doc_id, unnest(list_distinct(t)) AS w FROM tok), f AS (SELECT w, damerau_levenshtein(w, 'widgte') AS d, count(*) AS df FROM v GROUP BY w HAVING d <= 1),
m AS (SELECT count(*) FILTER (len(t) > 0) AS n, avg(len(t)) FILTER (len(t) > 0) AS mean, (SELECT max(df) FROM f) AS df FROM tok)
SELECT doc_id AS p_partkey, round(sum((1 - f.d / least(length(w), 6)) * ln(1 + (n - m.df + 0.5) / (m.df + 0.5)) * len(list_filter(t, lambda x: x = w)) / (len(list_filter(t, lambda x: x = w)) + 1.2 * (0.25 + 0.75 * len(t) / mean))), 6) AS score
FROM tok JOIN v USING (doc_id) JOIN f USING (w), m GROUP BY doc_id""",
)


def phrase_score(terms: list[str], freq: str, lists: str) -> str:
    """SQL of a phrase's score: `lists` are columns for `freq`, which is computed from them."""
    idfs = " + ".join(idf(k) for k in range(len(terms)))
    return f"WITH {TOK}, {stats(terms)}, p AS (SELECT doc_id, t, {lists} FROM tok), f AS (SELECT doc_id, t, {freq} AS f FROM p) SELECT doc_id, round(({idfs}) * f / (f + 1.2 * (0.25 + 0.75 * len(t) / mean)), 6) AS score FROM f, st WHERE f > 0"


PLACES = "list_filter(range(1, len(t) + 1), lambda i: t[i] = '{0}')"
by(
    documents, {"phrase": {"path": "text", "query": "with the", "slop": 2}}, name="phrase_slop_score",
    sql=phrase_score(
        ["with", "the"],
        "coalesce(list_sum(list_transform(list_distinct(list_concat(a, b)), lambda v: CASE WHEN greatest(list_min(list_filter(a, lambda p: p >= v)), list_min(list_filter(b, lambda p: p >= v))) - v <= 2 AND len(list_filter(a, lambda p: p >= v)) > 0 AND len(list_filter(b, lambda p: p >= v)) > 0 "
        "THEN 1.0 / (1 + greatest(list_min(list_filter(a, lambda p: p >= v)), list_min(list_filter(b, lambda p: p >= v))) - v) ELSE 0 END)), 0)",
        f"{PLACES.format('with')} AS a, list_transform({PLACES.format('the')}, lambda i: i - 1) AS b",
    ),
)
#: Of a repeated term, one place stands for one of the words only.
SECOND = "list_min(list_filter(a, lambda p: p - 1 >= v AND p <> list_min(list_filter(a, lambda x: x >= v))))"
by(
    documents, {"phrase": {"path": "text", "query": "de de", "slop": 3}}, name="phrase_slop_repeated",
    sql=phrase_score(
        ["de", "de"],
        f"coalesce(list_sum(list_transform(list_distinct(list_concat(a, list_transform(a, lambda i: i - 1))), lambda v: CASE WHEN coalesce(greatest(list_min(list_filter(a, lambda p: p >= v)), {SECOND} - 1) - v, 99) <= 3 AND {SECOND} IS NOT NULL "
        f"THEN 1.0 / (1 + greatest(list_min(list_filter(a, lambda p: p >= v)), {SECOND} - 1) - v) ELSE 0 END)), 0)",
        f"{PLACES.format('de')} AS a",
    ),
)
by(
    documents, {"span": {"near": {"clauses": [{"term": {"path": "text", "query": "the"}}, {"term": {"path": "text", "query": "of"}}], "slop": 1, "inOrder": True}}}, name="span_near_score",
    sql=phrase_score(["the", "of"], "coalesce(list_sum(list_transform(a, lambda i: CASE WHEN t[i+1] = 'of' THEN 1.0 ELSE 0 END + CASE WHEN t[i+2] = 'of' THEN 0.5 ELSE 0 END)), 0)", f"{PLACES.format('the')} AS a"),
)
by(
    documents, {"span": {"first": {"operator": {"term": {"path": "text", "query": ["the", "la"]}}, "endPositionLte": 5}}}, name="span_first_score",
    sql=phrase_score(["the", "la"], "len(list_filter(a, lambda x: x IN ('the', 'la')))", "t[1:5] AS a"),
)
by(
    documents, {"search": {"path": "text", "query": "of the", "phrase": {}}}, name="search_phrase_legacy",
    sql=phrase_score(["of", "the"], "len(list_filter(a, lambda i: t[i+1] = 'the'))", f"{PLACES.format('of')} AS a"),
)
by(
    documents, {"text": {"path": "text", "query": "with thing that", "score": {"boost": {"value": 3}}}}, "lang", name="text_sorted_by_field", limit=30, sort={"lang": -1, "unused": {"$meta": "searchScore"}},
    sql=f"WITH {TOK}, {stats(['with', 'thing', 'that'])} SELECT doc_id, lang, round(3 * ({' + '.join(bm25(k, tf(w)) for k, w in enumerate(['with', 'thing', 'that']))}), 6) AS score FROM tok JOIN documents USING (doc_id), st WHERE {' OR '.join(f'{tf(w)} > 0' for w in ['with', 'thing', 'that'])} ORDER BY lang DESC, {' + '.join(bm25(k, tf(w)) for k, w in enumerate(['with', 'thing', 'that']))} DESC, doc_id LIMIT 30",
)


@query(f"""WITH {TOK}, {stats(['with', 'thing'])}, d AS (SELECT doc_id, t, unnest([0, 1]) AS k FROM tok)
SELECT doc_id, CASE k WHEN 0 THEN 'text:with' ELSE 'text:thing' END AS part, round(CASE k WHEN 0 THEN {bm25(0, tf('with'))} ELSE {bm25(1, tf('thing'))} END, 6) AS value, round(CASE k WHEN 0 THEN {idf(0)} ELSE {idf(1)} END, 6) AS idf,
CAST(CASE k WHEN 0 THEN {tf('with')} ELSE {tf('thing')} END AS DOUBLE) AS freq, CAST(len(t) AS DOUBLE) AS dl FROM d, st WHERE CASE k WHEN 0 THEN {tf('with')} ELSE {tf('thing')} END > 0""")
def score_details_parts(spark, sf_dir):
    found = q.search(documents(spark, sf_dir), {"text": {"path": "text", "query": "with thing"}, "scoreDetails": True, "limit": None})
    parts_of = found.select("doc_id", F.inline("__details.details"))
    part = lambda name: F.filter("details", lambda d: d["description"] == name)[0]["value"]
    return parts_of.select("doc_id", F.col("description").alias("part"), F.round("value", 6).alias("value"), F.round(part("idf"), 6).alias("idf"), part("freq").alias("freq"), part("dl").alias("dl"))


def _shown(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda x: F.concat(x["type"], F.lit(":"), x["value"])), "|")


@query("""SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'hit:red|text: |hit:widget' WHEN p_name LIKE 'red %' THEN 'hit:red|text:' || substr(p_name, 4) ELSE 'text:' || split_part(p_name, ' ', 1) || ' |hit:widget' END AS texts,
round(CASE WHEN p_name = 'red widget' THEN 2 ELSE 1 END * (1 + ln(1 / 3.0 + 1)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length(p_name) / 87)), 6) AS score FROM part WHERE p_name LIKE 'red %' OR p_name LIKE '% widget'""")
def highlight_hits(spark, sf_dir):
    found = q.search(parts(spark, sf_dir), {"text": {"path": "p_name", "query": "red widget"}, "highlight": {"path": "p_name"}, "limit": None})
    first = F.col("__highlights")[0]
    return found.select("p_partkey", _shown(first["texts"]).alias("texts"), F.round(first["score"], 6).alias("score"))


@query("""SELECT 'price' AS facet, '100.0' AS label, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100) AS count, 1 AS rank""")
def facets_sideways_without_empty_buckets(spark, sf_dir):
    facets = {"price": FACETS["price"] | {"boundaries": [0, 100, 1e9]}}
    facets["price"].pop("default")
    return q.search_meta(orders(spark, sf_dir), {"facet": {"operator": SIDEWAYS, "facets": facets}})


NEAR_TERMS = ["of", "the", "and", "in", "to"]
_FIRST = [f"list_min(list_filter(range(i, least(i + 9, len(t) + 1)), lambda j: t[j] = '{w}'))" for w in NEAR_TERMS]
by(
    documents, {"span": {"near": {"clauses": [{"term": {"path": "text", "query": w}} for w in NEAR_TERMS], "slop": 4}}}, name="span_near_many_unordered", score=False,
    sql=f"WITH {TOK} SELECT doc_id FROM tok WHERE len(list_filter(range(1, len(t) + 1), lambda i: " + " AND ".join(f"{x} IS NOT NULL" for x in _FIRST) + f" AND greatest({', '.join(_FIRST)}) - i + 1 - {len(NEAR_TERMS)} <= 4)) > 0",
)


@query(f"""WITH {TOK}, n AS (SELECT doc_id, CAST(len(t) AS INT) AS length, CAST(greatest(floor(log2(greatest(len(t) - 24, 1))) - 3, 0) AS INT) AS s FROM tok)
SELECT doc_id, length, CAST(CASE WHEN length < 40 THEN length ELSE 24 + (((length - 24) >> s) << s) END AS INT) AS kept FROM n""")
def length_norms(spark, sf_dir):
    """Lengths as one byte keeps them, beside exact ones."""
    length = F.col("__len_text__lucene_simple")
    return documents(spark, sf_dir).docs.select("doc_id", length.alias("length"), quantized_length(length).cast("int").alias("kept"))
