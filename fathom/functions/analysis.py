"""Text analysis as Columns: char filters, one tokenizer, token filters; array<struct<term, pos>>.

All stock steps that Spark's functions can express run in the JVM. Stemmers, Unicode folding, phonetic codes and word
delimiters are one Arrow UDF over the array at the end of a column's analysis: tables keep analysed arrays, so it
runs when an index is written, not when it is queried.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from html.entities import name2codepoint
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import stemming
from fathom.functions.snowball import STEMMERS as STEMMERS_BY_NAME

TOKENS = "array<struct<term:string,pos:int>>"
LETTER, DIGIT = r"[\p{L}\p{M}]", r"\p{N}"
#: Words as UAX #29 has them for alphabets: a point or apostrophe between letters and a comma or point between digits don't cut.
STANDARD = rf"(?:[\p{{L}}\p{{M}}\p{{N}}_]|(?<={LETTER})[.'’:·](?={LETTER})|(?<={DIGIT})[.,;'](?={DIGIT}))+"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
URL_EMAIL = r"(?:https?|ftp)://[^\s<>\"']+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|" + STANDARD
#: Published stop words of four languages.
ENGLISH_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
STOP: dict[str, list[str]] = {
    "english": ENGLISH_STOP,
    "french": "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés".split(),
    "german": "aber alle als also am an auch auf aus bei bin bis bist da das dass dein dem den der des die dies dir doch du durch ein eine einem einen einer eines er es für hat ich ihm ihn ihr im in ist ja kein mein mich mir mit nach nicht noch nun nur ob oder ohne sehr sein sich sie sind so um und uns unter vom von vor war was wie wir wo zu zum zur über".split(),
    "spanish": "a al algo como con de del desde donde el ella ellas ellos en entre era es esa ese esta este esto fue ha hay la las le les lo los me mi mis muy más nada ni no nos o os para pero por que se si sin sobre su sus también te tu tus un una uno y ya yo él".split(),
}
#: A character reference: decimal, hexadecimal, or one of the names of HTML 4 (with apos), each with or without its semicolon.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,7});?"
FOLD_FROM = "ÀÁÂÃÄÅàáâãäåĀāĂăĄąÇçĆćČčĎďÈÉÊËèéêëĒēĖėĘęĚěÌÍÎÏìíîïĪīĮįİıŁłÑñŃńŇňÒÓÔÕÖØòóôõöøŌōŐőŔŕŘřŚśŞşŠšŢţŤťÙÚÛÜùúûüŪūŮůŰűŲųÝýÿŸŹźŻżŽž"
FOLD_TO = "AAAAAAaaaaaaAaAaAaCcCcCcDdEEEEeeeeEeEeEeEeIIIIiiiiIiIiIiLlNnNnNnOOOOOOooooooOoOoRrRrSsSsSsTtTtUUUUuuuuUuUuUuUuYyyYZzZzZz"
FOLD_MORE = [("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("ß", "ss"), ("ẞ", "SS"), ("Þ", "TH"), ("þ", "th"), ("Đ", "D"), ("đ", "d"), ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-")]

#: Filters in Python, of a list of (term, position).
Tokens = list[tuple[str, int]]


def fold_ascii(term: str) -> str:
    return reduce(lambda t, p: t.replace(*p), FOLD_MORE, term.translate(str.maketrans(FOLD_FROM, FOLD_TO)))


def icu_fold(term: str) -> str:
    term = unicodedata.normalize("NFKC", term).casefold()
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c)))


def _each(f: Callable[[str], str]) -> Callable[[Tokens], Tokens]:
    return lambda tokens: [(f(t), p) for t, p in tokens]


def _many(f: Callable[[str], list[str]]) -> Callable[[Tokens], Tokens]:
    return lambda tokens: [(x, p) for t, p in tokens for x in f(t)]


def _soundex(include: bool) -> Callable[[Tokens], Tokens]:
    return _many(lambda t: [*([t] if include or not stemming.daitch_mokotoff(t) else []), *stemming.daitch_mokotoff(t)])


def _delimited(options: dict) -> Callable[[Tokens], Tokens]:
    def run(tokens: Tokens) -> Tokens:
        out, shift = [], 0
        for t, p in tokens:
            placed = stemming.word_delimiter(t, options)
            out += [(x, p + shift + k) for x, k in placed]
            shift += max((k for _, k in placed), default=0)
        return out

    return run


def _python_filters(definition: dict) -> Callable[[Tokens], Tokens] | None:
    kind = definition["type"]
    if kind == "snowballStemming":
        name = definition["stemmerName"]
        if name != "porter" and name not in STEMMERS_BY_NAME:
            raise ValueError(f"no stemmer for {name}")
        return _each(stemming.porter if name == "porter" else STEMMERS_BY_NAME[name])
    if kind == "lightStemming":
        return _each(stemming.LIGHT[definition["language"]])
    if kind in ("kStemming", "stempel"):
        raise ValueError(f"no stemmer for {kind}: its lexicon isn't here, and another's stems would be wrong")
    if kind == "icuNormalizer":
        form = {"nfc": "NFC", "nfd": "NFD", "nfkc": "NFKC", "nfkd": "NFKD"}[definition.get("normalizationForm", "nfc")]
        return _each(lambda t: unicodedata.normalize(form, t))
    if kind == "daitchMokotoffSoundex":
        return _soundex(definition.get("originalTokens", "include") == "include")
    if kind == "wordDelimiterGraph":
        return _delimited(definition.get("delimiterOptions", {}) | {"protectedWords": definition.get("protectedWords", {}).get("words", [])})
    return {
        "icuFolding": _each(icu_fold), "porterStemming": _each(stemming.porter),
        "englishMinimalStemming": _each(stemming.english_minimal), "spanishPluralStemming": _each(stemming.spanish_plural),
    }.get(kind)


def terms(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda tokens: F.transform(tokens, lambda t: F.struct(f(t["term"]).alias("term"), t["pos"].alias("pos")))


def expand(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """f gives the terms that stand at a term's position."""
    return lambda tokens: F.flatten(F.transform(tokens, lambda t: F.transform(f(t["term"]), lambda x: F.struct(x.alias("term"), t["pos"].alias("pos")))))


def _grams(term: Column, least: int, most: int, edge: bool, keep: bool) -> Column:
    top = F.least(F.length(term), F.lit(most))
    if edge:
        grams = F.transform(F.sequence(F.lit(least), top), lambda n: F.substring(term, F.lit(1), n))
    else:
        grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length(term) - least + 1), lambda at: F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(term) - at + 1)), lambda n: F.substring(term, at, n))))
    short, long = F.length(term) < least, F.length(term) > most
    found = F.when(short, F.array(term) if keep else F.expr("array()").cast("array<string>")).otherwise(grams)
    return F.when(long, F.concat(found, F.array(term))).otherwise(found) if keep else found


def _shingles(tokens: Column, least: int, most: int, unigrams: bool = False) -> Column:
    sizes = [1, *range(least, most + 1)] if unigrams else list(range(least, most + 1))
    every = [_shingle(tokens, n) for n in sizes]
    return F.array_sort(F.concat(*every), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(F.length(a["term"]) - F.length(b["term"])))


def _shingle(tokens: Column, n: int) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda at: F.struct(F.array_join(F.transform(F.slice(tokens, at, F.lit(n)), lambda t: t["term"]), " ").alias("term"), F.element_at(tokens, at)["pos"].alias("pos")))
    return F.when(F.size(tokens) >= n, made).otherwise(F.expr("array()").cast(TOKENS))


def _char_filter(definition: dict) -> Callable[[Column], Column]:
    kind = definition["type"]
    if kind == "htmlStrip":
        kept = "|".join(definition.get("ignoredTags", []))
        tag = rf"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>|</?(?!(?:{kept})\b)[a-zA-Z!][^>]*>" if kept else r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>|</?[a-zA-Z!][^>]*>"
        return lambda c: _replaced(F.regexp_replace(c, tag, " "), REFERENCE, _referred)
    if kind == "mapping":
        # The longest key that matches at a place, in one pass: what stands for it isn't mapped again.
        pairs = {k: v for k, v in sorted(definition["mappings"].items(), key=lambda p: -len(p[0])) if k}
        if not pairs:
            return lambda c: c
        table = F.create_map(*[F.lit(x) for p in pairs.items() for x in p])
        return lambda c: _replaced(c, "|".join(_quoted(k) for k in pairs), lambda found: F.element_at(table, found))
    if kind == "persian":
        return lambda c: F.translate(c, "‌", " ")
    if kind == "icuNormalize":
        return _icu_text
    raise ValueError(f"unknown char filter {kind}")


def _quoted(text: str) -> str:
    """text as a Java pattern of itself."""
    return "".join(ch if ch.isalnum() else f"\\x{{{ord(ch):x}}}" for ch in text)


def _replaced(c: Column, pattern: str, to: Callable[[Column], Column]) -> Column:
    """c with to(match) in the place of each match: the pieces between the matches and what stands for these alternate."""
    pieces, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("piece"), found.alias("found")), lambda x: F.array(x["piece"], F.when(x["found"].isNull(), "").otherwise(to(x["found"]))))), "")
    return F.when(c.rlike(pattern), joined).otherwise(c)


def _referred(found: Column) -> Column:
    """The character of a reference; a name or number that stands for none stays as it is."""
    names = name2codepoint | {"apos": 39}
    table = F.create_map(*[F.lit(x) for p in sorted(names.items()) for x in p])
    body = F.regexp_replace(found, "^&#?[xX]?|;$", "")
    code = F.when(found.rlike("^&#[xX]"), F.conv(body, 16, 10).cast("long")).when(found.startswith("&#"), body.cast("long")).otherwise(F.element_at(table, body).cast("long"))
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(found)


def _icu_text(c: Column) -> Column:
    @F.arrow_udf("string")
    def normal(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.normalize("NFKC", v).casefold() for v in x.to_pylist()], pa.string())

    return normal(c)


def _tokenizer(definition: dict) -> Callable[[Column], Column]:
    """Text to array<string>."""
    kind = definition["type"]
    longest = definition.get("maxTokenLength", 255)
    cut = lambda words: F.flatten(F.transform(words, lambda w: F.when(F.length(w) <= longest, F.array(w)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / longest).cast("int")), lambda k: F.substring(w, k * longest + 1, F.lit(longest))))))
    every = lambda pattern, group=0: lambda c: F.regexp_extract_all(c, F.lit(pattern if group or pattern.startswith("(?:") else f"(?:{pattern})"), F.lit(group))
    if kind == "standard":
        return lambda c: cut(every(STANDARD)(c))
    if kind == "uaxUrlEmail":
        return lambda c: cut(every(URL_EMAIL)(c))
    if kind == "whitespace":
        return lambda c: cut(every(r"\S+")(c))
    if kind == "letter":
        return every(r"\p{L}+")
    if kind == "keyword":
        return lambda c: F.array(c)
    if kind in ("edgeGram", "nGram"):
        return lambda c: _grams(c, definition["minGram"], definition["maxGram"], kind == "edgeGram", False)
    if kind == "regexSplit":
        return lambda c: F.filter(F.split(c, definition["pattern"], -1), lambda x: x != "")
    if kind == "regexCaptureGroup":
        return every(definition["pattern"], definition["group"])
    if kind == "cjk":
        return every(rf"{CJK}{{1,2}}|(?:(?!{CJK})[\p{{L}}\p{{N}}_])+")
    raise ValueError(f"unknown tokenizer {kind}")


def _token_filter(definition: dict) -> Callable[[Column], Column]:
    kind = definition["type"]
    if kind == "lowercase":
        return terms(F.lower)
    if kind == "asciiFolding":
        fold = lambda t: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), FOLD_MORE, F.translate(t, FOLD_FROM, FOLD_TO))
        return expand(lambda t: F.array_distinct(F.array(fold(t), t))) if definition.get("originalTokens", "omit") == "include" else terms(fold)
    if kind in ("edgeGram", "nGram"):
        return expand(lambda t: _grams(t, definition["minGram"], definition["maxGram"], kind == "edgeGram", definition.get("termNotInBounds", "omit") == "include"))
    if kind == "shingle":
        return lambda tokens: _shingles(tokens, definition["minShingleSize"], definition["maxShingleSize"])
    if kind == "wordShingle":
        return lambda tokens: _shingles(tokens, 2, 3, True)
    if kind == "truncate":
        return terms(lambda t: F.substring(t, 1, definition["length"]))
    if kind == "stopword":
        words = definition["tokens"]
        lower = definition.get("ignoreCase", True)
        stop = F.array(*[F.lit(w.lower() if lower else w) for w in words]) if words else None
        return lambda tokens: tokens if stop is None else F.filter(tokens, lambda t: ~F.array_contains(stop, F.lower(t["term"]) if lower else t["term"]))
    if kind == "length":
        return lambda tokens: F.filter(tokens, lambda t: F.length(t["term"]).between(definition.get("min", 0), definition.get("max", 255)))
    if kind == "limitTokenCount":
        return lambda tokens: F.slice(tokens, 1, definition["maxTokenCount"])
    if kind == "regex":
        if definition["matches"] == "all":
            return terms(lambda t: F.regexp_replace(t, definition["pattern"], definition["replacement"]))
        first = f"(?s)^(.*?)(?:{definition['pattern']})"
        return terms(lambda t: F.regexp_replace(t, first, "$1" + definition["replacement"]))
    if kind == "reverse":
        return terms(F.reverse)
    if kind == "trim":
        return terms(F.trim)
    if kind == "removeDuplicates":
        return F.array_distinct
    if kind == "keywordRepeat":
        return expand(lambda t: F.array(t, t))
    if kind == "englishPossessive":
        return terms(lambda t: F.regexp_replace(t, "['’＇][sS]$", ""))
    if kind == "flattenGraph":
        return lambda tokens: tokens
    if (python := _python_filters(definition)) is not None:
        kept = frozenset(definition.get("exclude", ()))
        return _udf((lambda tokens: [x for t, p in tokens for x in ([(t, p)] if t in kept else python([(t, p)]))]) if kept else python)
    raise ValueError(f"unknown token filter {kind}")


STEMMERS = frozenset("lightStemming porterStemming kStemming englishMinimalStemming spanishPluralStemming stempel snowballStemming".split())
PYTHON_FILTERS = frozenset("lightStemming icuFolding icuNormalizer porterStemming kStemming englishMinimalStemming spanishPluralStemming stempel snowballStemming daitchMokotoffSoundex wordDelimiterGraph".split())


def _udf(f: Callable[[Tokens], Tokens]) -> Callable[[Column], Column]:
    kind = pa.list_(pa.struct([("term", pa.string()), ("pos", pa.int32())]))

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else [{"term": t, "pos": p} for t, p in f([(x["term"], x["pos"]) for x in r])] for r in rows.to_pylist()], kind)

    # The array goes in as it is, of whatever type its steps gave it.
    wrapped = F.arrow_udf(run, TOKENS)
    return lambda tokens: wrapped(tokens)


def _letters(text: Column) -> Column:
    """Runs of letters in lower case, as the letter tokenizer and the lowercase filter give them: from the text in lower case, without a lambda for each term.

    A text in lower case has its letters where they were, but for the dotted capital I, which becomes two characters, capital sigma, of which the letters around it decide, and characters
    that the patterns' Unicode doesn't know yet. Those texts and those that may have a term of over 32,766 bytes have each term changed by itself.
    """
    letters = lambda c: F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0))
    each = F.transform(F.filter(letters(text), lambda w: F.octet_length(w) <= 32766), F.lower)
    alone = text.rlike("[\u0130\u03a3\\p{Cn}]") | ((F.octet_length(text) > 32766) & text.rlike(r"\p{L}{8000}"))
    return F.when(alone, each).otherwise(letters(F.lower(text)))


def placed(words: Column) -> Column:
    """Terms with their places. Without a lambda, so in compiled code; words must be a column, as they are named three times."""
    return F.when(F.size(words) > 0, F.arrays_zip(words.alias("term"), F.sequence(F.lit(0), F.size(words) - 1).alias("pos"))).otherwise(F.expr("array()").cast(TOKENS))


def generated(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row, where it stands."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*rest, F.inline(F.array(F.struct(value.alias(name)))))


@dataclass(frozen=True)
class Analyzer:
    """Char filters, a tokenizer and token filters, in that order. Long terms (32,766 bytes) are left out."""

    name: str
    tokenizer: dict
    char_filters: tuple = ()
    token_filters: tuple = ()
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def native(self) -> bool:
        return not any(f["type"] in PYTHON_FILTERS for f in self.token_filters) and not any(f["type"] == "icuNormalize" for f in self.char_filters)

    def words(self, text: Column) -> Column | None:
        """array<string> of the terms, to be placed(); None of an analyzer that doesn't have them at once."""
        if self.tokenizer["type"] == "letter" and not self.char_filters and [f["type"] for f in self.token_filters] == ["lowercase"]:
            return _letters(F.coalesce(text.cast("string"), F.lit("")))
        return None

    @property
    def counted(self) -> bool:
        """Whether terms of a text stand at 0, 1, 2 and so on: no filter leaves one out or adds one."""
        return all(f["type"] == "lowercase" for f in self.token_filters)

    def tokens(self, text: Column) -> Column:
        """array<struct<term, pos>>; null text has no tokens."""
        return reduce(lambda c, step: step(c), self.steps(), text)

    def steps(self) -> list[Callable[[Column], Column]]:
        """The analysis, cut around each step in Python: the first part starts at the text."""

        def first(text: Column) -> Column:
            text = F.coalesce(text.cast("string"), F.lit(""))
            text = reduce(lambda c, d: _char_filter(d)(c), self.char_filters, text)
            words = F.filter(_tokenizer(self.tokenizer)(text), lambda w: (w != "") & (F.octet_length(w) <= 32766))
            return F.transform(words, lambda w, k: F.struct(w.alias("term"), k.alias("pos")))

        out = [first]
        for d in self.token_filters:
            out.append(_token_filter(d))
        return out

    def added(self, df: DataFrame, text: Column, name: str) -> DataFrame:
        """df with the tokens of a text as a column.

        They come from a generator: each row is analysed once, and filters are pushed below it, but not copied into it
        as into a projection. Steps in Python get a column of their own, never an expression with lambdas in it:
        Catalyst doesn't always recognise those again when it takes Python functions out of a plan.
        """
        python = {k for k, d in enumerate(self.token_filters, 1) if d["type"] in PYTHON_FILTERS}
        made: Column = text
        if any(d["type"] == "icuNormalize" for d in self.char_filters):
            df = df.withColumn(name, F.coalesce(text.cast("string"), F.lit("")))
            for d in self.char_filters:
                df = df.withColumn(name, _char_filter(d)(F.col(name)))
            return replace(self, char_filters=()).added(df, F.col(name), name)
        for k, step in enumerate(self.steps()):
            if k in python:
                df = generated(df, name, made)
                df = df.withColumn(name, step(F.col(name)))
                made = F.col(name)
            else:
                made = step(made)
        return df if max(python, default=0) == len(self.token_filters) and python else generated(df, name, made)

    def normalized(self, text: Column) -> Column:
        """The term-level form: char and token filters of the whole text, no tokenizer; the first term."""
        text = reduce(lambda c, d: _char_filter(d)(c), self.char_filters, text.cast("string"))
        tokens = F.array(F.struct(text.alias("term"), F.lit(0).alias("pos")))
        return F.get(reduce(lambda c, d: _token_filter(d)(c), self.token_filters, tokens), F.lit(0))["term"]

    def normal(self, spark: SparkSession, text: str) -> str:
        """normalized() of a query string; empty if nothing is left."""
        return spark.sql("SELECT * FROM VALUES (:text) AS rows(t)", {"text": text}).select(self.normalized(F.col("t")).alias("t")).first()["t"] or ""

    def analyze(self, spark: SparkSession, text: str) -> Tokens:
        """The same analysis of a query string."""
        if text not in self._cache:
            # Rows of a VALUES clause are analysed by the optimizer, without a job.
            rows = spark.sql("SELECT * FROM VALUES (:text) AS rows(t)", {"text": text}).select(self.tokens(F.col("t")).alias("tokens")) if self.native else self.added(spark.createDataFrame([(text,)], "t string"), F.col("t"), "tokens")
            self._cache[text] = [(t["term"], t["pos"]) for t in rows.first()["tokens"]]
        return self._cache[text]


def _language(name: str, *filters: dict) -> Analyzer:
    stop = ({"type": "stopword", "tokens": STOP[name]},) if name in STOP else ()
    return Analyzer(f"lucene.{name}", {"type": "standard"}, (), ({"type": "lowercase"}, *stop, *filters))


STOCK: dict[str, Analyzer] = {
    "lucene.standard": Analyzer("lucene.standard", {"type": "standard"}, (), ({"type": "lowercase"},)),
    "lucene.simple": Analyzer("lucene.simple", {"type": "letter"}, (), ({"type": "lowercase"},)),
    "lucene.whitespace": Analyzer("lucene.whitespace", {"type": "whitespace"}),
    "lucene.keyword": Analyzer("lucene.keyword", {"type": "keyword"}),
    "lucene.stop": Analyzer("lucene.stop", {"type": "letter"}, (), ({"type": "lowercase"}, {"type": "stopword", "tokens": ENGLISH_STOP})),
    "lucene.english": Analyzer("lucene.english", {"type": "standard"}, (), ({"type": "englishPossessive"}, {"type": "lowercase"}, {"type": "stopword", "tokens": ENGLISH_STOP}, {"type": "porterStemming"})),
}
for _name in "dutch swedish norwegian danish russian".split():
    STOCK[f"lucene.{_name}"] = _language(_name, {"type": "snowballStemming", "stemmerName": _name})
#: These languages' analyzers have light stemmers.
for _name in "french german spanish italian portuguese".split():
    STOCK[f"lucene.{_name}"] = _language(_name, {"type": "lightStemming", "language": _name})
#: Languages without a stemmer of ours: words in lower case (and without stop words, where there is a list).
for _name in "arabic armenian basque bengali brazilian bulgarian catalan czech finnish galician greek hindi hungarian indonesian irish latvian lithuanian persian romanian sorani thai turkish morfologik polish ukrainian".split():
    STOCK[f"lucene.{_name}"] = _language(_name)
for _name in "cjk chinese japanese korean smartcn kuromoji nori".split():
    STOCK[f"lucene.{_name}"] = Analyzer(f"lucene.{_name}", {"type": "cjk"}, (), ({"type": "lowercase"},))


def custom(definition: dict[str, Any]) -> Analyzer:
    """An analyzer from its definition: name, tokenizer, charFilters, tokenFilters; or a stock one with stopwords or stemExclusionSet."""
    if "baseAnalyzer" in definition:
        base = STOCK[definition["baseAnalyzer"]]
        filters = list(base.token_filters)
        if "stopwords" in definition:
            filters = [f for f in filters if f["type"] != "stopword"]
            at = next((k for k, f in enumerate(filters) if f["type"] not in ("englishPossessive", "lowercase")), len(filters))
            filters.insert(at, {"type": "stopword", "tokens": definition["stopwords"], "ignoreCase": definition.get("ignoreCase", True)})
        if definition.get("stemExclusionSet"):
            filters = [f | {"exclude": list(definition["stemExclusionSet"])} if f["type"] in STEMMERS else f for f in filters]
        if definition.get("maxTokenLength"):
            return Analyzer(definition["name"], base.tokenizer | {"maxTokenLength": definition["maxTokenLength"]}, base.char_filters, tuple(filters))
        return Analyzer(definition["name"], base.tokenizer, base.char_filters, tuple(filters))
    return Analyzer(definition["name"], definition["tokenizer"], tuple(definition.get("charFilters", ())), tuple(definition.get("tokenFilters", ())))


def autocomplete(base: Analyzer, kind: str = "edgeGram", least: int = 2, most: int = 15, fold: bool = True) -> Analyzer:
    """Grams of words and of two and three words in a row; rightEdgeGram takes them from the end."""
    filters = [*base.token_filters, *([{"type": "asciiFolding"}] if fold else []), {"type": "wordShingle"}]
    if kind == "rightEdgeGram":
        filters += [{"type": "reverse"}, {"type": "edgeGram", "minGram": least, "maxGram": most, "termNotInBounds": "include"}, {"type": "truncate", "length": most}, {"type": "reverse"}]
    else:
        filters += [{"type": kind, "minGram": least, "maxGram": most, "termNotInBounds": "include"}, {"type": "truncate", "length": most}]
    return Analyzer(f"{base.name}/{kind}/{least}/{most}/{fold}", base.tokenizer, base.char_filters, tuple(filters))
