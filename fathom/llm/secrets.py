"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings; DataFrame functions only.

A candidate is a run of token characters. Its character class (hex, letters, mixed) gives the entropy that a window
must reach. The counts of a window follow from those of the one before: one character leaves, one enters, and the
sum of c*log2(c) changes by two table entries. Counts are packed into a few numbers, so that a step costs the same
whatever the candidate's length; long candidates are looked at in pieces that overlap by a window less one character.
The table is in whole millionths, so that the sums are exact.
Candidates on the allow-list (placeholders, alphabets, identifiers that are no secrets) are suppressed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.shared import words_of

#: `letters there in either case` are those of the key words; the value's class has both cases.
ASSIGN = "(" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # leftmost maximal runs, as AKIA[A-Z0-9]+ of 18 or more characters
HEX = "[0-9a-f]{16,}"
WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits that a window's entropy must reach, by character class. 20 random hex digits have 3.3 on average, 20 random base64 characters 4.1.
BITS = {"hex": 3.0, "letters": 4.2, "mixed": 3.9}
CLASS_PATTERN = {"hex": "^([0-9a-f]+|[0-9A-F]+)$", "letters": "^([a-z]+|[A-Z]+|[A-Z][a-z]+)$"}
ALLOWED = r"(?i)example|sample|placeholder|changeme|dummy|lorem|x{6}|abcdefgh|0123456789|1234567890|qwerty|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[-_=+/]+$|^[0-9_/=+-]+$"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_letters", "entropy_mixed")
MICRO = [round(c * math.log2(c) * 1e6) if c else 0 for c in range(WINDOW + 2)]
#: Windows of a candidate that are counted in one go; matches whose places are summed up in one go, at least.
PIECE, BLOCK = 256, 64
#: A count is at most WINDOW: so many bits; counts of so many characters are in one number.
COUNT_BITS, PACKED = WINDOW.bit_length(), 60 // WINDOW.bit_length()
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def most(cls: str) -> int:
    """The sum of c*log2(c) that a window of this class may have: entropy is log2(W) - sum / W."""
    return math.floor(WINDOW * (math.log2(WINDOW) - BITS[cls]) * 1e6)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points: the matches and the pieces between them alternate.

    Places are prefix sums of lengths, within blocks of the square root of the number of matches, and over the blocks.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")
    length = lambda x: F.length(x["piece"]) + F.coalesce(F.length(x["value"]), F.lit(0))

    def folded(rows: Column, at: Column) -> Column:
        start = lambda acc, x: acc["at"] + F.length(x["piece"])
        end = lambda acc, x: acc["at"] + length(x)
        span = lambda acc, x: F.struct(start(acc, x).alias("start"), end(acc, x).alias("end"), x["value"].alias("value"))
        step = lambda acc, x: F.when(x["value"].isNull(), acc).otherwise(F.struct(end(acc, x).alias("at"), F.concat(acc["spans"], F.array(span(acc, x))).alias("spans")))
        return F.aggregate(rows, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    def of_blocks(rows: Column) -> Column:
        size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(rows))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / size).cast("int")), lambda k: F.slice(rows, k * size + 1, size))
        ends = lambda own: F.aggregate(own, F.array(F.lit(0)), lambda acc, rows: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(rows, F.lit(0), lambda n, x: n + length(x)))))
        return let(blocks, lambda own: F.flatten(F.zip_with(own, F.slice(ends(own), 1, F.size(own)), folded)))

    fold = let(F.arrays_zip(pieces.alias("piece"), found.alias("value")), lambda rows: F.when(F.size(rows) <= BLOCK, folded(rows, F.lit(0))).otherwise(of_blocks(rows)))
    return F.when(text.rlike(pattern), fold).otherwise(none)


def char_class(value: Column) -> Column:
    return F.when(value.rlike(CLASS_PATTERN["hex"]), "hex").when(value.rlike(CLASS_PATTERN["letters"]), "letters").otherwise("mixed")


def entropy_range(value: Column, limit: Column) -> Column:
    """struct<first, last>: the first and last window starts of which the entropy reaches the class's bits, else nulls.

    A step adds the character that enters to the packed counts and takes away the one that leaves (0: none, yet).
    """
    table = F.array(*[F.lit(m) for m in MICRO])
    words = -(-(len(ALPHABET) + 1) // PACKED)
    names = [f"p{k}" for k in range(words)]
    one = lambda code: F.when(code > 0, F.call_function("shiftleft", F.lit(1).cast("long"), code % PACKED * COUNT_BITS)).otherwise(F.lit(0).cast("long"))
    held = lambda acc, code: F.call_function("shiftright", F.element_at(F.array(*[acc[n] for n in names]), F.floor(code / PACKED).cast("int") + 1), code % PACKED * COUNT_BITS).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        enter, leave = x["enter"], x["leave"]
        c_out = held(acc, leave)
        c_in = held(acc, enter) - (leave == enter).cast("int")
        gone = F.when(leave > 0, F.element_at(table, c_out) - F.element_at(table, c_out + 1)).otherwise(F.lit(0))
        total = acc["sum"] + gone + F.element_at(table, c_in + 2) - F.element_at(table, c_in + 1)
        in_word = lambda code, k: (code >= k * PACKED) & (code < (k + 1) * PACKED)
        packed = [(acc[n] + F.when(in_word(enter, k), one(enter)).otherwise(F.lit(0)) - F.when(in_word(leave, k), one(leave)).otherwise(F.lit(0))).alias(n) for k, n in enumerate(names)]
        hit = (acc["at"] >= 0) & (total <= limit)
        return F.struct(*packed, total.alias("sum"), (acc["at"] + 1).alias("at"), F.when(hit & acc["first"].isNull(), acc["at"]).otherwise(acc["first"]).alias("first"), F.when(hit, acc["at"]).otherwise(acc["last"]).alias("last"))

    def of_piece(piece: Column) -> Column:
        codes = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        none = F.lit(None).cast("int")
        begin = F.struct(*[F.lit(0).cast("long").alias(n) for n in names], F.lit(0).alias("sum"), F.lit(1 - WINDOW).alias("at"), none.alias("first"), none.alias("last"))
        moves = let(codes, lambda own: F.zip_with(own, F.slice(F.concat(F.array_repeat(F.lit(0), WINDOW), own), 1, F.size(own)), lambda a, b: F.struct(a.alias("enter"), b.alias("leave"))))
        return F.aggregate(moves, begin, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    cut = F.regexp_extract_all(value, F.lit(f"(.{{1,{PIECE}}})"), F.lit(1))
    pieces = let(cut, lambda own: F.zip_with(own, F.slice(F.concat(own, F.array(F.lit(""))), 2, F.size(own)), lambda a, b: F.concat(a, F.left(b, F.lit(WINDOW - 1)))))
    ranges = F.transform(pieces, lambda p, k: F.transform(F.array(of_piece(p)), lambda r: F.struct((r["first"] + k * PIECE).alias("first"), (r["last"] + k * PIECE).alias("last")))[0])
    return let(ranges, lambda rs: F.struct(F.array_min(F.transform(rs, lambda r: r["first"])).alias("first"), F.array_max(F.transform(rs, lambda r: r["last"])).alias("last")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and secrets, array<struct<start, kindno, end, kind>> sorted by start, then kind.

    start and end are code points of the whole text. Null and empty texts have no secrets; ids may be null or repeat;
    other columns are ignored. Patterns match leftmost and non-overlapping within a kind; kinds may overlap.
    """
    text = words_of(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    span = lambda no, start, end: F.struct(start.cast("int").alias("start"), F.lit(no).alias("kindno"), end.cast("int").alias("end"), F.lit(KINDS[no]).alias("kind"))
    rows = rows.select(
        "doc_id",
        F.filter(matches(F.col("text"), ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= ASSIGN_LEAST).alias("assign"),
        matches(F.col("text"), ACCESS).alias("access"),
        matches(F.col("text"), HEX).alias("hex"),
        F.filter(matches(F.col("text"), CANDIDATE), lambda m: ~m["value"].rlike(ALLOWED)).alias("candidates"),
    )
    classed = F.transform("candidates", lambda m: F.struct(m["start"].alias("start"), m["value"].alias("value"), char_class(m["value"]).alias("cls")))
    rows = rows.withColumn("classed", classed)
    limit = lambda cls: F.when(cls == "hex", most("hex")).when(cls == "letters", most("letters")).otherwise(most("mixed"))
    rows = rows.withColumn("hot", F.filter(F.transform("classed", lambda m: F.struct(m["start"].alias("start"), m["cls"].alias("cls"), entropy_range(m["value"], limit(m["cls"])).alias("at"))), lambda m: m["at"]["first"].isNotNull()))
    of_kind = lambda no: F.transform(KINDS[no], lambda m: span(no, m["start"], m["end"]))
    of_class = lambda no, cls: F.transform(F.filter("hot", lambda m: m["cls"] == cls), lambda m: span(no, m["start"] + m["at"]["first"], m["start"] + m["at"]["last"] + WINDOW))
    base, added = [of_kind(no) for no in range(3)], [of_class(no, cls) for no, cls in enumerate(BITS, 3)]
    return rows.select("doc_id", F.array_sort(F.concat(*base, *added)).alias("secrets"))


def digest(secrets: DataFrame) -> DataFrame:
    """The counts and joined spans of scan()'s rows."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda no: F.size(F.filter("secrets", lambda s: s["kindno"] == no)).cast("long")
    return secrets.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter("secrets", lambda s: s["kindno"] < 3)), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def oracle() -> str:
    sql = lambda s: s.replace("'", "''")
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidate": CANDIDATE}
    found = "\nUNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(t, '{sql(p)}') AS v, string_split_regex(t, '{sql(p)}') AS p FROM d" for k, p in kinds.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
i AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, v[i] AS val,
        coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS st FROM i),
c AS (SELECT *, CASE WHEN regexp_matches(val, '{CLASS_PATTERN["hex"]}') THEN 'hex' WHEN regexp_matches(val, '{CLASS_PATTERN["letters"]}') THEN 'letters' ELSE 'mixed' END AS cls
      FROM s WHERE kind = 'candidate' AND NOT regexp_matches(val, '{ALLOWED}')),
w AS (SELECT *, unnest(range(0, length(val) - {WINDOW} + 1)) AS a FROM c),
e AS (SELECT doc_id, st, cls, val, a,
        list_sum(list_transform(map_values(list_histogram(string_split(substr(val, CAST(a + 1 AS INT), {WINDOW}), ''))), lambda n: ({MICRO})[CAST(n + 1 AS INT)])) AS total FROM w),
h AS (SELECT doc_id, st, cls, min(a) AS lo, max(a) AS hi FROM e
      WHERE total <= CASE cls WHEN 'hex' THEN {most("hex")} WHEN 'letters' THEN {most("letters")} ELSE {most("mixed")} END GROUP BY doc_id, st, cls),
a AS (SELECT doc_id, st, st + length(val) AS en, kind, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS no FROM s
      WHERE kind <> 'candidate' AND (kind <> 'assign' OR length(regexp_extract(val, '{sql(ASSIGN)}', 2)) >= {ASSIGN_LEAST})
      UNION ALL SELECT doc_id, st + lo, st + hi + {WINDOW}, 'entropy_' || cls, CASE cls WHEN 'hex' THEN 3 WHEN 'letters' THEN 4 ELSE 5 END FROM h),
g AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
        string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, no) FILTER (no < 3) AS base, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, no) AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLE_SQL = {"op1_secret_scan": oracle()}
