import hashlib
import math
import random
import re
import time

from fathom.llm import secrets

ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="


def brute(text):
    """Spans by Python's own matcher and by entropy counted anew in each window."""
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        v = m[0]
        if re.search(secrets.ALLOWED, v):
            continue
        cls = "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v) else "letters" if re.fullmatch(r"[a-z]+|[A-Z]+|[A-Z][a-z]+", v) else "mixed"
        hit = []
        for a in range(len(v) - 19):
            w = v[a : a + 20]
            e = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
            if e >= secrets.BITS[cls] - 1e-6:
                hit.append(a)
        if hit:
            out.append((m.start() + hit[0], {"hex": 3, "letters": 4, "mixed": 5}[cls], m.start() + hit[-1] + 20))
    return sorted(out)


def digest_of(spans):
    named = [f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in spans]
    base = [n for n, (_, k, _) in zip(named, spans, strict=True) if k < 3]
    return tuple(sum(k == n for _, k, _ in spans) for n in range(3)) + (hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(named))


def test_brute_force(spark):
    rng = random.Random(5)
    word = lambda n, a=ALPHA: "".join(rng.choice(a) for _ in range(n))
    texts = [None, "", "no secrets here", "😀 PassWord: '" + word(12) + "'", "token=short", "api_key = abcdefghijkl.", "APIKEY:\"" + word(40) + "\"", "AKIA" + "A" * 14, "AKIA" + "B" * 13, "xAKIAAKIA" + word(20, "ABC09"), "ſecret: " + word(20), "0123456789abcdef", "0123456789abcde", "0123456789abcdefG" * 3]
    for _ in range(150):
        parts = [rng.choice([word(rng.randint(1, 60)), word(rng.randint(15, 40), "0123456789abcdef"), word(30, "ABCDEF0123456789"), "secret=" + word(rng.randint(8, 30)), "Token : " + word(14, "aB1"), "plain words", "é😀", "AKIA" + word(rng.randint(10, 20), "ABCXYZ0123456789"), word(40, "ab"), word(25, "abcdefghijklmnopqrstuvwxyz"), "example" + word(20)]) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice(["", " ", "\n", ","]).join(parts))
    texts.append(("word " + word(30) + " ") * 400)  # long
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, "secret=abcdefghijklmnop", "x", 1), (3, "twin", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string, start int")
    got = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in secrets.digest(secrets.scan(df)).collect()), key=repr)
    want = sorted(((i, *digest_of(brute(t))) for i, t, _, _ in rows), key=repr)
    assert got == want
    assert sum(bool(brute(t)) for t in texts) > 100


def test_empty(spark):
    assert secrets.digest(secrets.scan(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_native(spark, sf):
    plan = secrets.op1_secret_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Exchange"))


def test_long_candidates_and_many_matches(spark):
    rng = random.Random(9)
    word = lambda n, a=ALPHA: "".join(rng.choice(a) for _ in range(n))
    flat = lambda n: "Ab1-" * (n // 4)
    texts = [
        word(20 + secrets.PIECE), flat(5000) + word(30) + flat(5000), flat(300) + word(secrets.PIECE + 1), word(5000), "x " + flat(secrets.PIECE * 3 - 10) + word(40), flat(4000),
        *[flat(secrets.PIECE * 2 + k) + word(25) for k in range(-24, 24, 7)], " ".join(word(16, "0123456789abcdef") for _ in range(1000)), "é " * 300 + "😀, ".join("token=" + word(12) for _ in range(700)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in secrets.digest(secrets.scan(df)).collect()}
    for k, t in enumerate(texts):
        assert got[k] == digest_of(brute(t)), k


def test_a_candidate_of_a_megabyte_takes_linear_time(spark):
    rng = random.Random(10)
    seconds = []
    for n in (125_000, 1_000_000):
        df = spark.createDataFrame([(1, "".join(rng.choices(ALPHA, k=n)))], "doc_id long, text string")
        began = time.perf_counter()
        row = secrets.digest(secrets.scan(df)).first()
        seconds.append(time.perf_counter() - began)
        assert row["spans"].split(",")[-1].startswith("entropy_mixed:") and row["spans"].count("entropy") == 1
    assert seconds[1] < 60 and seconds[1] < 24 * seconds[0]
