import random
import re

import numpy as np
import xxhash

from fathom.llm import simhash
from fathom.llm.components import components


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def brute_components(ids, fps, bits=4):
    label = list(range(len(ids)))
    a = np.array(fps, np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[k]) <= bits).tolist():
            x, y = label[k], label[j]
            if x != y:
                label = [min(x, y) if v in (x, y) else v for v in label]
    least = {}
    for i, lab in zip(ids, label, strict=True):
        least[lab] = min(least.get(lab, i), i)
    return [least[lab] for lab in label]


def test_fingerprints():
    for t in (None, "", " \n", "One", "one two three", "A b c d\te É f", "x y " * 50, "a b c d", " ".join(map(str, range(500)))):
        assert simhash.fingerprint(t) == brute_fp(t), t


def test_every_near_pair_meets_at_an_anchor():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(2):
        b ^= np.uint64(1) << rng.integers(0, 32, 3000, dtype=np.uint64)
    x, y = simhash.anchors(a), simhash.anchors(b)
    assert max(len(set(p)) for p in x.tolist()) <= 17
    assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist(), strict=True))


def flipped(fp, bits, rng):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def signed(fp):
    return fp - 2**64 if fp >= 2**63 else fp


def test_links_against_all_pairs(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [flipped(f, rng.randint(1, 6), rng) for f in fps for _ in range(3)]
    chain = rng.getrandbits(64)
    for _ in range(40):  # a long chain of links of 4 bits
        chain = flipped(chain, 4, rng)
        fps.append(chain)
    fps += [flipped(fps[0] ^ 0xFF, rng.randint(0, 3), rng) for _ in range(300)] + [0, 2**64 - 1]
    fps = sorted(set(fps))
    want = brute_components(fps, fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for block in (4096, 16):  # small blocks cut crowded anchors
        found = {r["node"]: r["root"] for r in components(simhash.near_links(df, block=block)).collect()}
        groups = lambda label: sorted(sorted(f for f, x in zip(fps, label, strict=True) if x == y) for y in set(label))
        assert groups([found.get(signed(f), signed(f)) for f in fps]) == groups(want)


def test_documents(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(12)]
    rows = [(None, base[0], "s"), (5, None, "s"), (9, "", "s"), (9, "", "s")]
    for k, t in enumerate(base):
        rows += [(100 * k + 10, t, "s"), (100 * k + 20, t.upper(), "s"), (100 * k + 30, t + " more", "s")]
    rows += [(10_000 + k, base[3], "hot") for k in range(200)]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, fp int")
    fps = [brute_fp(t) for _, t, _ in rows]
    some = [i if i is not None else 10**9 for i, _, _ in rows]
    want = sorted(((i, f, c if c < 10**9 else None) for (i, _, _), f, c in zip(rows, fps, brute_components(some, fps), strict=True)), key=repr)
    got = sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_dups(df).collect()), key=repr)
    assert got == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(x for x in [i for (i, _, _), (_, _, c) in zip(rows, sorted(want, key=repr), strict=True)] if x in {c for _, _, c in want} and x is not None)


def test_query_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids, fps = [r["doc_id"] for r in docs], [brute_fp(r["text"]) for r in docs]
    want = sorted((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps), strict=True))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op6_simhash_near_dedup(spark, sf).collect()) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_dups(df).collect() == [] and simhash.keep_one(df).collect() == []


def test_rows_that_share_an_id_stay_by_their_own_text(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(rng.choices([f"w{k}" for k in range(400)], k=200)) for _ in range(3))
    rows = [(3, b, 1), (5, a, 2), (5, b, 3), (7, a, 4), (8, c, 5), (8, c, 6), (9, c.upper(), 7), (None, c, 8), (8, c.replace(" ", "  "), 9)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    got = sorted(r["n"] for r in kept.collect())
    # Of the two texts with id 8 (one of them twice) and their copies one stays.
    assert got in ([1, 2, 5, 6], [1, 2, 9])
