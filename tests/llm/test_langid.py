import math
import random
import re
import zlib

from pyspark.sql import functions as F

from fathom.llm import langid


def test_automaton_steps_are_longest_matches():
    rng = random.Random(1)
    text = [rng.randint(1, 3) for _ in range(200)]
    table = langid.suffix_automaton(text, 4)
    inside = {tuple(text[a:b]) for a in range(len(text)) for b in range(a + 1, min(len(text), a + 12) + 1)}
    for _ in range(300):
        probe = [rng.randint(1, 3) for _ in range(11)]
        state, n = 0, 0
        for s in probe:
            if not table[state, s]:
                break
            state, n = table[state, s], n + 1
        assert n == max((k for k in range(12) if tuple(probe[:k]) in inside or k == 0))


def phrases(sample, text):
    """Greedy longest matches in any of the sample's texts, counted one by one."""
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) + 1 and text[at : at + k] in sample:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_phrases_against_direct_parsing():
    rng = random.Random(2)
    samples = {"x": ["abba baab abab " * 3], "y": ["cab cabac acca " * 3]}
    model = langid.Model(samples)
    letters = {model.symbol[ord(c)]: c for c in "abc"} | {1: " "}
    for _ in range(50):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 200)))
        e = model.encode(text)
        plain = "".join(letters[s] for s in e.tolist())
        joined = {k: "".join(letters[s] for t in ts for s in model.encode(t).tolist()) + " " for k, ts in samples.items()}
        assert model.phrases([e])[0].tolist() == [phrases(joined[k], plain) for k in ("x", "y")]


def test_held_out_accuracy(spark, sf):
    rows = langid.op5_language_id(spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    own = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in own) / len(own) >= 0.97


def test_edges(spark):
    rows = [(1, "the cat and the dog sat on the mat", "en"), (2, "der Hund und die Katze auf der Matte", "de"), (3, None, "en"), (4, "", None), (5, "12 !?", "de"), (None, "the dog", None), (7, "X" * 200_000, None), (7, "der Hund", "de")]
    df = spark.createDataFrame([(i, t, g, "z") for i, t, g in rows], "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(df.where(F.col("doc_id") <= 2))
    got = langid.detect(df, model).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (7, "de")} <= by
    assert langid.detect(df.limit(0), model).collect() == []
    none = langid.train(df.where("false"))
    assert {r["lang_pred"] for r in langid.detect(df, none).collect()} == {"und"}
    kept = langid.filter_known(df, none, 55.0)
    assert kept.columns == df.columns and kept.count() == 5


def test_unlearned_scripts_and_noise_are_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    rng = random.Random(3)
    noise = [(k, "".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(600))) for k in range(5)] + [(9, "Съешь же ещё этих мягких французских булок")]
    assert langid.filter_known(spark.createDataFrame(noise, "doc_id long, text string"), model, 55.0).count() == 0
    assert langid.filter_known(docs, model, 55.0).count() == docs.where("text rlike '\\\\p{L}'").count()


def test_unlearned_letters_are_phrases_of_their_own():
    model = langid.Model({"x": ["the cat sat on the mat. " * 20]})
    assert [p[2] for p in model.predict(["жук", "ЖУК жук"])][0] == 100.0
    n = len(model.encode("the cat жжжжжж the cat"))
    assert n == 22 and model.phrases([model.encode("the cat жжжжжж the cat")])[0, 0] >= 8
    turkish = langid.Model({"tr": ["istanbul iyi " * 9]})
    assert turkish.encode("İSTANBUL")[0] == turkish.encode("i")[0]


def test_limits_hold_for_near_copies_and_small_samples():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(20)]
    alike = [texts[0] + f" {word()}" for _ in range(40)]
    got = langid.limits({"a": texts, "b": alike, "c": ["x"], "d": ["der Hund und die Katze"]}, 1.6, 32.0)
    assert 32.0 <= got["a"] < 100 and got["b"] == 32.0 and got["c"] == 100.0 and 32.0 <= got["d"] <= 100.0


def test_every_learned_letter_counts():
    rng = random.Random(6)
    scripts = {"el": (0x3B1, 24), "ru": (0x430, 32), "la": (0x61, 26), "zh": (0x4E00, 900), "ja": (0x5000, 900), "ko": (0xAC00, 900)}
    words = {k: ["".join(chr(a + rng.randrange(n)) for _ in range(rng.randint(1, 5))) for _ in range(300)] for k, (a, n) in scripts.items()}
    prose = lambda k, n: " ".join(rng.choices(words[k], k=n))
    samples = {k: [prose(k, 150) for _ in range(10)] for k in scripts}
    model = langid.Model(samples)
    for k in scripts:
        assert all(p[0] == k and p[2] < 60 for p in model.predict([prose(k, 40) for _ in range(5)]))
    joined = {k: [s for t in samples[k] for s in [*model.encode(t).tolist(), 1]] for k in model.langs}
    for text in [prose("zh", 20), prose("ru", 10) + prose("ja", 10), "жαa一" * 9 + "ж丿q가"]:  # rare and frequent symbols, against direct parsing
        e = model.encode(text)
        as_text = lambda symbols: "".join(map(chr, symbols))
        assert model.phrases([e])[0].tolist() == [phrases(as_text([s + 1 for s in joined[k]]), as_text([s + 1 for s in e.tolist()])) for k in model.langs]


def test_languages_with_long_texts_alone_are_learned(spark):
    rng = random.Random(8)
    prose = lambda words, n: " ".join(rng.choices(words.split(), k=n))
    en, de = "the cat and dog sat on mat with their house when it was raining", "der Hund und die Katze auf Matte mit ihrem Haus als es regnete"
    book = prose(de, 20_000)
    df = spark.createDataFrame([(k, prose(en, 80), "en") for k in range(20)] + [(100, book, "de"), (101, book, "de")], "doc_id long, text string, lang string")
    found = langid.sample(df, "text", "lang")
    assert sorted(found) == ["de", "en"] and [len(t) for t in found["de"]] == [langid.LONGEST] and found["de"][0] in book
    assert found == langid.sample(df.repartition(3), "text", "lang")
    assert langid.Model(found).predict([prose(de, 30), prose(en, 30)])[0][0] == "de"


def test_query_against_brute_force(spark, sf):
    """Each prediction of the query's table by parsing whole texts, letter by letter, against the samples' own text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = langid.sample(docs.where(~langid.in_fold(F.col("doc_id"))), "text", "lang")
    learned = {c for ts in samples.values() for t in ts for c in t.lower() if c.isalpha()}
    plain = lambda text: re.sub(" +", " ", "".join((c.lower()[0] if c.lower()[0] in learned else "\0") if c.isalpha() else " " for c in text))
    joined = {k: "".join(plain(t) + " " for t in ts) for k, ts in sorted(samples.items())}
    got = {r["doc_id"]: r for r in langid.op5_language_id(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        found = got[r["doc_id"]]
        if not any(map(str.isalpha, r["text"] or "")):
            assert (found["lang_pred"], found["score"]) == ("und", 0.0)
            continue
        text = plain(r["text"])
        parts = [text[k : k + langid.SEGMENT] for k in range(0, len(text), langid.SEGMENT)]
        rates = {k: sum(phrases(s, p) for p in parts) / len(text) for k, s in joined.items()}
        best = min(rates.values())
        assert found["lang_pred"] == next(k for k, x in rates.items() if x == best), r["doc_id"]
        assert abs(found["score"] - 1 / sum(math.exp(-20 * (x - best)) for x in rates.values())) < 1e-5


def test_texts_in_several_learned_languages_are_kept(spark):
    rng = random.Random(9)
    prose = lambda words, n: " ".join(rng.choices(words.split(), k=n))
    en, de = "the cat and dog sat on mat with their house when it was raining again", "der Hund und die Katze auf Matte mit ihrem Haus als es wieder regnete"
    foreign = "kissa koira istui matolla talonsa kanssa kun satoi taas vettä ja nukkui pitkään"
    samples = {"en": [prose(en, 300) for _ in range(10)], "de": [prose(de, 300) for _ in range(10)]}
    rows = [(1, prose(en, 400) + " " + prose(de, 400)), (2, prose(en, 400)), (3, prose(foreign, 400)), (4, prose(en, 60) + prose(foreign, 600)), (5, "the house token=Xq8Zr4Tn2Lk9 sat on mat")]
    kept = langid.filter_known(spark.createDataFrame(rows, "doc_id long, text string"), langid.Model(samples), dict.fromkeys(samples, 32.0))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]
