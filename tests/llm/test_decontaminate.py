import math
import random
import re
from collections import Counter

from fathom.llm import decontaminate as dc


def brute_scores(items, passage):
    """BM25 of every item by its formula, as a part of its self-score."""
    words = [dc.words_of(t) for _, t in items]
    n, average = len(words), sum(map(len, words)) / len(words)
    df = Counter(w for ws in words for w in set(ws))
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    own = set(passage)
    out = []
    for ws in words:
        part = {w: idf[w] * f * (dc.K1 + 1) / (f + dc.K1 * (1 - dc.B + dc.B * len(ws) / average)) for w, f in Counter(ws).items()}
        out.append(sum(x for w, x in part.items() if w in own) / sum(part.values()))
    return out


def corpus(rng, n=60):
    vocabulary = [f"v{k}" for k in range(300)]
    draw = lambda k: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(300)], k=k))
    return [(k, f"{draw(rng.randint(5, 25))}? Answer: {draw(rng.randint(1, 10))}.") for k in range(n)], draw


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(1)
    items, draw = corpus(rng)
    index = dc.Index(items)
    for _ in range(200):
        text = draw(rng.randint(0, 60)) + (" " + rng.choice(items)[1] if rng.random() < 0.5 else "") + " " + draw(20)
        words = dc.words_of(text)
        scores = brute_scores(items, words)
        terms = [index.term[w] for w in words if w in index.term]
        for least in (0.2, 0.55):
            want = {k: s for k, s in enumerate(scores) if s >= least}
            got = dict(index.search(terms, least))
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def brute_leaks(docs, items, least=dc.RETRIEVED, overlap=dc.OVERLAP):
    index = dc.Index(items)
    out = set()
    for d, text in docs:
        words = dc.words_of(text)
        for at in range(0, len(words), index.window):
            passage = words[at : at + 2 * index.window]
            for k, s in enumerate(brute_scores(items, passage)):
                if s >= least - 1e-9:
                    q, a = index.overlap(k, passage)
                    if q >= overlap and a >= overlap:
                        out.add((d, index.ids[k]))
    return out


def test_planted_items_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(2)
    items, draw = corpus(rng)
    docs, planted = [], set()
    for d in range(120):
        text = draw(rng.randint(50, 900))
        if d % 3 == 0:
            i, t = rng.choice(items)
            words = t.split()
            if d % 2:
                words[len(words) // 3] = "changed"  # nearly as it was
            text = text + " " + " ".join(words).upper() + " " + draw(300)
            planted.add((d, i))
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, "word " * 50_000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in [*items, (900, None), (901, ""), (None, "lost")]], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(df, bench).collect()}
    assert got == brute_leaks(docs, items)
    exact = {(d, i) for d, i in planted if d % 2 == 0}
    assert exact <= got and len(planted - got) <= 3 and {d for d, _ in got} <= {d for d, _ in planted}
    kept = dc.without_leaks(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    got = dc.op2_decontamination(spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(docs, items) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})


def test_slices_and_empty_tables(spark):
    items = [(k, f"alpha{k} beta{k} gamma{k} delta{k}? epsilon{k} zeta{k}") for k in range(7)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [len(s) for s in dc.slices(bench, "item_id", "text", 3)] == [3, 3, 1]
    docs = spark.createDataFrame([(1, items[4][1]), (None, items[2][1])], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, bench).collect()} == {(1, 4), (None, 2)}
    assert dc.leaks(docs.limit(0), bench).collect() == [] and dc.leaks(docs, bench.limit(0)).collect() == []
    assert dc.without_leaks(docs, bench.limit(0)).count() == 2


def test_questions_and_answers():
    assert dc.question_answer("What is it? Answer: a thing") == (3, 6)
    assert dc.question_answer("Who was it? The man.") == (3, 5)
    assert dc.question_answer("One two three. Four five.") == (3, 5)
    assert dc.question_answer("one two three") == (2, 3)


LABELS = r"(?i)(?<!\w)(?:question|answer|frage|antwort|pregunta|respuesta|réponse|solution|q|a)\s*:"


def plain_words(text):
    return re.findall(r"\w+", re.sub(LABELS, " ", text or "").lower())


def plain_leaks(docs, items, least=0.55, part=0.8, run=3, near=16):
    """All leaks, by formulas of this test alone: BM25 over the whole benchmark, passages of twice the least window, runs of three words."""
    split = []
    for i, text in items:
        mark = re.search(r"(?i)\b(?:answer|antwort|respuesta|réponse)\s*:", text)
        q = len(plain_words(text[: mark.start()])) if mark else len(plain_words(text[: text.rstrip()[:-1].rfind("?") + 1]))
        split.append((i, plain_words(text), q))
    n, average = len(split), sum(len(ws) for _, ws, _ in split) / len(split)
    df = Counter(w for _, ws, _ in split for w in set(ws))
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    found = {}
    for d, text in docs:
        words = plain_words(text)
        for i, ws, q in split:
            window = 64
            while window < len(ws):
                window *= 2
            assert window == 64 or len(ws) == window
            part_of = {w: idf[w] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ws) / average)) for w, f in Counter(ws).items()}
            for at in range(0, len(words), window):
                passage = words[at : at + 2 * window]
                score = sum(x for w, x in part_of.items() if w in set(passage)) / sum(part_of.values())
                if score < least - 1e-9:
                    continue
                runs = [tuple(passage[k : k + run]) for k in range(len(passage) - run + 1)]
                starts = [k for k in range(len(ws) - run + 1) if tuple(ws[k : k + run]) in runs]
                met = {k + j for k in starts for j in range(run)}
                answer = ws[q:]
                if len(answer) < run:
                    of_question = [p for p, r in enumerate(runs) if r in {tuple(ws[k : k + run]) for k in starts if k < q}]
                    at_answer = [p for p in range(len(passage)) if passage[p : p + len(answer)] == answer]
                    if any(p - near - len(answer) <= a <= p + run + near for a in at_answer for p in of_question):
                        met |= set(range(q, len(ws)))
                if sum(k in met for k in range(q)) >= part * q and sum(k in met for k in range(q, len(ws))) >= part * len(answer):
                    found[d, i] = max(score, found.get((d, i), 0))
    return found


def variants(question, answer, rng, words):
    """The item as others write it: labels, order, punctuation, case, a word in ten changed."""
    edit = lambda text: " ".join(rng.choice(words) if rng.random() < 0.1 and k not in (0, 1) else w for k, w in enumerate(text.split()))
    return [
        f"{question}? Answer: {answer}.", f"{question}? {answer}", f"Q: {question}?\nA: {answer}", f"Question: {question} - {answer}!", f"{question.upper()}?\n\nAntwort : {answer.upper()}",
        f"The answer: {answer}. It is asked: {question}?", f"Question: {edit(question)}? Solution: {answer}.",
    ]


def test_relabelled_reordered_and_edited_items(spark):
    rng = random.Random(8)
    words = [f"v{k}" for k in range(2000)]
    draw = lambda n: " ".join(rng.choices(words, k=n))
    parts = [(draw(rng.randint(8, 40)), draw(rng.randint(1, 12))) for _ in range(60)]
    items = [(k, f"{q}? Answer: {a}." if k % 2 else f"{q}? {a}.") for k, (q, a) in enumerate(parts)]
    docs, planted = [], set()
    for k, (q, a) in enumerate(parts):
        for j, v in enumerate(variants(q, a, rng, words)):
            docs.append((10 * k + j, f"{draw(rng.randint(0, 200))} {v} {draw(rng.randint(0, 200))}"))
            planted.add((10 * k + j, k))
    docs += [(10_000 + k, draw(300)) for k in range(60)] + [(20_000 + k, f"{draw(50)} {q}? {draw(3)}") for k, (q, a) in enumerate(parts)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in dc.leaks(df, bench).collect()}
    want = plain_leaks(docs, items)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want)
    assert found.keys() <= planted and len(found) >= 0.9 * len(planted)
    # Scores are the same however the benchmark is sliced.
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in dc.leaks(df, bench, slice_items=7).collect()} == found
    assert {r["doc_id"] for r in dc.without_leaks(df, bench, slice_items=25).collect()} == {d for d, _ in docs} - {d for d, _ in found}


def test_answers_of_a_word(spark):
    whale, paris = "Who wrote the famous book about whales and the sea?", "What is the capital of the country in the middle of the map?"
    bench = spark.createDataFrame([(1, f"{whale} Answer: Melville"), (2, f"{paris} Paris."), *[(k, f"filler{k} words{k} of{k} others{k}? Answer: none{k}") for k in range(3, 30)]], "item_id long, text string")
    texts = [f"{whale} Melville", f"{whale} A: Melville", f"So: {whale}\nAnswer: melville!", f"{paris} Answer: Paris.", f"{paris} paris", whale, f"{whale} Paris", f"{paris} {'other words between ' * 20} Paris"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.leaks(docs, bench).collect()) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)]


def test_a_long_item_does_not_widen_others(spark):
    rng = random.Random(4)
    draw = lambda n: " ".join(f"v{rng.randint(0, 900)}" for _ in range(n))
    items = [(k, f"{draw(12)}? Answer: {draw(4)}") for k in range(20)]
    long = (99, f"{draw(3000)}? Answer: {draw(40)}")
    docs = [(k, f"{draw(300)} {t} {draw(300)}") for k, t in [*items, long]]
    alone, whole = (next(dc.indexes(spark.createDataFrame(some, "item_id long, text string"), "item_id", "text")) for some in (items, [*items, long]))
    assert [i.window for i in whole] == [alone[0].window, 3040] and alone[0].window == 64
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.leaks(df, spark.createDataFrame([*items, long], "item_id long, text string")).collect()} == {(d, d) for d, _ in docs}


def test_rows_go_by_their_own_text_whatever_their_columns(spark):
    items = [(k, f"alpha{k} beta{k} gamma{k} delta{k}? epsilon{k} zeta{k}") for k in range(7)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, items[0][1], 5), (1, "clean text", 6), (None, items[3][1], 7), (None, None, 8), (None, "", 9)]
    for name in ("__id", "held", "item_id", "t", "i"):
        kept = dc.without_leaks(spark.createDataFrame(rows, f"doc_id long, text string, {name} int"), bench)
        assert kept.columns == ["doc_id", "text", name] and sorted(r[name] for r in kept.collect()) == [6, 8, 9]
