"""Text operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing names."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, langid, language_model, linededup, neardup_text, toxicity, transducers
from marketloom.llm.common import bounded_sample, held_out, text_key

R = random.Random(7)
VOCAB = [a + b for a in "ba ke lo mi nu po ra si te vu".split() for b in "da fen gil hos jum kat lim".split()]


def prose(n, r=R):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def frame(spark, rows, extra=True):
    """doc_id, text and columns whose names the operators use themselves."""
    if extra:
        return spark.createDataFrame([(*r, "x", 1, "y") for r in rows],
                                     "doc_id long, text string, tie string, node int, words string").repartition(3)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


# line dedup

def brute_lines(rows):
    docs = {}
    for doc_id, text in rows:
        docs.setdefault((doc_id is not None, doc_id or 0, text), None)
    seen, out = set(), {}
    for known, doc_id, text in sorted((d for d in docs if d[2] is not None), key=lambda d: d[:2]):
        parts = text.split("\n")
        solid = [(i, p.strip(" \t\r")) for i, p in enumerate(parts) if p.strip(" \t\r")]
        windows = [(solid[k][0], solid[k + 2][0], tuple(t for _, t in solid[k : k + 3])) for k in range(len(solid) - 2)]
        if 0 < len(solid) < 3:
            windows = [(solid[0][0], solid[-1][0], ("short", *[t for _, t in solid]))]
        windows += [(i, i, ("line", t)) for i, t in solid if t.count(" ") >= 49]
        gone = set()
        for first, last, key in sorted(windows):
            if key in seen:
                gone |= set(range(first, last + 1))
            seen.add(key)
        out[doc_id if known else None, text] = "\n".join(p for i, p in enumerate(parts) if i not in gone)
    return out


def test_line_dedup(spark):
    lines = [prose(4) for _ in range(12)]
    long_line = prose(60)
    rows = [(i, "\n".join(R.choice(lines) for _ in range(R.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, f"a\n{long_line}\nb"), (104, f"c\n \n{long_line}  \nd"),
             (105, "\n".join(["same"] * 50)), (None, "\n".join(lines[:3])), (106, "x\ny\nz\n" * 3000), (7, rows[7][1])]
    got = linededup.dedup_lines(frame(spark, rows)).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows) and got[0]["tie"] == "x"
    known = {(d, t) for d, t in rows}
    for r in got:
        assert r["text"] is None or r["text"] in {want[k] for k in known if k[0] == r["doc_id"] and k[1] is not None}
    assert {r["doc_id"]: r["text"] for r in got}[103].count(long_line) + {r["doc_id"]: r["text"] for r in got}[104].count(
        long_line) == 1
    assert linededup.dedup_lines(frame(spark, []).limit(0)).count() == 0


# decontamination

def brute_hits(text, items):
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(pattern, (text or "").translate(low))
    hit, ids = set(), set()
    for item, t in items:
        w = re.findall(pattern, (t or "").translate(low))
        size = min(13, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == w[s : s + size]:
                    hit |= set(range(p, p + size))
                    ids.add(item)
    return len(words), len(hit), sorted(str(i) for i in ids if i is not None)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 7])
def test_decontamination(spark, block):
    items = [(i, prose(R.choice([3, 13, 14, 30]))) for i in range(8)] + [(8, None), (9, "?!"), (None, prose(15)), (3, prose(20))]
    rows = [(i, prose(40)) for i in range(5)] + [(50, None), (51, ""), (52, "Éa " * 5), (53, prose(5000))]
    for i, (_, t) in enumerate(items):
        if t:
            rows.append((100 + i, prose(9) + ", " + t.upper() + "! " + prose(R.choice([0, 5, 400]))))
            rows.append((200 + i, t[: len(t) // 2]))
    rows += rows[-4:]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows), bench, block=block).collect()
    assert len(got) == len(rows)
    want = sorted(((d, *brute_hits(t, items)) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)
    clean = {d for d, n, h, _ in want if not (h and 20 * h >= n)}
    assert {r["doc_id"] for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()} == clean
    assert decontaminate.contamination(frame(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.contamination(frame(spark, []).limit(0), bench).count() == 0


# near duplicates

def brute_groups(rows):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None))
                   for i in range(len(rows))), key=str)


def test_near_duplicates(spark):
    rows = [(i, prose(R.choice([30, 80, 200]))) for i in range(40)]
    for i in range(12):  # chains and stars of near copies
        words = rows[i][1].split()
        for j in range(6):
            for _ in range(R.choice([0, 1, 2])):
                words[R.randrange(len(words))] = R.choice(VOCAB)
            rows.append((1000 + 10 * i + j, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "  \n"), (503, "a b"), (504, "A  b"), (505, "a b c"), (None, rows[3][1]),
             (506, prose(30_000)), (3, rows[3][1]), (3, rows[3][1]), (507, "w " * 4000), (508, "w " * 5)]
    got = neardup_text.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_groups(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup_text.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_sketch_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(3)
    errors = []
    for n in (1, 7, 300, 2000):
        common = r.integers(0, 2**63, n, dtype=np.uint64)
        a = np.unique(np.append(common, r.integers(0, 2**63, max(1, n // 8), dtype=np.uint64)))
        b = np.unique(np.append(common, r.integers(0, 2**63, max(1, n // 8), dtype=np.uint64)))
        x, y = neardup_text.fast_sketch(a), neardup_text.fast_sketch(b)
        assert x.max() < 2**64 - 1
        errors.append(abs((x == y).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
    assert max(errors) < 0.17


# language ID

def test_language_id(spark):
    tongues = {"aa": "ba ke lo mi", "bb": "schu eng ver ß", "cc": "ñó ción que í"}

    def text(lang, n):
        return " ".join("".join(R.choice(tongues[lang].split()) for _ in range(R.randint(1, 3))) for _ in range(n))

    rows = [(i, text(lang, R.choice([1, 30, 300])), lang) for i, lang in enumerate(R.choice(list(tongues)) for _ in range(400))]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !?", None), (903, text("bb", 50_000), None), (904, "日本語", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(docs, ~held_out(3, 1))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(got) == len(rows)
    assert sum(got[d]["lang_pred"] == lang for d, _, lang in rows[:400]) >= 395
    assert [got[d]["lang_pred"] for d in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert got[904]["lang_pred"] in tongues and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.train(docs.limit(0), ~held_out(3, 1)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def naive_kernel(a, b):
    """Presence kernel of two sets of symbol n-grams, straight from their definition."""
    return len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0.0


def test_kernel_against_brute_force():
    """Sets, kernel and the ridge solution of 30 texts against a version without matrices of presence."""
    import numpy as np

    texts = [" ".join("".join(R.choice("abcdé ß1") for _ in range(R.randint(1, 6))) for _ in range(R.randint(1, 40))) for _ in range(30)]
    texts[:2] = ["a", "Ab ba"]
    alphabet = ("a", "b", "c", "d", "é")
    table, flags = langid.fold_table(alphabet), np.zeros(langid.CODES, bool)
    sets = [langid.presence(t, table, flags) for t in texts]

    def grams(text):
        folded = [alphabet.index(c) + 1 if (c := ch.lower()) in alphabet else langid.SYMBOLS - 1 if ch.isalpha() else 0 for ch in text]
        found = {tuple(folded[i : i + n]) for n in range(1, langid.ORDERS + 1) for i in range(len(folded) - n + 1)}
        return {g for g in found if any(g)}

    want = [grams(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    names = [("x", "y")[i % 2] for i in range(30)]
    model = langid.fit(sets, names, alphabet, landmarks=4)
    marks = [i for k in (0, 1) for i in range(30) if i % 2 == k][:4] + [i for i in range(30) if i % 2 == 1][:4]
    kernel = np.array([[naive_kernel(w, want[m]) for m in marks] for w in want])
    assert np.allclose(model.kernel(sets), kernel, atol=1e-5)
    # ridge regression on the whitened kernel, solved by least squares on stacked rows
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-6 * values.max()
    z = np.hstack([kernel @ (vectors[:, keep] / np.sqrt(values[keep])), np.ones((30, 1))])
    target = np.array([[1.0 if n == k else -1.0 for k in ("x", "y")] for n in names])
    ridge = np.sqrt(langid.PENALTY * 30 / 100) * np.eye(z.shape[1])
    beta = np.linalg.lstsq(np.vstack([z, ridge]), np.vstack([target, np.zeros((z.shape[1], 2))]), rcond=None)[0]
    margin = z @ beta
    got = model.scores(sets)
    e = np.exp(langid.STEEPNESS * (margin - margin.max(1, keepdims=True)))
    assert np.allclose(got, e / e.sum(1, keepdims=True), atol=1e-3)


def test_samples_are_bounded_and_count_a_row_once(spark):
    rows = [(1, "same text", "aa")] * 300 + [(1, "same text", "bb")] * 40 + [(i, f"text {i}", "aa") for i in range(2, 90)] + [
        (2, "another text of id two", "bb"), (3, None, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    def sample(docs, cap, labels):
        return bounded_sample(docs, docs.select("doc_id", "lang", text_key()), "lang", cap, labels)

    got = sample(docs, 5, 10).collect()
    assert len([r for r in got if r["lang"] == "aa"]) == 5 and len({(r["doc_id"], r["text"], r["lang"]) for r in got}) == len(got)
    assert {(r["doc_id"], r["text"]) for r in got if r["lang"] == "bb"} == {(1, "same text"), (2, "another text of id two"), (3, None)}
    assert sample(docs, 1000, 10).count() == 89 + 3
    assert {r["lang"] for r in sample(docs, 5, 1).collect()} == {"aa"}
    shared = spark.createDataFrame([(1, "uno dos", "es"), (1, "one two", "en")] * 50, "doc_id long, text string, lang string")
    assert sorted((r["lang"], r["text"]) for r in sample(shared, 400, 10).collect()) == [("en", "one two"), ("es", "uno dos")]


# toxicity

def test_composition_agrees_with_the_five_in_turn():
    table = transducers.clause_table()
    for _ in range(2000):
        symbols = [R.randrange(transducers.READ) for _ in range(R.randint(1, 25))]
        assert transducers.run_composed(symbols, table) == pytest.approx(transducers.run_in_turn(symbols))
    words = [transducers.OTHER] * 9
    for k in range(10):  # gaps are steps over words without a class
        a = [transducers.TARGET, *words[:k], transducers.INSULTS[1]]
        state = table.gaps[min(k, transducers.REACH)][table.follow[transducers.TARGET]]
        last = table.vectors[table.emitted[state * transducers.READ + transducers.INSULTS[1]]]
        assert list(last) == transducers.run_in_turn(a)


def test_grammar_against_a_naive_reading():
    """Texts against rules that look at every pair of words of a clause."""
    g = toxicity.Grammar.of({})
    pool = ["you", "not", "said", "kill", "idiot", "table", "chair", "lamp", "."]
    for _ in range(400):
        text = " ".join(R.choice(pool) for _ in range(R.randint(1, 30)))
        want = [0.0] * 5
        for clause in text.split("."):
            w = clause.split()

            def near(i, word):
                return any(w[j] == word for j in range(max(0, i - 6), i))

            free = [i for i, x in enumerate(w) if x in ("idiot", "kill") and not near(i, "not") and not near(i, "said")]
            want[2] += 2.5 * sum(x == "idiot" and near(i, "not") for i, x in enumerate(w))
            want[3] += 2.5 * sum(x == "idiot" and near(i, "said") and not near(i, "not") for i, x in enumerate(w))
            open_at = None
            for i, x in enumerate(w):
                if x == "idiot" and i in free:
                    if near(i, "you"):
                        want[1] += 2.5
                    else:
                        want[0] += 2.5
                        open_at = i
                elif x == "you" and open_at is not None and i - open_at <= 6:
                    want[0], want[1], open_at = want[0] - 2.5, want[1] + 2.5, None
            for i, x in enumerate(w):
                if x == "kill" and i in free and near(i, "you"):
                    want[4] += 1
                if x == "you" and not near(i, "not") and not near(i, "said") and any(j in free and w[j] == "kill" for j in range(max(0, i - 6), i)):
                    want[4] += 1
        assert toxicity.emit(text, g)[:5] == pytest.approx([math.log1p(x) for x in want]), text


def test_repeated_labelled_rows_teach_once(spark):
    r = random.Random(4)
    toxic = [(i, prose(15, r) + " zorgon " + prose(10, r)) for i in range(40)]
    rows = toxic + [toxic[0]] * 60 + [(100 + i, prose(25, r)) for i in range(100)]
    labels = spark.createDataFrame([(i, 1, int(i < 100)) for i in {d for d, _ in rows}], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, rows), labels, F.lit(True))
    assert "zorgon$" in model.beginnings or any(k.startswith("zor") for k in model.beginnings)


def test_clause_grammar():
    g = toxicity.Grammar.of({"vequ": 6.0, "clown$": 6.0})
    at = dict(zip(toxicity.FEATURES, range(7)))
    assert toxicity.emit("they met. vequilo here", g)[at["plain"]] > 0
    assert toxicity.emit("you are a clown", g)[at["targeted"]] > 0
    assert toxicity.emit("clown, you", g)[at["targeted"]] > 0
    assert toxicity.emit("he is not a clown", g)[at["negated"]] > 0
    assert toxicity.emit("it said clown", g)[at["reported"]] > 0
    assert toxicity.emit("i will kill them", g)[at["threat"]] > 0
    assert toxicity.emit("kill. them", g)[at["threat"]] == 0
    assert toxicity.emit("clownfish swim", g) == toxicity.emit(None, g) == [0.0] * 7


def test_toxicity(spark):
    rows, marks = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = prose(R.choice([10, 60, 300])).split()
        if toxic:
            for _ in range(3):
                words.insert(R.randrange(len(words)), R.choice(["zorg" + R.choice(VOCAB), "moron"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, prose(40_000)), (0, rows[0][1])]
    marks += [(903, 1, 1), (900, None, None), (None, 0, 1), (1, 0, 0)]
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels, ~held_out(5, 0))).collect()
    assert len(got) == len(rows)
    right = sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["doc_id"] < 600)
    assert right >= 595 and all(r["predicted"] == 0 for r in got if r["doc_id"] >= 900)
    none = toxicity.train(docs, labels.limit(0), ~held_out(5, 0))
    assert toxicity.score(docs, none).count() == len(rows) and toxicity.score(docs.limit(0), none).count() == 0


def test_beginnings_from_few_labels_and_from_insults_that_clean_texts_quote(spark):
    def learned(toxic, clean, quoted):
        r = random.Random(3)
        rows = [(i, prose(15, r) + (" zorgon " if i % 2 else " ") + prose(10, r), 1) for i in range(toxic)]
        rows += [(toxic + i, prose(20, r) + (". they said zorgon " if i < quoted else " "), 0) for i in range(clean)]
        sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        return toxicity.learn_beginnings(sample.select("doc_id", "toxic", "text"))

    for toxic, clean, quoted in ((40, 100, 0), (400, 2000, 40)):
        found = learned(toxic, clean, quoted)
        assert found and all(k.startswith("zor") for k in found)


# language model

def test_language_model_counts_and_scores(spark):
    import math

    rows = [(i, prose(R.choice([1, 20, 90])) + (" tail" + str(i) if i % 3 else "")) for i in range(80)]
    rows += [(900, None), (901, ""), (902, prose(6000)), (5, rows[5][1]), (None, "Ba x")]
    docs = frame(spark, rows)
    got = language_model.score_documents(docs, ~held_out(5, 1)).collect()
    marked = {r["doc_id"]: r["h"] for r in docs.select("doc_id", held_out(5, 1).alias("h")).collect()}
    counts = {}
    for d, t in rows:
        if not marked[d]:
            for w in [*(t or "").encode().lower().split(), b""]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    text = {d: t for d, t in rows}
    assert len(got) == len(rows)
    for r in got:
        words = [*(text[r["doc_id"]] or "").encode().lower().split(), b""]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r["n_tokens"], r["train_tokens"]) == (len(words), n)
        assert r["n_known"] == sum(w in counts for w in words)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    assert language_model.score_documents(docs.limit(0), ~held_out(5, 1)).count() == 0
    assert language_model.score_documents(docs, F.lit(False)).count() == len(rows)


def test_every_training_token_is_in_one_segment(spark):
    rows = [(i, prose(R.choice([0, 3, 127, 128, 500]))) for i in range(60)] + [(900, None)]
    docs = frame(spark, rows)
    v = language_model.vocabulary(language_model.token_counts(docs))
    got = language_model.training_segments(docs, spark.sparkContext.broadcast(v)).collect()
    assert sum(len(r["ids"]) // 2 for r in got) == v.total
    assert len(got) == sum(-(-(len((t or "").split()) + 1) // language_model.SEGMENT) for _, t in rows)
    assert {r["turn"] for r in got} == set(range(language_model.ROUNDS))


def test_copies_of_one_text_are_dealt_to_all_trainers(spark):
    docs = frame(spark, [(i, "" if i % 2 else "ba ke lo") for i in range(800)])
    v = language_model.vocabulary(language_model.token_counts(docs))
    segments = language_model.training_segments(docs, spark.sparkContext.broadcast(v))
    sizes = [r["count"] for r in language_model.dealt(segments, 8).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 800 and len(sizes) == 8 and max(sizes) < 150


def test_network_is_a_distribution_and_its_gradient_is_right(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(language_model, "HEAD", 40)
    docs = frame(spark, [(i, prose(60)) for i in range(20)])
    v = language_model.vocabulary(language_model.token_counts(docs))
    net = language_model.Network(v)
    r = np.random.default_rng(1)
    for k in ("out", "words"):
        net.p[k] = (net.p[k] + r.normal(0, 0.1, net.p[k].shape)).astype("f4")
    state = r.normal(0, 0.5, (1, language_model.STATE)).astype("f4")
    every = np.arange(v.inputs)
    assert abs(np.exp(net.log_probs(np.repeat(state, len(every), 0), every)).sum() - 1) < 1e-4
    for k in net.p:
        net.p[k] = net.p[k].astype("f8")
    ids, h = r.integers(0, v.inputs, (5, 3)), state.repeat(3, 0).astype("f8")
    grads, _, _ = net.gradients(h, ids, 1.0)
    for k, at in (("recur", (3, 40)), ("inputs", (int(ids[1, 1]), 5)), ("out", (2, 1)), ("words", (0, 4, 1))):
        eps, own = 1e-5, net.p[k][at]
        net.p[k][at] = own + eps
        up = net.gradients(h, ids, 1.0)[2]
        net.p[k][at] = own - eps
        down = net.gradients(h, ids, 1.0)[2]
        net.p[k][at] = own
        assert abs((up - down) / (2 * eps) - grads[k][at]) < 1e-4 * max(1, abs(grads[k][at]))


def test_padding_gives_no_gradient_and_short_segments_are_trained_whole(spark):
    import numpy as np

    docs = frame(spark, [(i, prose(60)) for i in range(20)])
    net = language_model.Network(language_model.vocabulary(language_model.token_counts(docs)))
    r = np.random.default_rng(2)
    ids, h = r.integers(0, net.v.inputs, (9, 2)), np.zeros((2, language_model.STATE), "f4")
    real = np.arange(9)[:, None] < np.array([9, 4])
    got, _, loss = net.gradients(h, ids, 1.0, real)
    a, _, x = net.gradients(h[:1], ids[:, :1], 1.0)
    b, _, y = net.gradients(h[:1], ids[:4, 1:], 1.0)
    assert abs(loss - x - y) < 1e-3
    for k in got:
        assert np.allclose(got[k], a[k] + b[k], atol=1e-4)
    segments = [r.integers(0, net.v.inputs, n).astype(np.int16) for n in (1, 2, 31, 32, 33, 64, 100, 128, *r.integers(1, 128, 50))]
    assert language_model.fit_segments(net, segments) == sum(map(len, segments))
    assert language_model.fit_segments(net, []) == 0


def test_rows_of_more_trainers_than_planned_are_summed_before_the_driver(spark, monkeypatch):
    """A session that deals to more partitions than asked for gave the driver all their weights at once."""
    import numpy as np

    docs = frame(spark, [(i, prose(20)) for i in range(300)])
    v = language_model.vocabulary(language_model.token_counts(docs))
    stages, write = [], language_model.written
    monkeypatch.setattr(language_model, "written", lambda df, label: (stages.append(label), write(df, label))[1])
    monkeypatch.setattr(language_model, "dealt", lambda segments, n: segments.repartition(40, "doc_id", "start").select("ids"))
    language_model.train(docs, v, spark.sparkContext.broadcast(v))
    assert stages.count("lm-sums") == language_model.ROUNDS
    rows = [(i, i + 1, (np.arange(3.0) * i * (i + 1)).tobytes()) for i in range(70)]
    mean = language_model.averaged(spark.createDataFrame(rows, "trainer int, tokens long, weights binary"))
    assert np.allclose(mean, np.arange(3) * sum(i * (i + 1) for i in range(70)) / sum(range(71)))


def test_weights_leave_the_disk_and_no_session_makes_more_trainers(spark, monkeypatch):
    """Where a session raised the partitions, each became a trainer, and the weights of all rounds stayed on disk."""
    from pathlib import Path

    from pyspark.sql import DataFrame

    docs = frame(spark, [(i, prose(20)) for i in range(300)])
    v = language_model.vocabulary(language_model.token_counts(docs))
    shared, rows, paths = spark.sparkContext.broadcast(v), [], []
    segments, write, deal = language_model.training_segments(docs, shared), language_model.written, DataFrame.repartition

    def watched(df, label):
        out, path = write(df, label)
        rows.extend([out.count()] * (label == "lm-round"))
        paths.append(path)
        return out, path

    monkeypatch.setattr(language_model, "written", watched)
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *by: deal(self, max(n, 40), *by))
    dealt = language_model.dealt(segments, 3)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.count() == 300
    language_model.train(docs, v, shared)
    assert rows == [1] * language_model.ROUNDS
    assert len(paths) == language_model.ROUNDS + 1 and not any(Path(p).exists() for p in paths)


def test_rows_of_one_key_are_summed():
    import numpy as np

    r = np.random.default_rng(3)
    keys = np.sort(np.concatenate([np.zeros(37, int), r.integers(1, 30, 200), [40]]))
    rows = r.normal(size=(len(keys), 5))
    which, sums = language_model.summed(rows.copy(), keys)
    assert list(which) == sorted(set(keys)) and np.allclose(sums, [rows[keys == k].sum(0) for k in which])


def test_streams_carry_state_over_windows():
    import numpy as np

    class V:
        head, head_classes, log_mass, inputs = 0, 0, np.zeros(5), 5
        class_words, class_log_mass, head_log_share = [], np.log(np.full(5, 0.2)), np.zeros(0)
        head_class = head_place = np.zeros(0, int)

    net = language_model.Network(V())
    r = np.random.default_rng(5)
    net.p["out"] = r.normal(0, 1, net.p["out"].shape).astype("f4")
    docs = [r.integers(0, 5, n).astype(np.int16) for n in (1, 200, 33, 7, 64, *r.integers(1, 90, 400))]
    got = language_model.run_streams(net, docs)
    for d, p in zip(docs[:40], got):
        h, want = np.zeros((1, language_model.STATE), "f4"), 0.0
        for x in d:
            want += float(net.log_probs(h, np.array([x]))[0])
            h = net.step(h, net.p["inputs"][[x]])
        assert abs(want - p) < 1e-3 * max(1, abs(want))


def test_tokens_of_a_column_are_those_of_its_texts():
    import pyarrow as pa

    texts = [None, b"", b" ", b"A", b" \x0bA\x0c\r\nb  C\t", b"a\x1cB\x00c\x85 d\xa0", "É x ſ　K".encode(), b"\xff\xfe Q", *(prose(R.choice([1, 50])).encode() for _ in range(20))]
    array = pa.array([b"before", *texts, b"after"], pa.binary()).slice(1, len(texts))
    words, sizes = language_model.column_tokens(array)
    want = [language_model.tokens(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == [w for x in want for w in x]
