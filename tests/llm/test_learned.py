from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from folium.llm import language, toxicity
from folium.llm.common import held_out

SF = "/root/testdata/sf0.01"
EDGE = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"


def edges(spark):
    rows = [(1_000_001, None), (1_000_002, ""), (1_000_003, "12 !? ..."), (1_000_004, "the and of " * 40_000), (1_000_005, "the of and"), (1_000_005, "the of and"), (None, "der die und")]
    return spark.createDataFrame([(i, t, "en" if t else None, None, None, 0.5, 1) for i, t in rows], EDGE)


def test_held_out(spark):
    got = {r.doc_id: r.h for r in spark.range(200).selectExpr("id AS doc_id").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(language.sample(docs))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) > 100
    edge = language.identify(edges(spark), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in edge] == [(1_000_001, "und"), (1_000_002, "und"), (1_000_003, "und"), (1_000_004, "en"), (1_000_005, "en"), (1_000_005, "en"), (None, "de")]
    assert all(0 <= r.score <= 1 for r in edge) and language.identify(docs.limit(0), model).collect() == []
    empty = language.fit(language.sample(docs.limit(0)))
    assert {r.lang_pred for r in language.identify(edges(spark), empty).collect()} == {"und"}


def test_backoff_order():
    import numpy as np

    v = lambda a, b: np.log(np.array([a, b]))
    model = {"langs": ["x", "y"], "tables": {0: {"known": v(0.1, 0.9)}, 1: {"q": v(0.9, 0.1)}, 2: {"qz": v(0.2, 0.8)}}}
    s = language.Scorer(model)
    assert language.predict_text(s, model["langs"], "known")[0] == "y"  # the word itself
    assert language.predict_text(s, model["langs"], "qz")[0] == "y"  # the longer n-gram
    assert language.predict_text(s, model["langs"], "q")[0] == "x"


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.detect(docs, model).collect()}
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    hit = sum(a == b == 1 for a, b in held)
    assert hit >= 0.75 * sum(a for a, _ in held) > 20 and hit >= 0.75 * sum(b for _, b in held)
    scorer = toxicity.Scorer(model)
    for r in docs.limit(60).collect():  # noisy-or of the sentences, which are the text's own
        score, spans = toxicity.score_text(scorer, r.text)
        clear = 1 - toxicity.LEAK
        for _, _, p in scorer.sentences(r.text):
            clear *= 1 - p
        assert abs(got[r.doc_id].score - (1 - clear)) < 1e-12 and abs(score - got[r.doc_id].score) < 1e-12
        assert [(s.start, s.end) for s in got[r.doc_id].offending] == [s[:2] for s in spans]
    edge = toxicity.detect(edges(spark), model).collect()
    assert len(edge) == 7 and all(0 <= r.score <= 1 for r in edge) and edge[0].score == edge[1].score
    assert toxicity.detect(docs.limit(0), model).collect() == []
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert {r.predicted for r in toxicity.detect(edges(spark), none).collect()} == {0}


def test_long_words_are_scored_whole():
    import numpy as np

    v = lambda a, b: np.log(np.array([a, b]))
    s = language.Scorer({"langs": ["x", "y"], "tables": {0: {}, 1: {"z": v(0.5, 0.5)}, 2: {"ab": v(0.6, 0.4), "qz": v(0.1, 0.9)}}})
    word = "ab" * 32 + "qz" * 100
    assert language.predict_text(s, ["x", "y"], word)[0] == "y" and word not in s
    assert language.predict_text(s, ["x", "y"], f"{word} ab ab")[0] == "y" and "ab" in s
    t = toxicity.Scorer({"weights": {"vile": 9.0}, "bias": -4.0})
    assert toxicity.score_text(t, "o" * 100 + "vile" + "o" * 100)[0] > 0.9 and len(t) == 0


def runs(text):
    return [w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]


def plain_languages(labelled, asked):
    """Counts, shares and scores in plain loops: the word itself, else the longest n-grams of which any is known."""
    langs = sorted({lang for lang, _ in labelled})
    words = {lang: Counter(w for one, text in labelled if one == lang for w in runs(text)) for lang in langs}
    tables = {0: {lang: {w: n for w, n in words[lang].items() if n >= language.LEAST} for lang in langs}}
    for k in range(1, language.LONGEST + 1):
        tables[k] = {lang: Counter() for lang in langs}
        for lang in langs:
            for w, n in words[lang].items():
                for i in range(max(len(w) + 3 - k, 0)):
                    tables[k][lang][f"^{w}$"[i : i + k]] += n
    names = {k: {g for own in t.values() for g in own} for k, t in tables.items()}
    sums = {k: {lang: sum(own.values()) + language.SMOOTH * len(names[k]) for lang, own in t.items()} for k, t in tables.items()}
    share = lambda k, g, lang: math.log((tables[k][lang].get(g, 0) + language.SMOOTH) / sums[k][lang])

    def score(word):
        if word in names[0]:
            return [share(0, word, lang) for lang in langs]
        for k in range(language.LONGEST, 0, -1):
            grams = [g for i in range(len(word) + 3 - k) if (g := f"^{word}$"[i : i + k]) in names[k] and (k > 1 or g not in "^$")]
            if grams:
                return [sum(share(k, g, lang) for g in grams) / len(grams) for lang in langs]
        return None

    out = []
    for text in asked:
        found = runs(text)
        total = [0.0] * len(langs)
        for w in found:
            s = score(w)
            total = total if s is None else [a + b - max(s) for a, b in zip(total, s)]
        if not found:
            out.append(("und", 0.0))
            continue
        shares = [math.exp((t - max(total)) / len(found)) for t in total]
        best = max(range(len(langs)), key=lambda i: (shares[i], -i))
        out.append((langs[best], shares[best] / sum(shares)))
    return out


def test_language_equals_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    labelled = [(r.lang, r.text) for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    texts = [r.text for r in rows] + ["qzx the unheard", "Ω", "zzz" * 30]
    want = plain_languages(labelled, texts)
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(asked, language.fit(language.sample(docs))).collect()}
    assert [got[i].lang_pred for i in range(len(texts))] == [w for w, _ in want]
    assert all(abs(got[i].score - s) < 1e-9 for i, (_, s) in enumerate(want))


def plain_toxicity(labelled, asked):
    """Features, gradient ascent and scores in plain loops."""
    feats = lambda w: ["=" + w] + [f"^{w}$"[i : i + n] for n in toxicity.GRAMS for i in range(len(w) + 3 - n)]
    size, pos, neg = Counter(y for y, _ in labelled), Counter(), Counter()
    for y, text in labelled:
        for w in set(runs(text)):
            (pos if y else neg).update(set(feats(w)))
    z = {}
    for f in pos.keys() | neg.keys():
        p, n = pos[f], neg[f]
        if p + n >= 4:
            odds = math.log((p + 0.5) / (size[1] + 1)) - math.log((n + 0.5) / (size[0] + 1))
            z[f] = odds / math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
    index = {f: i for i, f in enumerate(sorted((f for f in z if abs(z[f]) >= toxicity.LEAST_Z), key=lambda f: (-abs(z[f]), f)))}

    def bag(text):
        found = ([index[f] for w in runs(s) for f in feats(w) if f in index] for s in re.findall(r"[^.!?\n]+", text or ""))
        return [x for x in found if x]

    bags = [(y, bag(text)) for y, text in labelled]
    w, b, m, v = [0.0] * len(index), -2.0, [0.0] * (len(index) + 1), [0.0] * (len(index) + 1)
    for t in range(1, 301):
        g = [0.0] * (len(index) + 1)
        for y, sentences in bags:
            ps = [1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(w[f] for f in s))))) for s in sentences]
            clear = math.log1p(-toxicity.LEAK) + sum(math.log1p(-min(p, 1 - 1e-12)) for p in ps)
            whole = max(-math.expm1(clear), 1e-9)
            for p, s in zip(ps, sentences):
                pull = p * math.exp(clear) / whole if y else -p
                for f in s:
                    g[f] += pull
                g[-1] += pull
        g = [x / len(bags) for x in g]
        g = [x - 1e-3 * wi / len(index) for x, wi in zip(g, w)] + g[-1:]
        m = [0.9 * a + 0.1 * x for a, x in zip(m, g)]
        v = [0.999 * a + 0.001 * x * x for a, x in zip(v, g)]
        step = [0.1 * (a / (1 - 0.9**t)) / (math.sqrt(c / (1 - 0.999**t)) + 1e-8) for a, c in zip(m, v)]
        w, b = [x + s for x, s in zip(w, step)], b + step[-1]
    out = []
    for text in asked:
        clear = 1 - toxicity.LEAK
        for s in re.findall(r"[^.!?\n]+", text or ""):
            known = [w[index[f]] for word in runs(s) for f in feats(word) if f in index]
            if known:
                clear *= 1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(known)))))
        out.append(1 - clear)
    return out, len(index)


def test_toxicity_equals_plain_loops(spark):
    rng = random.Random(5)
    mild, vile = ["the", "a", "town", "river", "walk", "green", "stone"], ["vilest", "wretch"]
    rows = []
    for i in range(240):
        y = int(i % 4 == 0)
        words = [[rng.choice(mild) for _ in range(4)] for _ in range(3)]
        if y:
            words[rng.randrange(3)][1] = rng.choice(vile)
        rows.append((i, " ".join(x.capitalize() for x in words[0]) + ". " + ". ".join(" ".join(x) for x in words[1:]) + f". w{chr(97 + i % 26)}{chr(97 + i // 26)}q", y))
    learn = {text: y for i, text, y in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    asked = [t for _, t, _ in rows] + [None, "", "vilest of all\nand more. Wretched", "nothing"]
    want, n = plain_toxicity([(y, t) for t, y in learn.items()], asked)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id int, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.detect(spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string"), model).collect()}
    assert len(model["weights"]) == n > 3
    assert all(abs(got[i] - s) < 1e-5 for i, s in enumerate(want)) and max(want) > 0.9 and min(want) < 0.1
