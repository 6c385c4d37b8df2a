from __future__ import annotations

import random
import re

from folium.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, n_words string, _t string, failed int"


def measures(text):
    """The contract's measures and the method's, by plain loops."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    stop = {s + m for s in qr.STOP_WORDS for s in (s, s.capitalize()) for m in ("", *".,;:!?")}
    out = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "n_lines": len(lines),
        "n_ellipsis_lines": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines),
        "n_bullet_lines": sum(bool(re.search(r"^[\x20\x09-\x0D]*[-*•‣]", x)) for x in lines),
        "n_upper": sum(c.isupper() and c.isalpha() for c in text),
        "n_stop_words": sum(w in stop for w in words),
    }
    out["base_failed"] = out["n_words"] < 20 or 100 * out["n_repeat_words"] > 30 * out["n_words"]
    return out


def failed(m):
    if m["base_failed"]:
        return "base"
    for name, top, op, percent, bottom in qr.THRESHOLDS:
        a, b = m[top] / (m["word_chars"] if bottom == "word_chars_100" else m[bottom] or 1), percent / (10_000 if bottom == "word_chars_100" else 100)
        if a < b - 1e-12 if op == "<" else a > b + 1e-12:
            return name
    return None


def texts():
    rng = random.Random(1)
    plain = "the of and a house with some roof is that for good ".split()
    out = [None, "", " \t\n\x0b", "\x85 \xa0word x", "one two three", "the of and " * 4_000, "🜁 é ß the of " * 10]
    out += [" ".join(rng.choice(plain) + str(i % 7) * (i % 3) for i in range(n)) for n in (19, 20, 21, 300)]
    out += ["\n".join(f"- the item {rng.choice(plain)} {i} of a list of things..." for i in range(12)), "THE SHOUTED WORDS OF A MAN " * 2 + " ".join(f"W{i}" for i in range(30))]
    out += ["#$% & | < > the of and " + " ".join(f"* word{i}" for i in range(30)), "\n".join(["the same line of words", "and another line " + "x" * 3, "the same line of words"] * 3)]
    for _ in range(150):
        vocab = plain + [rng.choice(["w" * 30, "#", "...", "-", "A", "Ünï", "x.", "The,"]) for _ in range(rng.randrange(6))]
        out.append("".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\n", "\t", "  ", ""]) for _ in range(rng.randrange(120))))
    return out


def test_equals_plain_loops(spark):
    rows = [(i, t, "clash", "clash", 1) for i, t in enumerate(texts())] + [(3, texts()[3], None, None, 2), (None, "no id " * 30, None, None, 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = qr.quality_rules(docs).collect()
    assert len(got) == len(rows) and got[0].base_failed and not got[0].kept
    by = {i: t for i, t, *_ in rows}
    seen = set()
    for r in got:
        want = measures(by[r.doc_id])
        assert {k: r[k] for k in want} == want, by[r.doc_id]
        assert r.failed == failed(want) and r.kept == (r.failed is None), (by[r.doc_id], want)
        seen.add(r.failed)
    assert {None, "base", "symbols", "shouting"} <= seen
    assert qr.quality_rules(docs.limit(0)).collect() == []
    assert {tuple(r) for r in qr.quality_rules(docs, keep=["doc_id", "text"]).select("doc_id", "text").collect()} == {(i, t) for i, t, *_ in rows}


def test_no_python_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "x", "", "", 1)], SCHEMA)
    plan = qr.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
