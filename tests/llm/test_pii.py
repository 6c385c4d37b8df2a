from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from folium.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    atoms = ["a", "b.c", "@", ".", "-", "+", "1", "25", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "\n", "é", "x@y.z", "+49 (0)30 1234567", "10.0.0.1", "..", "00255"]
    for _ in range(3000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain(text), text
    assert pii.base_spans("7" * 200_000 + "a" * 200_000 + "@" * 1000) == []


ROWS = [(1, None), (2, ""), (3, "write bob@x.org today"), (3, "write bob@x.org today"), (None, "call +49 30 1234567 now")]
ROWS += [(10 + i, f"{w} the zebrafish keeper bob@x.org said {w} in town") for i, w in enumerate(["alpha", "beta", "gamma", "delta"])]
ROWS += [(100 + i, f"nothing here but the town and a word{chr(97 + i % 26)} in it") for i in range(60)]
ROWS += [(200 + i, "ann@y.org owns the copied gardenia house") for i in range(8)]
ROWS += [(300 + i, f"the zebra, zebras and {'townsfolk ' * i}of the town") for i in range(4)] + [(310, "the ½Zebrafish² of 10.0.0.1 and carl@z.org\n" + "the town " * 20_000)]


def disclosed(texts):
    """The disclosing terms with what is done to them, by plain counting over the different texts."""
    texts = sorted({t or "" for t in texts})
    words = [{w.lower() for w in re.findall(r"[^\W\d_]+", re.sub("[½²]", " ", t))} for t in texts]
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    name = lambda k, v: (k, v.lower() if k == 0 else v if k == 1 else digits(v))
    ents = [{name(k, t[a:b]) for k, a, b in plain(t)} for t in texts]
    df_t, df_e, joint = Counter(w for x in words for w in x), Counter(e for x in ents for e in x), Counter()
    for w, e in zip(words, ents, strict=True):
        joint.update((a, b) for a in w for b in e)
    best: dict = {}
    for (w, e), j in joint.items():
        bits = math.log2((df_t[w] + pii.SMOOTH) * (df_e[e] + pii.SMOOTH) / (j * df_e[e]))
        if bits <= pii.GENERALISE and bits <= (1 - pii.GAIN) * math.log2(len(texts) / df_e[e]):
            best[w] = min(bits, best.get(w, bits))
    out = {}
    for w, bits in best.items():
        out[w] = "removed" if bits <= pii.REMOVE else "generalised"
    return out


def test_digest_and_disclosure(spark):
    docs = spark.createDataFrame([(i, t, "spans", 1, b"k", "t") for i, t in ROWS], "doc_id long, text string, spans string, contexts int, text_key binary, terms string")
    got = sorted([tuple(r) for r in pii.pii_digest(docs).collect()], key=str)
    want_terms = disclosed([t for _, t in ROWS])
    found = pii.disclosing(docs).collect()
    told = {r.term: r.general for r in found}
    assert {r.term: "removed" if r.action == "remove" else "generalised" for r in found} == want_terms and len(found) == len(told)
    assert {"zebrafish", "keeper", "said", "alpha", "gardenia"} <= told.keys() and not {"the", "town", "in"} & told.keys()
    assert all((g == "") == (want_terms[w] == "removed") and g in ("", "[TERM]", w[: len(g) - 1] + "…") for w, g in told.items())
    want = []
    for i, t in ROWS:
        base = plain(t or "")
        free = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_½²]+", t or "") if m.group().lower() in told and not any(a < m.end() and b > m.start() for _, a, b in base)]
        name = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        want.append((i, *[sum(s[0] == k for s in base) for k in range(4)], hashlib.sha256(",".join(name).encode()).hexdigest(), ",".join(name + [f"term:{a}:{b}" for a, b in free])))
    assert got == sorted(want, key=str)
    assert pii.pii_digest(docs.limit(0)).collect() == []
    made = pii.sanitise(docs)
    rows = made.collect()
    clean = {(r.doc_id, r.text) for r in rows}
    assert (1, None) in clean and (2, "") in clean and all("@" not in (t or "") and "zebrafish" not in (t or "").lower() for _, t in clean)
    assert made.columns == docs.columns and len(rows) == len(ROWS)


def test_pairs_seen_once_are_scored(spark):
    rows = [(i, f"plain words of the common kind {chr(97 + i % 26)}{chr(97 + i // 26)}q go on") for i in range(300)]
    rows += [(899, "plainness of plain words to fred@z.org")]
    rows += [(900, "the platypus wrote to carl@z.org and the common kind")] + [(901 + i, "the wombat wrote to dora@z.org and the common kind") for i in range(3)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "platypus" not in got[900] and "wombat" not in got[901]
    assert all(w in got[900].split() for w in ("the", "common", "kind")) and got[0] == rows[0][1]
    assert got[899] == "pla… of plain words to [EMAIL]"  # shared with a term of another text; a longer one would tell as much as the word


def forms_disclose(rows, clean):
    """The forms of sanitised texts that leave too few bits of an entity, by counting in the texts that are handed out."""
    texts = {t or "": clean[i] or "" for i, t in rows}
    ents = {t: {(k, t[a:b].lower()) for k, a, b in plain(t)} for t in texts}
    forms = {t: set(re.findall(r"[^\W\d_]+…|\[TERM\]", c)) for t, c in texts.items()}
    df_f, df_e, joint = Counter(f for x in forms.values() for f in x), Counter(e for x in ents.values() for e in x), Counter()
    for t in texts:
        joint.update((f, e) for f in forms[t] for e in ents[t])
    bits = lambda f, e, j: math.log2((df_f[f] + pii.SMOOTH) * (df_e[e] + pii.SMOOTH) / (j * df_e[e]))
    told = {f for (f, e), j in joint.items() if bits(f, e, j) <= min(pii.GENERALISE, (1 - pii.GAIN) * math.log2(len(texts) / df_e[e]))}
    return told, df_f


def test_forms_do_not_disclose(spark):
    rng = random.Random(6)
    syllables = ["stn", "ting", "ou", "pla", "tion", "ha", "er", "ble", "qua"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 6)))
    rows = [(i, " ".join(["the common words of it", *(word() for _ in range(6))]) + (f" to u{i % 60}@x{i % 7}.org" if i % 3 else "")) for i in range(240)]
    rows += [(500 + i, f"platypusses plat{'y' * 40} wrote {w} to one@a.org") for i, w in enumerate(["platys", "platyx"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told, df = forms_disclose(rows, {r.doc_id: r.text for r in pii.sanitise(docs).collect()})
    assert not told and sum(f != "[TERM]" for f in df) > 20
    kinds = {r.action for r in pii.disclosing(docs).collect()}
    assert "generalise" in kinds


def test_forms_of_the_given_table_do_not_disclose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    told, df = forms_disclose(rows, {r.doc_id: r.text for r in pii.sanitise(docs).collect()})
    assert not told and sum(n > 1 for n in df.values()) == len(df)


def test_parts_of_counts_have_the_same_keys_again(spark):
    docs = spark.createDataFrame([(f"{i}".encode(), f"alpha beta word{i % 5}") for i in range(50)], "text_key binary, text string").repartition(3)
    words = spark.createDataFrame([("alpha",), ("beta",), ("word3",)], "term string")
    from folium.llm import common

    sc = spark.sparkContext
    holder, none = sc.broadcast(common.bloom(words)), sc.broadcast(common.bloom(words.limit(0).select("term")))
    once, again = ({(bytes(r.text_key), tuple(r.terms), tuple(r.counts)) for r in pii._terms(docs, holder, none).collect()} for _ in range(2))
    assert once == again and all(len(k) != 16 for k, _, _ in once)


def test_terms_go_wherever_they_stand(spark):
    rows = [(i, f"plain words of the common kind {chr(97 + i % 26)}{chr(97 + i // 26)}q go on") for i in range(300)]
    far = "plain words of the common kind " * 4
    rows += [(900 + i, f"{w} quokka qx {far} sent it to eve@w.org {far} quokka, plains") for i, w in enumerate(["one", "two", "three"])] + [(910, "the Quokka of the common kind")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("quokka" not in t.lower() for t in got.values()) and "qx" not in got[900].split() and "common" in got[900]
    spans = {r.doc_id: r.spans for r in pii.pii_digest(docs).collect()}
    assert spans[910] == "term:4:10" and f"term:{rows[300][1].rindex('quokka')}:" in spans[900]


def test_registered_query_finds_terms(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, hits = disclosed(texts.values()), 0
    for r in entry.queries()["op10_pii"](spark, sf).collect():
        found = [s.split(":") for s in r.spans.split(",") if s.startswith("term:")]
        assert all(texts[r.doc_id][int(a) : int(b)].lower() in want for _, a, b in found)
        hits += len(found)
    assert hits > 100


def test_filters_never_say_no_to_what_is_there(spark):
    from folium.llm import common

    items = [f"word{i}" for i in range(3000)]
    made = common.bloom(spark.createDataFrame([(x,) for x in items], "s string"))
    assert all(x in made for x in items) and sum(f"other{i}" in made for i in range(3000)) < 60
    assert "x" not in common.bloom(spark.createDataFrame([], "s string"))
    import pickle

    assert "word1" in pickle.loads(pickle.dumps(made))


def test_filter_and_words_of_a_text():
    import numpy as np

    from folium.llm.common import Bloom, letter_runs

    held = np.zeros(1 << 10, np.uint64)
    for p in (p for i in range(900) for p in Bloom.places(f"w{chr(97 + i % 26) * (i // 26 + 1)}", 1 << 16)):
        held[p >> 6] |= np.uint64(1) << np.uint64(p & 63)
    filled = Bloom(held)
    items = [f"w{chr(97 + i % 26) * (i // 26 + 1)}" for i in range(1800)]
    assert [x in filled for x in items] == [all(int(held[p >> 6]) >> (p & 63) & 1 for p in Bloom.places(x, 1 << 16)) for x in items]
    assert all(x in filled for x in items[:900]) and "wa" not in Bloom(np.zeros(0, np.uint64))
    text = " ".join(items) + " WA x½y Ⅳ WBb"
    assert set(pii._Wanted(filled).words_of(text)) == {w for w in map(str.lower, letter_runs(text)) if w in filled}
    assert set(pii.words_of(text)) == set(map(str.lower, letter_runs(text)))
