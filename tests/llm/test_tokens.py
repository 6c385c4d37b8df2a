from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import packing, token_records, tokens

SCHEMA = "doc_id long, text string, sequence_id string, n_tokens string"
TEXTS = [None, "", " ", "Hello  world\n\tagain", "it's 2024!!", "<|endoftext|> a<|startoftext|>b", "x" * 3000, "é" * 50 + " ß İ Σς", "a b\x1cc\x85d", "word " * 9000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def docs(spark):
    rows = [(i, t, "clash", None) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash", None), (None, "no id", None, None), (-5, "below", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def test_encoder_equals_library(library):
    e = tokens.Encoder(tokens.default_path())
    rng = random.Random(3)
    made = ["".join(rng.choice("ab c.,'s1é \n\t́ !") for _ in range(200)) for _ in range(200)]
    made += ["".join(rng.choice(["Thé", "word", "ß", "É", "'", "!", ".,", "_", "$%", " ", "12", "ing", "'s"]) for _ in range(60)) for _ in range(300)]
    for texts in ([*TEXTS, *made], made[:50]):
        for t, got in zip(texts, e.encode_many(texts), strict=True):
            assert got == np.array(ids(library, t, 0)[:-1], dtype="<u4").tobytes(), t


def test_crc32c():
    assert tokens.crc32c([b"123456789", b"", b"a", b"\x00" * 32, b"\xff" * 32]).tolist() == [0xE3069283, 0, 0xC1D04330, 0x8A9136AA, 0x62A8AB43]
    long = bytes(range(256)) * 5
    assert tokens.crc32c([long, long[:700]])[1] == tokens.crc32c([long[:700]])[0]


def test_round_trip(spark, library):
    got = [tuple(r) for r in token_records.round_trip(docs(spark)).orderBy(F.col("start")).collect()]
    want, start = [], 0
    rows = sorted([(r.doc_id, r.text) for r in docs(spark).collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in rows:
        x = np.array(ids(library, t, 2), dtype="<u4")
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert got == want
    assert token_records.round_trip(docs(spark).limit(0)).collect() == []


def test_frames_are_sought_in_any_order(spark, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = token_records.write(docs(spark), folder).persist()
    want = sorted(map(tuple, token_records.read(manifest, folder).collect()), key=lambda r: r[1])
    small = token_records.read(manifest, folder, frames=3, seed=1)
    assert small.rdd.getNumPartitions() == sum(-(-r.n_records // 3) for r in manifest.collect()) > 3
    assert sorted(map(tuple, small.collect()), key=lambda r: r[1]) == want
    record = next(tmp_path.glob("*.rec"))
    raw = bytearray(record.read_bytes())
    raw[-6] ^= 1
    record.write_bytes(raw)
    with pytest.raises(Exception, match="checksum differs"):
        token_records.read(manifest, folder).collect()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing(spark, library, rule):
    got = packing.packed(docs(spark), rule=rule).collect()
    seqs = {}
    for r in got:
        assert 1 <= r.length <= 4096
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    for i, t in enumerate(TEXTS):
        x = np.array(ids(library, t, 1), dtype="<u4")
        mine = {(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i}
        assert mine == {(k, a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(x), 4096))}
    assert packing.packed(docs(spark).limit(0)).collect() == []


def test_short_pieces_fill_their_sequences(spark):
    parts = spark.range(30_000, numPartitions=4).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "10L AS length", "7L AS ids_crc32")
    rows = packing.pack(parts, shard=1_000).collect()
    assert len(rows) == 30_000 and len({r.sequence_id for r in rows}) <= -(-30_000 // 409)
    three = packing.pack(parts.limit(3_000), max_docs=3, shard=1_000).groupBy("sequence_id").count().collect()
    assert {r["count"] for r in three} <= {1, 2, 3} and len(three) <= 1_003


def test_best_fit_keeps_every_capacity():
    lengths = np.array(sorted(np.random.default_rng(0).integers(1, 3000, 3000), reverse=True))
    for caps in ((4096.0, 4096.0, 4096.0**2), (4096.0, 3.0, 1e7), (4096.0, 4096.0, 9.1e6)):
        bins, offsets = packing.best_fit(lengths, caps, (1.0, 1e-4, 1e-4), "norm")
        assert np.bincount(bins, lengths).max() <= caps[0] and np.bincount(bins).max() <= caps[1] and np.bincount(bins, lengths.astype(float) ** 2).max() <= caps[2]
    bins, _ = packing.best_fit(lengths, (4096.0, 4096.0, 4096.0**2), (1.0, 1e-4, 1e-4), "norm")
    assert bins.max() + 1 <= 1.02 * lengths.sum() / 4096 + 1


def test_words_are_looked_up_once_for_many_texts(library):
    class Counted:
        def __init__(self):
            self.words = 0

        def encode(self, text, **options):
            self.words += len(text.split(" "))
            return library.encode(text, **options)

    e = tokens.Encoder(tokens.default_path())
    e.library = Counted()
    texts = [f"Alpha beta, GAMMA; alpha. w{'abcdefghij'[i % 10]}x" for i in range(1500)]
    got = e.encode_many(texts)
    assert got[:20] == [np.array(ids(library, t, 0)[:-1], dtype="<u4").tobytes() for t in texts[:20]]
    assert e.library.words <= 20  # a word once, whatever its case and the marks after it, and not again for each 500 texts
    e.ids = np.concatenate([e.ids, np.zeros(tokens.MEMO_IDS, dtype="<u4")])  # a full memo starts again
    assert e.encode_many(texts[:20]) == got[:20]
    assert len(e.ids) < 100
