"""Operator 7: unigram pieces: Viterbi over a double-array trie with log scores, byte fallback, and decoding."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: A character without a piece costs this much below the least piece.
PENALTY = 10.0
#: Chunks that a worker remembers before it starts again, and the longest of them.
MEMO, LONGEST = 400_000, 64
#: White space starts a chunk and a line break is one: no piece reaches across either, so chunks are cut apart exactly.
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces of a model file by id, with log scores.

    A file whose scores are merge ranks carries no probabilities; its pieces then get the log of a Zipf share by rank.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.piece = [lib.id_to_piece(i) for i in range(n)]
        usable = np.array([not (lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i) or lib.is_unused(i)) for i in range(n)])
        raw = np.array([lib.get_score(i) for i in range(n)], dtype=np.float64)
        ranks = bool(np.all(raw[usable] == np.round(raw[usable])))
        if ranks:
            place = np.where(raw < -n, n, -raw)
            share = math.log(sum(1 / (k + 2) for k in range(n)))
            raw = -np.log(place + 2) - share
        self.score = np.where(usable, raw, 0.0).astype(np.float32)
        self.least = np.float32(self.score[usable].min()) - np.float32(PENALTY)
        self.unknown = lib.unk_id()
        self.byte = np.full(256, self.unknown, dtype=np.int64)
        for i in range(n):
            if lib.is_byte(i):
                self.byte[int(self.piece[i][3:5], 16)] = i
        self.usable = usable
        words = {i: self.piece[i] for i in np.nonzero(usable)[0].tolist()}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in words.values()):
            raise ValueError("a piece reaches across white space or a line break")
        self.surface = [p.replace(SPACE, " ").encode() if usable[i] else b"" for i, p in enumerate(self.piece)]
        for b in range(256):
            if self.byte[b] != self.unknown:
                self.surface[self.byte[b]] = bytes([b])
        self.surface[self.unknown] = " ⁇ ".encode()
        self.base, self.check, self.value, self.depth = double_array({p.encode(): i for i, p in words.items()})


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``base, check, value`` and the longest key: from state s, byte b leads to t = base[s] + b + 1 where check[t] = s."""
    root: dict = {}
    for key, number in keys.items():
        node = root
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = number
    size = 1 << 10
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    used = np.zeros(size, bool)
    used[0] = True
    first = 1  # no free place below
    queue = [(0, root)]
    for state, node in queue:
        labels = sorted(b for b in node if b >= 0)
        value[state] = node.get(-1, -1)
        if not labels:
            continue
        offsets = np.array(labels) + 1
        while used[first]:
            first += 1
        place = max(first - offsets[0], 0)
        while True:
            while place + 512 + 257 > size:
                base, check, value, used = (np.concatenate([x, np.full(size, fill, x.dtype)]) for x, fill in ((base, 0), (check, -1), (value, -1), (used, False)))
                size *= 2
            window = ~used[place : place + 512 + 257]
            good = np.ones(512, bool)
            for o in offsets:
                good &= window[o : o + 512]
            at = int(np.argmax(good))
            if good[at]:
                place += at
                break
            place += 512
        base[state] = place
        for b in labels:
            t = place + b + 1
            used[t], check[t] = True, state
            queue.append((t, node[b]))
    return base, check, value, max(map(len, keys), default=0)


def viterbi(model: Pieces, words: list[str]) -> list[list[int]]:
    """The best segmentation of each word, all words in step: one start and one length at a time.

    Scores add up in single precision; of equal paths to a place the one from the earlier start stays.
    """
    data = [w.encode() for w in words]
    size = np.array([len(d) for d in data])
    n, width = len(data), int(size.max()) if len(data) else 0
    text = np.zeros((n, width + 1), dtype=np.int64)
    for i, d in enumerate(data):
        text[i, : len(d)] = np.frombuffer(d, dtype=np.uint8)
    char = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
    best = np.full((n, width + 1), -np.inf, dtype=np.float32)
    best[:, 0] = 0
    start, piece = np.zeros((n, width + 1), np.int64), np.full((n, width + 1), -1, np.int64)
    for i in range(width):
        begin = np.nonzero((size > i) & np.isfinite(best[:, i]) & ((text[:, i] & 0xC0) != 0x80))[0]
        if not len(begin):
            continue
        single = np.zeros(n, bool)
        act, state = begin, np.zeros(len(begin), np.int64)
        for j in range(i, min(width, i + model.depth)):
            t = model.base[state] + text[act, j] + 1
            ok = (model.check[t] == state) & (size[act] > j)
            act, state = act[ok], t[ok]
            if not len(act):
                break
            found = model.value[state]
            has = found >= 0
            rows, ids = act[has], found[has]
            single[rows[char[rows, i] == j + 1 - i]] = True
            score = model.score[ids] + best[rows, i]
            better = score > best[rows, j + 1]
            rows = rows[better]
            best[rows, j + 1], start[rows, j + 1], piece[rows, j + 1] = score[better], i, ids[better]
        rest = begin[~single[begin]]
        ends = i + char[rest, i]
        score = best[rest, i] + model.least
        better = score > best[rest, ends]
        rest, ends = rest[better], ends[better]
        best[rest, ends], start[rest, ends], piece[rest, ends] = score[better], i, -1
    out = []
    for r, d in enumerate(data):
        at, path = len(d), []
        while at:
            s = int(start[r, at])
            path.append(int(piece[r, at]) if piece[r, at] >= 0 else [int(model.byte[b]) for b in d[s:at]])
            at = s
        out.append([x for p in reversed(path) for x in (p if isinstance(p, list) else [p])])
    return out


class Segmenter(dict):
    """Chunks to ids as little-endian unsigned 32-bit bytes, remembered per worker."""

    def __init__(self, model: Pieces) -> None:
        super().__init__()
        self.model = model

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Segment chunks that are not known yet, those of like length together; long ones are not remembered."""
        new = sorted(chunks - self.keys(), key=len)
        if len(self) + len(new) > MEMO:
            self.clear()
            new = sorted(chunks, key=len)
        long = {}
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            while part:
                k = len(part) if len(part[-1]) <= LONGEST else max(1, sum(len(w) <= LONGEST for w in part))
                for w, ids in zip(part[:k], viterbi(self.model, part[:k]), strict=True):
                    (self if len(w) <= LONGEST else long)[w] = np.array(ids, dtype="<u4").tobytes()
                part = part[k:]
        return long

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [_CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        long = self.learn(set().union(*split))
        get = self.__getitem__ if not long else lambda w: long[w] if w in long else self[w]
        return [b"".join(map(get, chunks)) for chunks in split]

    def decode(self, ids: np.ndarray) -> str:
        """Pieces back to text: markers to spaces, bytes to characters, without the first marker that encoding adds."""
        text = b"".join(map(self.model.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_segmenters: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    if path not in _segmenters:
        _segmenters[path] = Segmenter(Pieces(path))
    return _segmenters[path]


def encode_decode(docs: DataFrame, path: str | None = None, step: int = 200) -> DataFrame:
    """``doc_id, n_pieces, n_fallback, ids_crc32, decoded_crc32, round_trip`` for every row of ``docs``.

    ids_crc32 is over the ids as little-endian unsigned 32-bit numbers, decoded_crc32 over the decoded text's UTF-8.
    Null text counts as empty and has no pieces; repeated rows give equal rows; an empty table gives none. A text that
    itself holds the white-space marker decodes to a space there, so round_trip is false. Other columns are not read.
    """
    path = path or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(path)
        fallback = np.zeros(len(seg.model.piece), bool)
        fallback[seg.model.byte] = True
        for batch in batches:
            out: list[tuple] = []
            for a in range(0, batch.num_rows, step):
                texts = batch.column(1).slice(a, step).to_pylist()
                for text, raw in zip(texts, seg.encode(texts), strict=True):
                    ids = np.frombuffer(raw, dtype="<u4")
                    back = seg.decode(ids)
                    out.append((len(ids), int(fallback[ids].sum()), zlib.crc32(raw), zlib.crc32(back.encode()), back == (text or "")))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 4 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_pieces", "n_fallback", "ids_crc32", "decoded_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n_pieces long, n_fallback long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
