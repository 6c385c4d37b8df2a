"""Token ids inside tasks: an exact encoder for a word-level BPE file, and CRC-32C over many records at once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folium.llm.common import kept_by_worker, parts

#: Words and ids kept per worker before its memo starts again, and the longest word that is encoded together with others.
MEMO, MEMO_IDS, LONGEST = 300_000, 4_000_000, 64
#: Words that one call of the library encodes.
TOGETHER = 500


#: A word of precomposed Latin letters before marks other than the apostrophe: the tokenizer lower-cases it and takes
#: the letters as one pre-token and the marks as another.
_SIMPLE = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def _gathered(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ``values`` of these starts and lengths, one after the other."""
    before, total = np.cumsum(length) - length, int(length.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64  # half the memory
    at = np.repeat((start - before).astype(kind), length)
    at += np.arange(total, dtype=kind)
    return values[at]


class Encoder(dict):
    """Text to ids as little-endian unsigned 32-bit bytes.

    The tokenizer splits at white space before it merges, so a text's ids are those of its space-separated chunks
    in turn. Arrow splits many texts at once and tells their different chunks; their words are encoded by the tokenizers
    library, many in one call, and remembered by number; texts are then gathered from the numbers' ids. Texts that
    hold a special token's string go to the library whole.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.ids, self.sizes = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)  # of all known words, by number

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _together(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids, and how many for each, of words of letters in one call: each is one pre-token, whose number every id carries."""
        for a in range(0, len(words), TOGETHER):
            part = words[a : a + TOGETHER]
            got = self.library.encode(" ".join(part), add_special_tokens=False)
            yield np.array(got.ids, dtype="<u4"), np.bincount(np.array(got.word_ids), minlength=len(part))

    def _numbers(self, chunks: list[str], letters: bool) -> np.ndarray:
        """The numbers of different chunks; those that are new are learnt."""
        new = [c for c in chunks if c not in self]
        if new:
            got = list(self._together(new)) if letters else [(np.array(x, dtype="<u4"), np.array([len(x)])) for x in map(self.whole, new)]
            self.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.ids, self.sizes = np.concatenate([self.ids, *(x for x, _ in got)]), np.concatenate([self.sizes, *(n for _, n in got)])
        return np.fromiter(map(self.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def _encoded(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks, one after the other, and how many each has."""
        found = pc.extract_regex(chunks, _SIMPLE)
        simple = pc.and_(found.is_valid(), pc.less_equal(pc.utf8_length(chunks), LONGEST))
        other, found = chunks.filter(pc.invert(simple)), found.filter(simple)
        words, marks = pc.utf8_lower(found.field("word")).dictionary_encode(), found.field("marks").dictionary_encode()
        simple = simple.to_numpy(zero_copy_only=False)
        pairs = np.full((len(chunks), 2), -1)
        pairs[simple, 0] = self._numbers(words.dictionary.to_pylist(), True)[words.indices.to_numpy()]
        pairs[simple, 1] = self._numbers(marks.dictionary.to_pylist(), False)[marks.indices.to_numpy()]
        pairs[~simple, 0] = self._numbers(other.to_pylist(), False)
        sizes = np.append(self.sizes, 0)[pairs]  # -1 has none
        starts = np.append(np.cumsum(self.sizes) - self.sizes, 0)[pairs]
        return _gathered(self.ids, starts.ravel(), sizes.ravel()), sizes.sum(axis=1)

    def _joined(self, texts: pa.Array) -> list[bytes]:
        if len(self) > MEMO or len(self.ids) > MEMO_IDS:
            self._forget()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = split.values.dictionary_encode()
        ids, sizes = self._encoded(chunks.dictionary)
        own = chunks.indices.to_numpy()
        raw = _gathered(ids, (np.cumsum(sizes) - sizes)[own], sizes[own]).tobytes()
        ends = (4 * np.append(0, np.cumsum(sizes[own])))[split.offsets.to_numpy()].tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode_many(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        special = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        out: list[bytes] = []
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        for a, b in parts(plain):
            out += self._joined(plain.slice(a, b - a))
        for i in np.nonzero(special)[0].tolist():
            out[i] = np.array(self.whole(texts[i].as_py()), dtype="<u4").tobytes()
        return out


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a file."""
    return kept_by_worker(("encoder", path), lambda: Encoder(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# CRC-32C: records are cut into blocks, all blocks go through the table in step, and a record's blocks are then joined.
_BLOCK = 64
_POLY = 0x82F63B78


def _span(basis: list[int]) -> np.ndarray:
    """The XOR combinations of 16 basis values, by index bits."""
    out = np.zeros(1, dtype=np.uint32)
    for b in basis:
        out = np.concatenate([out, out ^ np.uint32(b)])
    return out


def _shifted(x: int, bits: int) -> int:
    for _ in range(bits):
        x = (x >> 1) ^ (_POLY if x & 1 else 0)
    return x


_STEP = _span([_shifted(1 << i, 16) for i in range(16)])
_LOW = _span([_shifted(1 << i, 8 * _BLOCK) for i in range(16)])
_HIGH = _span([_shifted(1 << i, 8 * _BLOCK) for i in range(16, 32)])


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of each record."""
    n = len(records)
    if not n:
        return np.zeros(0, dtype=np.uint32)
    size = np.array([len(r) for r in records])
    blocks = np.maximum(1, -(-size // _BLOCK))
    ends = np.cumsum(blocks)
    flat = np.zeros(int(ends[-1]) * _BLOCK, dtype=np.uint8)
    for r, e in zip(records, (ends * _BLOCK).tolist(), strict=True):
        if r:
            flat[e - len(r) : e] = np.frombuffer(r, dtype=np.uint8)
    first = ends * _BLOCK - size
    for k in range(4):  # the register starts as all ones
        has = size > k
        flat[first[has] + k] ^= 0xFF
    words = np.ascontiguousarray(flat.view("<u2").reshape(-1, _BLOCK // 2).T).astype(np.uint32)
    crc = np.zeros(int(ends[-1]), dtype=np.uint32)
    for w in words:
        crc = _STEP[(crc ^ w) & 0xFFFF] ^ (crc >> 16)
    order = np.argsort(-blocks, kind="stable")
    counts, begin = blocks[order], (ends - blocks)[order]
    out = crc[begin]
    for k in range(1, int(counts[0])):
        live = int(np.searchsorted(-counts, -k, side="left"))
        x = out[:live]
        out[:live] = _LOW[x & 0xFFFF] ^ _HIGH[x >> 16] ^ crc[begin[:live] + k]
    result = np.empty(n, dtype=np.uint32)
    result[order] = out
    for i in np.nonzero(size < 4)[0]:  # too short to carry the start value
        c = 0xFFFFFFFF
        for b in records[i]:
            c = _shifted((c ^ b) & 0xFF, 8) ^ (c >> 8)
        result[i] = c
    return result ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The rotation and offset that keep a checksum of checksummed data from being degenerate."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
