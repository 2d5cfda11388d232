"""BPE encoding and decoding with a pair occurrence index.

The vocabulary file is of the public word-level kind: NFC, lower case, white space dropped, a split into
contractions, letter runs, single digits and runs of other characters, bytes as symbols, and a word-end
mark on a word's last symbol. A batch's new words are encoded together: an index maps each mergeable pair
to all its positions, pairs are taken by ascending rank, all positions of a pair merge at once (from left
to right where they overlap), and only the neighbours' entries change. A later merge's rank is above that
of the merge that made its parts, so this equals merging each word by its own lowest rank; the heap of
active ranks keeps that order even for vocabularies where it isn't so.

Texts are cut at white space as Arrow columns, some megabytes at a time; each distinct chunk is encoded once, and
texts' ids are gathered from the chunks' by index. Chunks are cached up to a bounded number per Python worker.

Cases: null and empty texts have no ids and decode to an empty string. Special tokens written out in a
text become their ids, as in the public library. Decoding joins the tokens by one space, as that library
does for a vocabulary without a decoder. Letters, digits and cases are those of Unicode 16, as in that library.
"""

from __future__ import annotations

import heapq
import json
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, limit_batches, release_memory, utf8_parts

# Code points that are letters or numbers only since versions of Unicode after 16, which the pattern
# engine here knows and the public library doesn't yet; upper-case letters of Unicode 16 and 17 with their lower case.
_LATER = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    r"\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    r"\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_LOWER_CASE = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)}}
#: Split of the vocabulary file (a fixed value of its format).
WORDS = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATER}]]+|[\p{{N}}--[{_LATER}]]|[^\s[\p{{L}}\p{{N}}--[{_LATER}]]]+")
#: First bytes in UTF-8 of those letters, and of white space beyond ASCII.
_CASED, _SPACED = np.zeros((2, 256), bool)
_CASED[[chr(c).encode()[0] for c in _LOWER_CASE]] = True
_SPACED[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: White space of the format beside that of ASCII.
SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SIGNS = string.punctuation
#: Bytes with ASCII letters in lower case and one kind of ASCII white space.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9:14] = 32
#: Chunks of text that a worker remembers, and text bytes that are cut at a time.
CACHE, ROUND_BYTES = 600_000, 8 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free code from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


class Vocabulary:
    """Merges as sorted pair keys, and an encoder that keeps what it has seen."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges, end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        names = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self._names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.left, self.right, self.into = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs), strict=True))
        key = self.left << 32 | self.right
        self._rank = np.argsort(key, kind="stable")
        self._key = key[self._rank]
        marks = byte_symbols()
        self._inner, self._final = np.array([ids[x] for x in marks]), np.array([ids[x + end] for x in marks])
        self.cache: dict[str, bytes] = {}

    def _ranks(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pair keys are merges, and the ranks of those."""
        at = np.searchsorted(self._key, key)
        at[at == len(self._key)] = 0
        hit = self._key[at] == key
        return hit, self._rank[at[hit]]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words, one after another, and where each word's ids begin (one more entry than words)."""
        parts = [w.encode() for w in words]
        raw = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
        n = len(raw)
        symbol = np.full(n + 1, -1, np.int64)  # the last entry stands beyond every word's edges
        symbol[:n] = self._inner[raw]
        symbol[ends - 1] = self._final[raw[ends - 1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = after[n] = n
        before[0] = n
        before[ends[:-1]] = n
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def add(position: np.ndarray) -> None:
            a, b = symbol[position], symbol[after[position]]
            real = (a >= 0) & (b >= 0)
            position = position[real]
            hit, rank = self._ranks(a[real] << 32 | b[real])
            position = position[hit]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, position = rank[order], position[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, p in zip(rank[np.concatenate(([0], cut))].tolist(), np.split(position, cut), strict=True):
                if r in places:
                    places[r].append(p)
                else:
                    places[r] = [p]
                    heapq.heappush(ranks, r)

        add(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            found = places.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            a, b, c = self.left[r], self.right[r], self.into[r]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b and len(at) > 1:
                taken, used = [], -1
                for p in np.unique(at).tolist():
                    if p != used:
                        taken.append(p)
                        used = after[p]
                at = np.array(taken)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at] = c
            symbol[gone] = -2
            after[at] = beyond
            before[beyond] = at
            near = before[at]
            add(np.concatenate((at, near)))  # a position may come twice; merging it again changes nothing
        alive = symbol[:n] >= 0
        return symbol[:n][alive].astype("<u4"), np.concatenate(([0], np.cumsum(alive)[ends - 1]))

    def _learn(self, new: Iterable[str]) -> None:
        """Adds chunks, and the words that they consist of, to the cache."""
        need, ended, mixed = set(), [], []
        for x in new:
            if x.isalpha():
                need.add(x)
            elif (core := x.rstrip(_SIGNS)).isalpha():  # letters and a run of signs need no pattern
                ended.append((x, core, x[len(core) :]))
            else:
                mixed.append((x, WORDS.findall(x)))
        need.update(x[1] for x in ended)
        need.update(x[2] for x in ended)
        need.update(chain.from_iterable(x[1] for x in mixed))
        need.difference_update(self.cache)
        cache = self.cache
        if need:
            words = list(need)
            ids, cut = self.encode_words(words)
            raw, cut = ids.tobytes(), (cut * 4).tolist()
            cache.update(zip(words, map(raw.__getitem__, map(slice, cut[:-1], cut[1:])), strict=True))
        cache.update([(x, cache[a] + cache[b]) for x, a, b in ended])
        cache.update([(x, b"".join([cache[w] for w in ws])) for x, ws in mixed])

    def _chunk_ids(self, distinct: list[str]) -> list[bytes]:
        """Ids of chunks, which are texts without white space in the form in which they are encoded."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        out = list(map(self.cache.get, distinct))
        at = [k for k, x in enumerate(out) if x is None]
        new = [distinct[k] for k in at]
        self._learn(new)
        for k, x in zip(at, map(self.cache.__getitem__, new), strict=True):
            out[k] = x
        return out

    @staticmethod
    def _normal(text: str, cased: bool = True, spaced: bool = True) -> str:
        """The form in which a text is encoded, with ASCII white space only; no word of the format spans any.

        cased, spaced: it may have letters of _LOWER_CASE, or white space beyond ASCII."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if spaced:
                text = SPACES.sub(" ", text)
            if cased:
                text = text.translate(_LOWER_CASE)
        return text.lower()

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one more entry than texts). texts: as _normal() gives them, or ASCII."""
        raw, at = utf8_parts(texts)
        plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(_PLAIN[raw])])
        lists = pc.split_pattern(plain, " ")
        words = lists.values.dictionary_encode()
        found = pa.array(self._chunk_ids(words.dictionary.to_pylist()), pa.binary()).take(words.indices)
        raw, at = utf8_parts(found)
        return raw.view("<u4"), at[np.asarray(lists.offsets)] // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column in a row, and where each text's ids begin (one more entry than texts)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        plain = pc.string_is_ascii(texts)
        special = pc.and_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, self._special.pattern))
        lower = texts
        if not pc.all(plain).as_py():
            odd = pc.invert(plain)
            raw, at = utf8_parts(texts)
            cased, spaced = ((np.diff(np.searchsorted(np.flatnonzero(x[raw]), at)) > 0)[odd.to_numpy(zero_copy_only=False)].tolist() for x in (_CASED, _SPACED))
            lower = pc.replace_with_mask(lower, odd, pa.array(map(self._normal, texts.filter(odd).to_pylist(), cased, spaced), pa.large_string()))
        if not pc.any(special).as_py():
            return self._cut(lower)
        # texts with special tokens are cut around these, and all pieces are encoded as texts of their own
        rows, back = [], []
        for text, row, has in zip(lower.to_pylist(), texts.to_pylist(), special.to_pylist(), strict=True):
            pieces = self._special.split(row) if has else [text]
            back.append(pieces[1::2])
            rows += map(self._normal, pieces[::2]) if has else pieces
        ids, at = self._cut(pa.array(rows, pa.large_string()))
        out, starts, k = [], [0], 0
        for between in back:
            size = 0
            for name in [*between, None]:
                out.append(ids[at[k] : at[k + 1]])
                size, k = size + len(out[-1]), k + 1
                if name is not None:
                    out.append(np.array([self.special[name]], "<u4"))
                    size += 1
            starts.append(starts[-1] + size)
        return np.concatenate(out), np.array(starts)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts that ids [at[k], at[k + 1]) stand for."""
        return pc.binary_join(pa.ListArray.from_arrays(at.astype(np.int32), self._names.take(pa.array(ids))), " ")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's own copy; it stays for later tasks."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encoded(path: str, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [i, j) of a string column with their ids in a row and where each row's ids begin, some megabytes of text at a time."""
    vocab = vocabulary(path)
    _, offsets = utf8_parts(column)
    for i, j in chunks(offsets, ROUND_BYTES):
        yield i, j, *vocab.encode(column.slice(i, j - i))


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def encode_column(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) and the text that they decode to. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for i, j, ids, at in encoded(path, batch.column(1)):
                raw = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at * 4), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), raw.cast(pa.binary()), vocab.decode(ids, at)], schema=_ENCODED)
        release_memory()

    limit_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def digest_columns(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
