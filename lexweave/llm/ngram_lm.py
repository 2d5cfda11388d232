"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by the workers.

Counting: words are 48 bits of hash. Each task turns its training documents into n-grams, adds equal ones up and sends
them packed by bucket. A bucket adds them up again and writes one segment of the model; its distinct n-grams count as
continuations of the next lower order, down to single words. So that little lies on disk at a time, the n-grams of an order
go in PASSES turns by bucket: what a turn has sent is gone before the next one, and so is what it has read from the order
above. The first turn also counts plain words. The counts of counts give three discounts per order; the lowest order is
interpolated with the uniform distribution over V + 1 words (one for unknown).

Buckets: an n-gram of three words or more is dealt by its last context word and by its whole context, half of the bits
each, so that a context is in one bucket, the n-grams that continue one lower n-gram are in few, and a word that is a third
of all tokens is in many. A pair of words is dealt by the first, of which there are V followers at most.

Segments: sorted arrays. Contexts: 40 bits of hash, and a code into a table of what is known of a context (its number of
n-grams, count, and how many n-grams have counts 1, 2 and 3 or more), as most contexts are alike. N-grams: by context, 32
bits of the word's hash and a code into the table of counts. Unlike ones that share a bucket's bits and these
stay rare: a chance of n / 2^40 per unknown context of a bucket with n contexts, and of m / 2^32 per unknown word
after a context with m followers.

Scoring: workers map the segments and look batches of n-grams up, bucket after bucket. What is counted grows with
the corpus; what a worker holds is a batch, some hundred mapped segments and pages of these. A segment's place follows from its
bucket, so the model that is sent to workers is a folder and a few numbers. Segments lie in the folder that executors
share; under a file system that can't be mapped a worker reads those that it needs into memory.

Cases: null and empty texts are the end token alone. A document's start is a context of its own; its end is a token. Rows
with a null id aren't learned from and count as held out. Repeated rows count as often as they stand. Without training
rows every token has probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .segments import Segments, coded, narrow, write_segment
from .shared import U64, chunks, delete_path, hash_words, limit_batches, mix, release_memory, release_shuffles, scratch_path, utf8_parts

_CUT = U64(16)
START, END = (mix(np.array([x], U64))[0] >> _CUT for x in (11, 13))
#: N-grams that a task gathers before it sends them, text bytes of a scoring batch, and text bytes per bucket.
FLUSH, BATCH_BYTES, BUCKET_BYTES = 1_000_000, 6 << 20, 16 << 20
#: Turns in which an order's n-grams are added up.
PASSES = 3
#: Contexts of a block, whose first n-gram's place is kept.
_BLOCK = 4


# ---------------------------------------------------------------- packing
def _pack(x: np.ndarray) -> bytes:
    x = narrow(x)
    return bytes([x.itemsize]) + x.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _pack_words(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack_words(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


# ---------------------------------------------------------------- n-grams
def token_columns(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """n columns of word hashes (oldest context word first, the token last) and where each document's tokens begin."""
    words, at = hash_words(raw, offsets)
    docs = len(offsets) - 1
    begins = at + np.arange(docs + 1)
    tokens = np.full(begins[-1], END, U64)
    tokens[np.arange(len(words)) + np.repeat(np.arange(docs), np.diff(at))] = words >> _CUT
    place = np.arange(len(tokens)) - np.repeat(begins[:-1], np.diff(begins))
    columns = []
    for back in range(n - 1, 0, -1):
        c = np.full(len(tokens), START, U64)
        c[back:] = tokens[: max(0, len(tokens) - back)]
        c[place < back] = START
        columns.append(c)
    return [*columns, tokens], begins


def bucket_of(columns: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and context's hash of each n-gram."""
    word = columns[-1]
    if len(columns) == 1:
        return (word >> U64(48 - bits)).astype(np.int64), np.zeros(len(word), U64)
    last = columns[-2]
    with np.errstate(over="ignore"):
        context = mix(columns[0] ^ U64(0xD6E8FEB86659FD93))
        for c in columns[1:-1]:
            context = mix(context * U64(0x9FB21C651E98DF25) + c)
    if len(columns) == 2:
        return (last >> U64(48 - bits)).astype(np.int64), context
    low = bits // 2
    return ((last >> U64(48 - bits + low)) << U64(low) | context >> U64(64 - low)).astype(np.int64), context


_BLOB = "kind tinyint, bucket int, context binary, runs binary, word binary, a binary"
_FIELDS = [pa.field("kind", pa.int8()), pa.field("bucket", pa.int32())] + [pa.field(x, pa.binary()) for x in ("context", "runs", "word", "a")]


def _blobs(columns: list[np.ndarray], a: np.ndarray | None, bits: int, kind: int) -> list[tuple]:
    """Adds equal n-grams up (a: their counts, else 1 each) and packs them by bucket."""
    bucket, context = bucket_of(columns, bits)
    word = columns[-1]
    order = np.argsort(bucket.astype(U64) << U64(64 - bits) | (context >> U64(24 + bits) << U64(24) | word >> U64(24) if len(columns) > 1 else word << U64(16 - bits) if bits < 16 else word >> U64(bits - 16)))
    columns, context, bucket = [c[order] for c in columns], context[order], bucket[order]
    word = columns[-1]
    new = np.ones(len(word), bool)
    new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1]) | (bucket[1:] != bucket[:-1])
    starts = np.flatnonzero(new)
    a = np.diff(np.append(starts, len(new))) if a is None else np.add.reduceat(a[order], starts)
    columns, context, bucket = [c[starts] for c in columns], context[starts], bucket[starts]
    cut, out = np.searchsorted(bucket, np.arange((1 << bits) + 1)), []
    for b in np.flatnonzero(np.diff(cut)).tolist():
        i, j = cut[b], cut[b + 1]
        own = context[i:j]
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        contexts = b"".join(_pack_words(c[i:j][heads]) for c in columns[:-1])
        out.append((kind, b, contexts, _pack(np.diff(np.append(heads, j - i))), _pack_words(columns[-1][i:j]), _pack(a[i:j])))
    return out


def _count(n: int, bits: int, turn: int):
    """Texts to blobs of n-grams of a turn's buckets; at the first turn of plain words (kind 0), too."""
    schema = pa.schema(_FIELDS)

    def pack(parts: list[list[np.ndarray]], kind: int) -> pa.RecordBatch:
        rows = _blobs([np.concatenate(x) for x in zip(*parts, strict=True)], None, bits, kind)
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {0: [], n: []}
        for batch in batches:
            raw, offsets = utf8_parts(batch.column(0))
            for i, j in chunks(offsets):
                columns, _ = token_columns(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                if turn == 0:
                    parts[0].append(columns[-1:])
                if n > 1:
                    mine = bucket_of(columns, bits)[0] % PASSES == turn
                    parts[n].append([c[mine] for c in columns])
                for kind, held in parts.items():
                    if sum(len(x[0]) for x in held) >= FLUSH:
                        yield pack(held, kind)
        for kind, held in parts.items():
            if sum(len(x[0]) for x in held):
                yield pack(held, kind)
        release_memory()

    return run


_HEADS = ("grams", "total", "t1", "t2", "t3", "t4")
_REDUCED = f"turn int, {', '.join(f'{x} bigint' for x in _HEADS)}, {_BLOB}"
_NAMES = [x.split(" ")[0] for x in _REDUCED.split(", ")]


def _reduce(bits: int, folder: str):
    """Adds a bucket's n-grams up, writes its segment, and passes continuations on. kind: words of an n-gram, 0 for plain words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0])
        width = max(1, kind) - 1
        columns: list[list[np.ndarray]] = [[] for _ in range(width)]
        word, a = np.concatenate([_unpack_words(x) for x in pdf["word"]]), np.concatenate([_unpack(x) for x in pdf["a"]])
        rest: list[tuple] = []
        if not width:
            keys, back = np.unique(word, return_inverse=True)
            a = np.bincount(back, a, len(keys)).astype(np.int64)
            arrays = [keys, narrow(a)]
        else:
            for contexts, runs in zip(pdf["context"], pdf["runs"], strict=True):
                n = _unpack(runs)
                for c, x in zip(columns, _unpack_words(contexts).reshape(width, -1), strict=True):
                    c.append(np.repeat(x, n))
            grams = [np.concatenate(c) for c in columns] + [word]
            columns = []
            context = bucket_of(grams, bits)[1]
            order = np.argsort(context, kind="stable")  # made of sorted runs
            context = context[order]
            number = np.cumsum(np.concatenate(([False], context[1:] != context[:-1]))).astype(U64)
            key = number << U64(32) | word[order] >> U64(16)
            again = np.argsort(key, kind="stable")
            key, order = key[again], order[again]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            a, key, first = np.add.reduceat(a[order], starts), key[starts], order[starts]
            heads = np.flatnonzero(np.concatenate(([True], key[1:] >> U64(32) != key[:-1] >> U64(32))))
            types = np.diff(np.append(heads, len(key)))
            facts = [types, np.add.reduceat(a, heads), *(np.add.reduceat(hit, heads, dtype=np.int64) for hit in (a == 1, a == 2, a >= 3))]
            own = context[np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))]
            code, table = coded(facts)
            count, counts = coded([a])
            arrays = [(own >> U64(32)).astype(np.uint32), (own >> U64(24) & U64(255)).astype(np.uint8), code, table, narrow(heads[::_BLOCK]), (key & U64(0xFFFFFFFF)).astype(np.uint32), count, counts]
            rest = _blobs([c[first] for c in grams[1:]], np.ones(len(a), np.int64), bits, width)
        write_segment(f"{folder}/{kind}", bucket, arrays)
        head = (-1, len(a), int(a.sum()), *(int((a == t).sum()) for t in (1, 2, 3, 4)), kind, bucket, None, None, None, None)
        return pd.DataFrame([head, *((x[1] % PASSES, *(None,) * len(_HEADS), *x) for x in rest)], columns=_NAMES)

    return run


# ---------------------------------------------------------------- the model
def discounts(t: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; where counts of counts don't give them, 1/2, 1 and 3/2."""
    if min(t) <= 0:
        return 0.5, 1.0, 1.5
    y = t[0] / (t[0] + 2 * t[1])
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * t[k] / t[k - 1])) for k in (1, 2, 3))


@dataclass
class Level:
    """One order of the model: its discounts, number of n-grams, sum of counts, and n-grams with counts 1, 2 and 3 or more."""

    discount: tuple[float, float, float]
    size: int
    mass: int
    once: tuple[int, int, int]


@dataclass
class KneserNey:
    """What workers need to find and read the model; levels from single words up, tokens and words of the training texts."""

    folder: str
    bits: int
    levels: list[Level]
    tokens: int
    words: int

    @property
    def order(self) -> int:
        return len(self.levels)


def _added_up(spark: SparkSession, blobs: DataFrame, bits: int, folder: str, path: str) -> dict[int, list[int]]:
    """Reduces blobs, writes what goes on under path by turn, and gives the sums of each kind's heads."""
    blobs.groupBy("kind", "bucket").applyInPandas(_reduce(bits, folder), _REDUCED).write.partitionBy("turn").parquet(path)
    heads = spark.read.schema(_REDUCED).parquet(path).where("turn = -1").groupBy("kind").agg(*(F.sum(x).alias(x) for x in _HEADS)).collect()
    delete_path(spark, f"{path}/turn=-1")
    release_shuffles(spark)
    return {r["kind"]: [r[x] for x in _HEADS] for r in heads}


def train(texts: DataFrame, *, order: int = 2) -> KneserNey:
    """Counts texts (a column `text`) and writes the model."""
    spark = texts.sparkSession
    size = texts.select(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = max(3, (size // BUCKET_BYTES).bit_length())
    folder, sums = scratch_path(spark, "lm"), {}
    turns = 0
    for k in range(order, 0, -1):
        above, done = f"{folder}/sent-{k + 1}", turns
        turns = PASSES if k > 1 else 1  # single words are few
        for turn in range(turns):
            if k == order:
                blobs = texts.select("text").mapInArrow(_count(order, bits, turn), _BLOB)
            else:
                sent = spark.read.schema(f"{_REDUCED}, pass int").parquet(above)
                blobs = (sent.where(f"turn = {turn}") if k > 1 else sent).select(*(f.name for f in _FIELDS))
            for kind, own in _added_up(spark, blobs, bits, f"{folder}/model", f"{folder}/sent-{k}/pass={turn}").items():
                sums[kind] = [x + y for x, y in zip(sums.get(kind, [0] * len(own)), own, strict=True)]
            for earlier in range(done):
                delete_path(spark, f"{above}/pass={earlier}/turn={turn}")
        delete_path(spark, above)
    delete_path(spark, f"{folder}/sent-1")
    none = [0] * len(_HEADS)
    plain = sums.get(0, none)
    levels = []
    for k in range(1, order + 1):
        grams, total, *t = plain if order == 1 else sums.get(k, none)
        levels.append(Level(discounts(t), grams, total, (t[0], t[1], grams - t[0] - t[1])))
    return KneserNey(f"{folder}/model", bits, levels, plain[1], plain[0])


class _Maps:
    """Mapped segments of a model in this worker."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.open = {kind: Segments(f"{model.folder}/{kind}") for kind in range(model.order + 1)}

    def segment(self, kind: int, bucket: int) -> list[np.ndarray] | None:
        return self.open[kind][bucket]

    def _runs(self, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Buckets, ascending, and where their entries are."""
        order = np.argsort(bucket.astype(np.int16) if self.model.bits < 15 else bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        for own in np.split(order, cut) if len(order) else ():
            yield int(bucket[own[0]]), own

    def words(self, kind: int, word: np.ndarray) -> np.ndarray:
        """Counts of single words; 0 where one is missing."""
        out = np.zeros(len(word), np.int64)
        for b, own in self._runs(bucket_of([word], self.model.bits)[0]):
            if (arrays := self.segment(kind, b)) is not None:
                at, hit = _found(arrays[0], word[own])
                out[own[hit]] = arrays[1][at[hit]]
        return out

    def grams(self, columns: list[np.ndarray], discount: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of each n-gram, its context's count (1 where it is missing), and the share that discounts free there (1 where it is missing)."""
        bucket, context = bucket_of(columns, self.model.bits)
        count, whole, free = np.zeros(len(context), np.int64), np.ones(len(context), np.int64), np.ones(len(context))
        word = (columns[-1] >> U64(16)).astype(np.uint32)
        for b, own in self._runs(bucket):
            arrays = self.segment(len(columns), b)
            if arrays is None:
                continue
            high, low, code, table, blocks, words, counted, counts = arrays
            key, back = np.unique(context[own], return_inverse=True)
            at, hit = _found(high, (key >> U64(32)).astype(np.uint32), low, (key >> U64(24) & U64(255)).astype(np.uint8))
            at = at[hit]
            types, size, *n = table.reshape(-1, 5).T.astype(np.int64)
            mine = code[at]
            one_whole, one_free = np.ones(len(key), np.int64), np.ones(len(key))
            one_whole[hit] = size[mine]
            one_free[hit] = (sum(d * x for d, x in zip(discount, n, strict=True)) / size)[mine]
            whole[own], free[own] = one_whole[back], one_free[back]
            # the first n-gram of a context: the block's, and what the contexts before it in the block have
            begin, end = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            first = blocks[at // _BLOCK].astype(np.int64)
            for k in range(1, _BLOCK):
                before = np.flatnonzero(at % _BLOCK >= k)
                first[before] += types[code[at[before] - k]]
            begin[hit], end[hit] = first, first + types[mine]
            # each pair of a context and a word once, in order
            pair, back = np.unique(back.astype(U64) << U64(32) | word[own], return_inverse=True)
            place = (pair >> U64(32)).astype(np.int64)
            left, right, last, wanted = begin[place], end[place], end[place], pair.astype(np.uint32)
            busy = np.flatnonzero(left < right)
            while len(busy):
                middle = left[busy] + right[busy] >> 1
                less = words[middle] < wanted[busy]
                left[busy] = np.where(less, middle + 1, left[busy])
                right[busy] = np.where(less, right[busy], middle)
                busy = busy[left[busy] < right[busy]]
            found = np.flatnonzero(left < last)
            found = found[words[left[found]] == wanted[found]]
            known = np.zeros(len(pair), np.int64)
            known[found] = counts[counted[left[found]]]
            count[own] = known[back]
        return count, whole, free


def _found(high: np.ndarray, key: np.ndarray, low: np.ndarray | None = None, key_low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in a sorted array, and which are there; low: further bits, in order among equal ones."""
    at = np.searchsorted(high, key)
    at[at == len(high)] = len(high) - 1
    hit = high[at] == key
    if low is not None:
        open_ = np.flatnonzero(hit)
        hit[open_] = False
        while len(open_):
            same = low[at[open_]] == key_low[open_]
            hit[open_[same]] = True
            open_ = open_[~same]
            open_ = open_[at[open_] + 1 < len(high)]
            at[open_] += 1
            open_ = open_[high[at[open_]] == key[open_]]
    return at, hit


def _discounted(a: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(a - np.array([0.0, *d])[np.minimum(a, 3)], 0.0)


def token_scores(maps: _Maps, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token after its context, and each token's plain count."""
    model = maps.model
    low = model.levels[0]
    word, back = np.unique(columns[-1], return_inverse=True)
    raw = maps.words(0, word)
    a = maps.words(1, word) if model.order > 1 else raw
    free = sum(d * n for d, n in zip(low.discount, low.once, strict=True))
    p = ((_discounted(a, low.discount) + free / (low.size + 1)) / low.mass if low.mass else np.ones(len(word)))[back]
    for k in range(2, model.order + 1):
        d = model.levels[k - 1].discount
        count, whole, free = maps.grams(columns[-k:], d)
        p = _discounted(count, d) / whole + free * p
    return p, raw[back]


def in_training(id_column: Column, fold: int = 2, folds: int = 7) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds != fold, F.lit(False))


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_workers_maps: list = [None, None]


def score_documents(docs: DataFrame, model: KneserNey, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, token counts, the unigram base score and the model's log10 probability of every row's text."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _workers_maps[0] != model.folder:
            _workers_maps[:] = [model.folder, _Maps(model)]
        maps = _workers_maps[1]
        n, v = model.tokens, model.words
        for batch in batches:
            raw, offsets = utf8_parts(batch.column(2))
            known, base, score, sizes = [], [], [], []
            for i, j in chunks(offsets, BATCH_BYTES):
                columns, begins = token_columns(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.order)
                p, count = token_scores(maps, columns)
                starts = begins[:-1]
                score.append(np.add.reduceat(np.log10(p), starts))
                base.append(np.add.reduceat(np.log10((count + 1) / (n + v + 1)), starts))
                known.append(np.add.reduceat((count > 0).astype(np.int64), starts))
                sizes.append(np.diff(begins))
            if sizes:
                size = np.concatenate(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(np.concatenate(known)), pa.array(np.full(len(size), n)), pa.array(np.concatenate(base)), pa.array(np.concatenate(score))], schema=_SCORED)
        release_memory()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~in_training(F.col(id_col))).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def train_and_score(docs: DataFrame, *, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows outside the holdout and scores all rows."""
    texts = docs.where(in_training(F.col(id_col))).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    limit_batches(docs.sparkSession)
    return score_documents(docs, train(texts, order=order), id_col=id_col, text_col=text_col)
