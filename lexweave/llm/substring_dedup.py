"""Substring dedup by hashing every passage of min_words words, and every whole line.

A text is a row of words in lower case; a character of a script that is written without blanks is a word of
its own. Units are all passages of min_words words side by side, wherever they begin, and all whole lines.
Of equal units the earliest occurrence, by document id and then place, is kept; the words of every other
passage are removed, and of every other line that has MIN_LINE_WORDS words. So a repeated passage goes from
its first to its last word in any script, case or punctuation, whether it stands mid-line or across lines.
Rows keep the removed parts' offsets in the original text (in characters).

There are as many units as words, so they aren't sent whole. Tasks first send 32 bits of each unit's hash, dealt
by further bits, and buckets write those that occur twice. Of the units found there, tasks send the whole hash
with its earliest occurrence in the task; buckets write the earliest of all where there are several. Last, texts
are cut by looking their units up in these files, which the workers map. Tasks send each hash twice at most, and
what they send is packed by bucket, so a unit that a third of all documents have makes no hot task.

Cases: null and empty texts have no units and stay as they are. A document whose units all occur earlier
becomes empty. Rows with a null id stay as they are; repeated ids are one document, whose rows all keep a
unit that it keeps. Repeats inside a document are removed as well, from the second on; one that overlaps the
kept occurrence loses only what lies beyond it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segments import Segments, write_segment
from .shared import U64, chunks, delete_path, discard, hash_words, limit_batches, materialize, mix, power_tables, release_memory, release_shuffles, scratch_path, utf8_parts

MIN_WORDS = 25
#: Words of a whole line that is removed where it occurs again; shorter ones are too common by chance.
MIN_LINE_WORDS = 5
#: Units that a task gathers before it sends them, rows and text bytes of one round: two workers share an executor's memory.
FLUSH, ROUND_ROWS, ROUND_BYTES = 500_000, 500, 1 << 19
#: Text bytes per bucket.
BUCKET_BYTES = 16 << 20
#: Scripts without blanks between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, Bopomofo, ideographs.
UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3100-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
#: What becomes blank or gets blanks around it, so that words are what stands between ASCII white space.
_APART, _BLANKS = re.compile(rf"[{UNSPACED}]"), re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[0x1C:0x20] = 32


# ---------------------------------------------------------------- units of one text
def _layout(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Where words begin (the first word's part from 0 on, at the end the text's length), and the words [i, j) of lines that have any."""
    starts, lines, i = [m.start() for m in WORD.finditer(text)], [], 0
    for line in text.split("\n"):
        j = i + sum(1 for _ in WORD.finditer(line))
        if j > i:
            lines.append((i, j))
        i = j
    return [0, *starts[1:], len(text)], lines


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, str]]:
    """(start, end, normalised text) of the passages, then of the whole lines, whose text ends in a line feed; separators belong to the word before them."""
    words = WORD.findall(text.lower())
    at, lines = _layout(text)
    out = [(at[i], at[i + min_words], " ".join(words[i : i + min_words])) for i in range(len(words) - min_words + 1)]
    return out + [(at[i], at[j], " ".join(words[i:j]) + "\n") for i, j in lines]


def removed_spans(found: list[tuple[int, int, str]], marked: set[int], min_words: int) -> list[tuple[int, int]]:
    """What marked passages and lines with enough words cover, as (start, end)."""
    kept = {}
    for k, (_, end, unit) in enumerate(found):
        if k not in marked:
            kept.setdefault(unit, end)
    spans = []
    for k in marked:
        start, end, unit = found[k]
        if unit.count(" ") + 1 >= (MIN_LINE_WORDS if unit.endswith("\n") else min_words):
            spans.append((max(start, kept.get(unit, 0)), end))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# ---------------------------------------------------------------- units of many texts, as arrays
def _normal(text: str | None) -> str:
    text = (text or "").lower()
    return text if text.isascii() else _APART.sub(r" \g<0> ", _BLANKS.sub(" ", text))


class Units:
    """The units of a run of texts: keys, the text of each, its place there, and its words [first, first + size)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, min_words: int):
        raw, n = _SPACES[raw], len(offsets) - 1
        starts = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(raw == 10) + 1)))
        starts = starts[starts < len(raw)]
        words, at = hash_words(raw, np.append(starts, len(raw)))
        self.begins = at[np.searchsorted(starts, offsets)]  # of each text's words, and the end
        up, down = power_tables(len(words) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(words) + 1, U64)
            np.cumsum(words * up[: len(words)], out=total[1:])
            sizes = np.maximum(np.diff(self.begins) - min_words + 1, 0)
            self.passages = sizes
            doc = np.repeat(np.arange(n), sizes)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = self.begins[doc] + place
            line, line_end = at[:-1], at[1:]
            solid = line_end > line
            line, line_end = line[solid], line_end[solid]
            line_doc = np.searchsorted(self.begins, line, "right") - 1
            self.lines = np.bincount(line_doc, minlength=n)
            line_place = sizes[line_doc] + np.arange(len(line)) - (np.cumsum(self.lines) - self.lines)[line_doc]
            self.first = np.concatenate((first, line))
            self.end = np.concatenate((first + min_words, line_end))
            self.doc, self.place = np.concatenate((doc, line_doc)), np.concatenate((place, line_place))
            size = (self.end - self.first).astype(U64)
            size[len(first) :] |= U64(1 << 32)  # a line is no passage
            self.key = mix((total[self.end] - total[self.first]) * down[self.first] + mix(size))
            self.counts = np.concatenate((np.ones(len(first), bool), line_end - line >= MIN_LINE_WORDS))


def _runs(texts: pa.Array, min_words: int) -> Iterator[tuple[int, int, Units]]:
    for at in range(0, len(texts), ROUND_ROWS):
        raw, offsets = utf8_parts(pa.array([_normal(t) for t in texts.slice(at, ROUND_ROWS).to_pylist()], pa.large_string()))
        for i, j in chunks(offsets, ROUND_BYTES):
            yield at + i, at + j, Units(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_words)


def _by_bucket(bits: int, buckets: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Bucket and bytes of each array's part, for ascending buckets."""
    cut = np.searchsorted(buckets, np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield (b, *(x[cut[b] : cut[b + 1]].tobytes() for x in arrays))


def _short(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the next 32 bits."""
    return (key >> U64(64 - bits)).astype(np.int64), (key >> U64(32 - bits) & U64(0xFFFFFFFF)).astype(np.uint32)


def _heads(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


_KEYS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary())])
_FIRSTS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("places", pa.binary()), ("many", pa.binary())])


def _record(rows: Iterator[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _send_keys(bits: int, min_words: int):
    """Each unit's short hash; one that a task has more than once goes twice."""

    def pack(parts: list[np.ndarray]) -> pa.RecordBatch:
        short = np.sort(np.concatenate(parts) >> U64(32 - bits))
        keep = np.ones(len(short), bool)
        keep[2:] = short[2:] != short[:-2]
        short = short[keep]
        return _record(_by_bucket(bits, (short >> U64(32)).astype(np.int64), short.astype(np.uint32)), _KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, _, u in _runs(batch.column(1), min_words):
                parts.append(u.key[u.counts])
                held += len(parts[-1])
                if held >= FLUSH:
                    yield pack(parts)
                    parts, held = [], 0
        if held:
            yield pack(parts)
        release_memory()

    return run


def _write_repeated(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["keys"]]))
        twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
        bucket = int(pdf["bucket"].iloc[0])
        if len(twice):
            write_segment(folder, bucket, [twice])
        return pd.DataFrame([(bucket, len(twice))], columns=["bucket", "n"])

    return run


def find(segments: Segments, bits: int, buckets: np.ndarray, keys: np.ndarray, kinds: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which of the keys, ascending by bucket, are there, and what belongs to them (of these kinds)."""
    hits, out = np.zeros(len(keys), bool), [np.zeros(len(keys), kind) for kind in kinds]
    cut = np.searchsorted(buckets, np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        arrays = segments[b]
        if arrays is None:
            continue
        own = keys[cut[b] : cut[b + 1]]
        at = np.searchsorted(arrays[0], own)
        at[at == len(arrays[0])] = 0
        hits[cut[b] : cut[b + 1]] = arrays[0][at] == own
        for x, kind, values in zip(out, kinds, arrays[1:], strict=True):
            x[cut[b] : cut[b + 1]] = values[at].view(kind)
    return hits, out


def _send_firsts(repeated: Segments, bits: int, min_words: int):
    """Of each unit whose short hash occurs twice: the whole hash, its earliest occurrence in the task and whether there are several."""

    def pack(parts: list[tuple]) -> pa.RecordBatch:
        key, ids, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key)
        order = order[find(repeated, bits, *_short(key[order], bits), [])[0]]
        key, ids, place = key[order], ids[order], place[order]
        distinct, rank = np.unique(ids, return_inverse=True)
        when = rank.astype(np.int64) << 32 | place
        starts = _heads(key)
        many = np.diff(np.append(starts, len(key))) > 1
        key, when = key[starts], np.minimum.reduceat(when, starts) if len(starts) else when
        return _record(_by_bucket(bits, (key >> U64(64 - bits)).astype(np.int64), key, distinct[when >> 32], (when & 0xFFFFFFFF).astype(np.int32), many), _FIRSTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, u in _runs(batch.column(1), min_words):
                at = u.counts
                parts.append((u.key[at], ids[i + u.doc[at]], u.place[at]))
                held += len(parts[-1][0])
                if held >= FLUSH:
                    yield pack(parts)
                    parts, held = [], 0
        if held:
            yield pack(parts)
        release_memory()

    return run


def _write_firsts(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, ids, place, many = (np.concatenate([np.frombuffer(x, kind) for x in pdf[c]]) for c, kind in (("keys", U64), ("ids", np.int64), ("places", np.int32), ("many", bool)))
        order = np.lexsort((place, ids, key))
        key, ids, place, many = key[order], ids[order], place[order], many[order]
        starts = _heads(key)
        several = (np.diff(np.append(starts, len(key))) > 1) | np.logical_or.reduceat(many, starts)
        starts = starts[several]
        bucket = int(pdf["bucket"].iloc[0])
        if len(starts):
            write_segment(folder, bucket, [key[starts], ids[starts], place[starts]])
        return pd.DataFrame([(bucket, len(starts))], columns=["bucket", "n"])

    return run


def first_occurrences(docs: DataFrame, *, min_words: int, id_col: str, text_col: str) -> tuple[Segments, int]:
    """Units that occur several times, with id and place of the earliest occurrence, and the number of bits that tell their bucket."""
    spark = docs.sparkSession
    limit_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    size = rows.select(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = max(3, (size // BUCKET_BYTES).bit_length())
    folder, written = scratch_path(spark, "dedup"), "bucket int, n long"
    keys = rows.mapInArrow(_send_keys(bits, min_words), "bucket int, keys binary")
    discard(materialize(keys.groupBy("bucket").applyInPandas(_write_repeated(f"{folder}/repeated"), written), "dedup-repeated"))
    del keys
    release_shuffles(spark)
    firsts = rows.mapInArrow(_send_firsts(Segments(f"{folder}/repeated"), bits, min_words), "bucket int, keys binary, ids binary, places binary, many binary")
    discard(materialize(firsts.groupBy("bucket").applyInPandas(_write_firsts(f"{folder}/first"), written), "dedup-first"))
    delete_path(spark, f"{folder}/repeated")
    del firsts
    release_shuffles(spark)
    return Segments(f"{folder}/first"), bits


def _cut(min_words: int, first: Segments, bits: int):
    schema = pa.schema([("clean", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_units", pa.int64())])

    def cut(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        clean, spans, counts = texts.to_pylist(), [[] for _ in range(len(texts))], []
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for i, _, u in _runs(texts, min_words):
            counts.append(u.passages + u.lines)
            at = np.flatnonzero(u.counts & known[i + u.doc]) if len(u.doc) else np.zeros(0, np.int64)
            at = at[np.argsort(u.key[at])]
            key = u.key[at]
            hit, (first_id, first_place) = find(first, bits, (key >> U64(64 - bits)).astype(np.int64), key, [np.int64, np.int32])
            own = ids[i + u.doc[at]] == first_id
            hit &= ~(own & (u.place[at] == first_place))
            at, own, first_place = at[hit], own[hit], first_place[hit]
            begin, end, doc = u.first[at], u.end[at], u.doc[at]
            passage = own & (u.place[at] < u.passages[doc])  # lines don't overlap
            begin = np.where(passage, np.maximum(begin, u.begins[doc] + first_place + min_words), begin)
            solid = begin < end
            depth = np.zeros(u.begins[-1] + 1, np.int64)
            np.add.at(depth, begin[solid], 1)
            np.add.at(depth, end[solid], -1)
            gone = np.cumsum(depth) > 0
            for d in np.unique(doc[solid]).tolist():
                a, b = u.begins[d], u.begins[d + 1]
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:b], [False])))).tolist()
                text = clean[i + d]
                where, _ = _layout(text)
                cuts = [where[x] for x in edges]
                spans[i + d] = [{"start": x, "end": y} for x, y in zip(cuts[::2], cuts[1::2], strict=True)]
                rest = [0, *cuts, len(text)]
                clean[i + d] = "".join(text[x:y] for x, y in zip(rest[::2], rest[1::2], strict=True))
        return [pa.array(clean, schema[0].type), pa.array(spans, schema[1].type), pa.array(np.concatenate(counts) if counts else [], schema[2].type)]

    return schema, cut


def dedup_units(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as _row (a struct of its columns) with clean (the text that is left), spans and n_units."""
    first, bits = first_occurrences(docs, min_words=min_words, id_col=id_col, text_col=text_col)
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_key"), F.col(text_col).cast("string").alias("_text"))
    schema, cut = _cut(min_words, first, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *cut(batch.column(1), batch.column(2))], names=["_row", *schema.names])
        release_memory()

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    out = T.StructType([rows.select("_row").schema[0], T.StructField("clean", T.StringType()), T.StructField("spans", T.ArrayType(span)), T.StructField("n_units", T.LongType())])
    return rows.mapInArrow(run, out)


def dedup_report(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what is left), n_units, n_removed (spans), removed_chars and the spans in the original text."""
    out = dedup_units(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_words=min_words)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("_row.doc_id", F.col("clean").alias("text"), "n_units", F.size("spans").cast("long").alias("n_removed"), size.alias("removed_chars"), "spans")


def without_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with cut texts; the other columns as they were. A document of which nothing is left goes."""
    out = dedup_units(docs, min_words=min_words, id_col=id_col, text_col=text_col)
    kept = out.where((F.size("spans") == 0) | (F.trim("clean") != ""))
    return kept.select(*(F.col("clean").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns))
