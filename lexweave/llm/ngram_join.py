"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of word shingles. With
percent = p that is the same as |A xor B| <= (100 - p) * (|A| + |B|) / (100 + p), which bounds the
differences of any pair whose larger set lies in a size band by a number D.

1. Copies. Documents with equal sets (128 bits of hash) are one: the smallest id stands for them from here on.
2. Bands. Band l holds larger-set sizes in (S[l-1], S[l]]. The hash space of shingles is cut into
   K > D slices; with at most D differences some slice of the pair has none, so both documents have the
   same shingles there. Each document therefore writes one digest per slice, for each band that a link
   partner can put the pair in. A slice with fewer than two shingles is weak evidence: K leaves room for such
   thin slices, and the documents with more thin slices than the room write digests for those as well. A pair
   has more equal slices than one of the two has thin ones, or else both write all; so no link is lost,
   whatever the sizes.
3. Centres. Digests travel as sorted blobs, one per (task, bucket); each task first joins its own equal digests
   into stars around their smallest document, so a digest that a third of all rows carries reaches its
   bucket once per task, not once per row. The smallest document with a digest is its centre, and the documents
   that share any digest with the same centre belong together: a linked pair has a digest in common, so some
   centre has both.
4. Tiles. A centre's documents are one tile, or as many tiles by size band and hash as keep each small; tiles of
   bands in reach of each other meet. Members bring their sorted shingles. Bit counts of hashed bitmaps bound
   each pair's overlap from above, and what they leave is intersected exactly, unless links found already join
   the two. So a tile, or a pair of tiles, gives fewer links than it has members, and what links is joined.
   Pairs are compared inside tiles only, never written. A centre with m documents costs m^2 / 2 bit counts at
   most (band against band where it has several tiles), and each of its documents goes to m / TILE_DOCS tiles.

Result: one row per input row: id, n_shingles, component_id (smallest id that links reach). Null and
empty texts have no shingles and link with nothing. Rows with a null id get component_id null. Repeated
ids are one node: they share what any of their rows links with. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CHUNK_BYTES, U64, chunks, components, discard, hash_words, limited_batches, materialize, mix, release_memory, release_shuffles, utf8_parts

#: Each band is this much wider than the one below it; shingles below which a slice is thin.
BAND_RATIO, THICK = 1.3, 2
#: Least bits of a tile's bitmaps, and bits per shingle of its largest set; always a power of two.
BITMAP_BITS, BITS_PER_SHINGLE = 256, 4
#: Documents and shingles of a tile, its size bands per factor e, and pairs that are intersected in one go.
TILE_DOCS, TILE_SHINGLES, BANDS_PER_E, EXACT_AT_ONCE = 2048, 1_000_000, 4, 16
#: Digests that a task gathers before it writes its blobs, and text bytes per bucket.
FLUSH, BUCKET_BYTES = 750_000, 4 << 20


def most_differences(total: int, percent: int) -> int:
    """Largest |A xor B| of a link whose sizes add up to total."""
    return (100 - percent) * total // (100 + percent)


class Bands:
    """The size bands and their number of slices for a threshold."""

    def __init__(self, percent: int, ratio: float = BAND_RATIO):
        self.percent, self.tops, self.slices = percent, [1], [1]
        while self.tops[-1] < 1 << 36:
            top = max(self.tops[-1] + 1, int(self.tops[-1] * ratio))
            self.tops.append(top)
            least = max(1, math.ceil((self.tops[-2] + 1) * percent / 100))
            d = most_differences(2 * top, percent)
            k = d + 1
            while k <= 1.35 * d + 2 and not all(self._roomy(k, x, top) for x in (least, top)):
                k += max(1, k // 100)
            self.slices.append(k)
        self._tops = np.array(self.tops)

    def room(self, band: int, size: int) -> int:
        """Slices that surely are equal in a link of this band with a document of this size."""
        return self.slices[band] - most_differences(size + self.tops[band], self.percent)

    def _roomy(self, k: int, size: int, top: int) -> bool:
        """Whether a document of this size seldom has as many thin slices as there is room."""
        thin = k * math.exp(-size / k) * (1 + size / k)
        return k - most_differences(size + top, self.percent) > thin + 2 * math.sqrt(thin)

    def of(self, size: int) -> range:
        """Bands in which a link with a document of this size can lie: by its own size as the larger, to the largest partner's."""
        return range(int(np.searchsorted(self._tops, size)), int(np.searchsorted(self._tops, size * 100 // self.percent)) + 1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; the whole sequence is one shingle if it has fewer than n words."""
    words, at = hash_words(raw, offsets)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - n + 1), U64)
        for k in range(n):
            rolled = mix(rolled * U64(0x9FB21C651E98DF25) + words[k : k + len(rolled)])
        out = []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if j - i >= n:
                x = np.sort(rolled[i : j - n + 1])
                if len(x) > 1:
                    x = x[np.concatenate(([True], x[1:] != x[:-1]))]
                out.append(x)
            elif j > i:
                h = np.full(1, j - i, U64)
                for k in range(i, j):
                    h = mix(h * U64(0x9FB21C651E98DF25) + words[k])
                out.append(h)
            else:
                out.append(np.zeros(0, U64))
    return out


def digests(x: np.ndarray, bands: Bands) -> np.ndarray:
    """One 64-bit digest per slice and band, of the shingles in that slice."""
    out = []
    with np.errstate(over="ignore"):
        total = np.zeros(len(x) + 1, U64)
        np.cumsum(mix(x ^ U64(0xD6E8FEB86659FD93)), out=total[1:])
        high = x >> U64(32)
        for band in bands.of(len(x)):
            k = bands.slices[band]
            cuts = np.searchsorted(high, (np.arange(1, k, dtype=U64) * U64(1 << 32) + U64(k - 1)) // U64(k))
            cuts = np.concatenate(([0], cuts, [len(x)]))
            full = np.diff(cuts) >= THICK
            sums = total[cuts[1:]] - total[cuts[:-1]]
            name = U64(band) * U64(0xA24BAED4963EE407) + np.arange(k, dtype=U64) * U64(0x9FB21C651E98DF25)
            own = mix(sums + mix(name))
            out.append(own if k - int(full.sum()) >= bands.room(band, len(x)) else own[full])
    return np.concatenate(out)


def set_name(x: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    with np.errstate(over="ignore"):
        return int(mix(x ^ U64(0xC2B2AE3D27D4EB4F)).sum()), int(mix(x ^ U64(0x165667B19E3779F9)).sum() + U64(len(x)))


def _star(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of (key, doc) sorted by both: the first row of each key, and (key, doc, first doc) of the rest."""
    head = np.concatenate(([True], key[1:] != key[:-1]))
    first = doc[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
    tail = ~head & (doc != first)
    return key[head], doc[head], key[tail], doc[tail], first[tail]


def _sorted(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((doc, key))
    return key[order], doc[order]


_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_DDL = "bucket int, kind tinyint, a binary, b binary, c binary"
#: Rows of arrays: documents (known, id, size and set's name), a task's own star edges (key, id, centre), digests of a
#: bucket (upper and lower key bytes, id), and the bucket's star edges.
DOCS, TASK_EDGES, DIGESTS, FAR_DIGESTS, EDGES = range(5)


def _row(bucket: int, kind: int, *arrays: np.ndarray) -> tuple:
    return bucket, kind, *(x.tobytes() for x in arrays)


def _emit(percent: int, n: int, buckets: int):
    """Documents to rows of arrays, each meant for a bucket. Of the equal sets of a run only the first writes digests.

    Digests keep 48 bits besides the bucket's: two that meet by chance bring two more documents to one tile, no link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, keys, docs, held, turn, seen = Bands(percent), [], [], 0, TaskContext.get().partitionId(), {}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)

        def flush() -> list[tuple]:
            key, doc = _sorted(np.concatenate(keys), np.concatenate(docs))
            key, doc, own, left, right = _star(key, doc)
            place = ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)  # keys are sorted, so buckets are runs
            cut = np.searchsorted(place, np.arange(buckets + 1))
            rows = [_row(turn % buckets, TASK_EDGES, own, left, right)] if len(own) else []
            for b in np.flatnonzero(np.diff(cut)).tolist():
                k, d = key[cut[b] : cut[b + 1]], doc[cut[b] : cut[b + 1]]
                low, near = d.min(), int(d.max()) - int(d.min()) < 1 << 32
                ids = np.concatenate((np.array([low], np.int64).view(np.uint32), (d - low).astype(np.uint32))) if near else d  # offsets from the least id, where they fit
                rows.append(_row(b, DIGESTS if near else FAR_DIGESTS, (k >> U64(32)).astype(np.uint32), (k >> U64(16)).astype(np.uint16), ids))
            return rows

        for batch in batches:
            ids, (raw, offsets) = batch.column(0), utf8_parts(batch.column(1))
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy().astype(np.int64)
            sizes, names = np.zeros(len(ids), np.int64), np.zeros((2, len(ids)), U64)
            for i, j in chunks(offsets):
                for k, x in enumerate(shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n), i):
                    sizes[k] = len(x)
                    if not len(x) or not known[k]:
                        continue
                    names[:, k] = name = set_name(x)
                    # copies of a set are one document; several texts of an id each write their own digests
                    if seen.setdefault(name, number[k]) == number[k]:
                        keys.append(digests(x, bands) & ~U64(0xFFFF))
                        docs.append(np.full(len(keys[-1]), number[k], np.int64))
                        held += len(keys[-1])
            turn += 1
            rows = [_row(turn % buckets, DOCS, known, number, np.concatenate((sizes.view(U64), *names)))] if len(ids) else []
            if held >= FLUSH:
                rows += flush()
                keys, docs, held, seen = [], [], 0, {}
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of(flush())
        release_memory()

    return run


_GATHERED = "kind tinyint, key bigint, id bigint, other bigint, n bigint"


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's documents (key and other: the set's name), task-wide star edges as they are, and the star edges among its digests."""
    keys, docs, out = [], [], []
    for kind, a, b, c in zip(pdf["kind"], pdf["a"], pdf["b"], pdf["c"], strict=True):
        if kind == DOCS:
            n, one, two = np.frombuffer(c, np.int64).reshape(3, -1)
            out.append(pd.DataFrame({"kind": DOCS, "key": one, "id": pd.array(np.frombuffer(b, np.int64), "Int64"), "other": two, "n": n}))
            out[-1].loc[~np.frombuffer(a, bool), "id"] = pd.NA
        elif kind == TASK_EDGES:
            out.append(pd.DataFrame({"kind": TASK_EDGES, "key": np.frombuffer(a, np.int64), "id": np.frombuffer(b, np.int64), "other": np.frombuffer(c, np.int64)}))
        else:
            high, low = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint16)
            keys.append(high.astype(U64) << U64(32) | low.astype(U64) << U64(16))
            docs.append(np.frombuffer(c, np.int64) if kind == FAR_DIGESTS else np.frombuffer(c[8:], np.uint32).astype(np.int64) + np.frombuffer(c[:8], np.int64)[0])
    if keys:
        _, _, own, left, right = _star(*_sorted(np.concatenate(keys), np.concatenate(docs)))
        out.append(pd.DataFrame({"kind": EDGES, "key": own.view(np.int64), "id": left, "other": right}))
    full = pd.concat([x.astype({c: "Int64" for c in x.columns}) for x in out]) if out else pd.DataFrame({"kind": []})
    return full.reindex(columns=["kind", "key", "id", "other", "n"])


# ---------------------------------------------------------------- tiles
_TILE = ["centre", "band_a", "part_a", "band_b", "part_b"]
_TILE_DDL = "centre bigint, band_a int, part_a int, band_b int, part_b int"
_TILE_TYPE = pa.struct([("centre", pa.int64()), ("band_a", pa.int32()), ("part_a", pa.int32()), ("band_b", pa.int32()), ("part_b", pa.int32()), ("second", pa.bool_())])
_MEMBER = pa.schema([("tile", _TILE_TYPE), ("id", pa.int64()), ("shingles", pa.binary())])


def _members(n: int):
    """(id, text, tiles) to a row per tile with the id and the sorted shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tiles = batch.column(0).to_numpy(), batch.column(2)
            raw, offsets = utf8_parts(batch.column(1))
            for i, j in chunks(offsets):
                at, own, sets, held = [], [], [], 0

                def rows() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(at, _TILE_TYPE), pa.array(own, pa.int64()), pa.array(sets, pa.binary())], schema=_MEMBER)

                for k, x in enumerate(shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n), i):
                    if not len(x):  # a text without words of an id that has others
                        continue
                    data = x.tobytes()
                    for tile in tiles[k].as_py():
                        at.append(tile)
                        own.append(ids[k])
                        sets.append(data)
                        held += len(data) + 64
                        if held > 4 * CHUNK_BYTES:
                            yield rows()
                            at, own, sets, held = [], [], [], 0
                if at:
                    yield rows()
        release_memory()

    return run


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of 64-bit words for each set; an element sets the bit of its lowest bits."""
    grid = np.zeros((len(sets), bits), np.uint8)
    grid[np.repeat(np.arange(len(sets)), [len(x) for x in sets]), (np.concatenate(sets) & U64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(grid, axis=1).view(U64)


def overlap_bound(size_a, size_b, map_a: np.ndarray, map_b: np.ndarray):
    """Most elements that two sets can share. A bit set in one map alone stands for an element that the other set lacks."""
    only_a = np.bitwise_count(map_a & ~map_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(map_b & ~map_a).sum(axis=-1, dtype=np.int64)
    return np.minimum(size_a - only_a, size_b - only_b)


def meets(shared, size_a, size_b, percent: int):
    return 100 * shared >= percent * (size_a + size_b - shared)


def shared_counts(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted array with other sorted arrays, of distinct values, none empty."""
    row = np.concatenate(others)
    at = np.searchsorted(a, row)
    at[at == len(a)] = 0
    return np.add.reduceat((a[at] == row).astype(np.int64), np.cumsum([0] + [len(x) for x in others[:-1]]))


def tile_links(ids: np.ndarray, sets: list[np.ndarray], second: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that join the members of a tile, or of two tiles with each other (second: in which), as far as they link.

    Members are taken by ascending size. Bit counts bound the overlap of each with those below it in size; what they
    leave is intersected exactly, the greatest bounds first, unless links found already join the two. So there
    are fewer links than members, and all that link are joined by them.
    """
    order = np.lexsort((ids, [len(x) for x in sets]))
    ids, sets = ids[order], [sets[k] for k in order.tolist()]
    size = np.array([len(x) for x in sets], np.int64)
    maps = bitmaps(sets, max(BITMAP_BITS, 1 << (BITS_PER_SHINGLE * int(size[-1]) - 1).bit_length()))
    _, root = np.unique(ids, return_inverse=True)  # several texts of an id are one document
    low, out = np.searchsorted(size, -(-size * percent // 100)), []
    if second is not None:
        second = second[order]
    for k in range(1, len(ids)):
        at = np.arange(low[k], k)
        at = at[root[at] != root[k]] if second is None else at[(second[at] != second[k]) & (root[at] != root[k])]
        if not len(at):
            continue
        bound = overlap_bound(size[at], size[k], maps[at], maps[k])
        fit = meets(bound, size[at], size[k], percent)
        at = at[fit][np.argsort(-bound[fit], kind="stable")]
        while len(at):
            some, at = at[:EXACT_AT_ONCE], at[EXACT_AT_ONCE:]
            for j in some[meets(shared_counts(sets[k], [sets[j] for j in some.tolist()]), size[some], size[k], percent)].tolist():
                if root[j] != root[k]:
                    out.append((int(max(ids[j], ids[k])), int(min(ids[j], ids[k]))))
                    root[root == root[j]] = root[k]
            at = at[root[at] != root[k]]
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tile(percent: int):
    def run(table: pa.Table) -> pa.Table:
        tile = table.column("tile").combine_chunks()
        second = tile.field("second").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_buffer(), U64) for x in table.column("shingles").combine_chunks()]
        found = tile_links(table.column("id").to_numpy(), sets, second if second.any() else None, percent)
        return pa.table([[x[0] for x in found], [x[1] for x in found]], schema=_LINKS)

    return run


def _homes(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """pairs(id, centre), sizes(id, n) to (id, tiles): the tiles to which each document brings its shingles.

    A centre's documents are one tile as long as they are TILE_DOCS with TILE_SHINGLES shingles at most. Others are
    dealt by size band and hash to as many tiles as it takes; each meets itself and the tiles of bands in reach.
    """
    rows = pairs.union(pairs.select(F.col("centre").alias("id"), "centre").distinct()).join(sizes, "id").select("id", "centre", "n", F.floor(F.log("n") * BANDS_PER_E).cast("int").alias("band"))
    rows = materialize(rows, "ngram-rows")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / TILE_DOCS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("parts")
    large = materialize(rows.groupBy("centre").agg(parts).where("parts > 1").select("centre"), "ngram-large")  # read again, so that a hot centre's join can be split
    bands = materialize(rows.join(large, "centre", "left_semi").groupBy("centre", "band").agg(parts), "ngram-bands")
    none = F.lit(-1)
    whole = rows.join(large, "centre", "left_anti").select("id", F.struct("centre", none.alias("band_a"), none.alias("part_a"), none.alias("band_b"), none.alias("part_b"), F.lit(False).alias("second")).alias("tile"))
    reach = math.ceil(BANDS_PER_E * math.log(100 / percent) + 1e-6)
    a, b = (bands.select("centre", F.col("band").alias(f"band_{s}"), F.explode(F.expr("sequence(0, parts - 1)")).alias(f"part_{s}")) for s in "ab")
    meet = a.join(b, "centre").where(f"band_b BETWEEN band_a AND band_a + {reach} AND (band_a < band_b OR part_a <= part_b)")
    first = meet.select("centre", F.col("band_a").alias("band"), F.col("part_a").alias("part"), F.struct(*_TILE, F.lit(False).alias("second")).alias("tile"))
    second = meet.where("band_a < band_b OR part_a < part_b").select("centre", F.col("band_b").alias("band"), F.col("part_b").alias("part"), F.struct(*_TILE, F.lit(True).alias("second")).alias("tile"))
    dealt = rows.join(bands, ["centre", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    split = dealt.join(first.union(second), ["centre", "band", "part"]).select("id", "tile")
    return whole.union(split).groupBy("id").agg(F.collect_list("tile").alias("tiles"))


def ngram_components(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every row under word n-gram Jaccard >= percent / 100; see the module's text."""
    if not 1 <= percent <= 100 or n < 1:
        raise ValueError("percent must lie in 1..100 and n be positive")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with limited_batches(docs.sparkSession):  # what needs it has run when the result is returned
        return _joined(texts, n, percent).withColumnRenamed("id", id_col)


def _joined(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """id, n_shingles and component_id of texts(id, text)."""
    spark = texts.sparkSession
    total, size = texts.select(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // BUCKET_BYTES)
    raw = texts.mapInArrow(_emit(percent, n, buckets), _DDL)
    gathered = materialize(raw.groupBy("bucket").applyInPandas(lambda pdf: _gather(pdf), _GATHERED), "ngram-gathered")
    release_shuffles(spark)

    # equal sets: of the ids of one set the smallest stands for all, unless an id has several sets; that one is linked
    rows = materialize(gathered.where(F.col("kind") == DOCS).select("id", "n", F.col("key").alias("one"), F.col("other").alias("two")), "ngram-docs", total)
    known = rows.where("id IS NOT NULL AND n > 0")
    copied = materialize(known.groupBy("one", "two").agg(F.min("id").alias("of"), F.max("id").alias("last")).where("of < last"), "ngram-copied", total)  # read again, so that a hot name's join can be split
    alias = known.join(copied, ["one", "two"]).where("id > of").select("id", "of").distinct()
    several = known.groupBy("id").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("one", "two"))).where("min_one < max_one OR min_two < max_two").select("id")
    alias = materialize(alias.join(several.withColumn("mixed", F.lit(True)), "id", "left").select("id", "of", F.coalesce("mixed", F.lit(False)).alias("mixed")), "ngram-copies", total)
    stands = alias.where("NOT mixed").select("id", "of")

    # the centre of a digest that a task has several times: the bucket's, if the task's own has another there
    stars = gathered.where(F.col("kind") == EDGES)
    own = gathered.where(F.col("kind") == TASK_EDGES).select("key", F.col("id").alias("from"), F.col("other").alias("id"))
    pairs = stars.select("id", F.col("other").alias("centre")).union(own.join(stars.select("key", "id", "other"), ["key", "id"], "left").select("from", F.coalesce("other", "id"))).distinct()
    pairs = pairs.join(stands, "id", "left").select(F.coalesce("of", "id").alias("id"), "centre")
    pairs = pairs.join(stands.withColumnsRenamed({"id": "centre", "of": "to"}), "centre", "left").select("id", F.coalesce("to", "centre").alias("centre"))
    pairs = materialize(pairs.where("id <> centre").distinct(), "ngram-pairs", gathered.where(F.col("kind") != DOCS).count())
    discard(gathered)
    homes = materialize(_homes(pairs, known.groupBy("id").agg(F.sum("n").alias("n")), percent), "ngram-homes", 2 * pairs.count())
    discard(pairs)
    release_shuffles(spark)

    members = texts.where("id IS NOT NULL").join(homes.hint("merge"), "id").select("id", "text", "tiles").mapInArrow(_members(n), f"tile struct<{_TILE_DDL.replace(' ', ':').replace(',:', ',')},second:boolean>, id bigint, shingles binary")
    found = members.groupBy(*(F.col(f"tile.{c}").alias(c) for c in _TILE)).applyInArrow(_tile(percent), "a bigint, b bigint")
    links = materialize(found.union(alias.where("mixed").select("id", "of")), "ngram-links")
    discard(homes, copied)
    release_shuffles(spark)
    roots = components(links, "ngram-roots")
    discard(links)
    release_shuffles(spark)
    named = rows.select("id", "n").join(stands, "id", "left").select("id", "n", F.coalesce("of", "id").alias("node"))
    return named.join(roots, "node", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("component_id"))
