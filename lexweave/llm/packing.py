"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids, with an end id after them, are cut into full windows and a rest. Rests are gathered
until they fill a bounded number of windows; the rest that crosses the line is cut there, its tail opens
the next group. A group is then partitioned by differencing: each rest starts as a partition with one
loaded window, and the two partitions with the largest spread merge with opposing imbalances, the fullest
window of one with the emptiest of the other, until one partition is left. Its windows are near equal.
If one exceeds the capacity, the number of windows rises by one and the group is partitioned anew.

A partition's last group needs no padded window for its surplus: what is over whole windows is cut into
power-of-two lengths, which stay unpadded.

Cases: a null or empty text is the end id alone; repeated rows are packed each on its own. A group is
local to its task, so there is no shuffle and memory is bounded by the group. Sequence ids carry the
task's number in their upper bits; the same input split gives the same ids again after a lost executor.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoded
from .shared import limit_batches, release_memory

WINDOW = 4096
#: Windows that a group of rests fills, and the tokens left free in each so that differencing can succeed at once.
GROUP, SLACK = 192, 16
END_ID = 2


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item, and the load of each window, by Karmarkar-Karp differencing."""
    if windows == 1:
        return np.zeros(len(sizes), np.int64), np.array([sum(sizes)])
    # a partition: loads in descending order less the least, and for each window the tree of its items
    order, heap = count(), []
    rank = np.arange(windows)
    for i, size in enumerate(sizes):
        loads = np.zeros(windows, np.int64)
        loads[0] = size
        heapq.heappush(heap, (-size, next(order), loads, [(i,)] + [()] * (windows - 1)))
    while len(heap) > 1:
        _, _, a, items_a = heapq.heappop(heap)
        _, _, b, items_b = heapq.heappop(heap)
        loads = a + b[::-1]
        at = np.argsort(-loads, kind="stable")
        joined = [(x, y) if x and y else x or y for x, y in zip(items_a, reversed(items_b), strict=True)]
        loads = loads[at]
        loads -= loads[-1]
        heapq.heappush(heap, (-int(loads[0]), next(order), loads, [joined[k] for k in at.tolist()]))
    home = np.zeros(len(sizes), np.int64)
    for w, tree in zip(rank.tolist(), heap[0][3] if heap else [], strict=False):
        stack = [tree]
        while stack:
            x = stack.pop()
            for y in x:
                if isinstance(y, tuple):
                    stack.append(y)
                else:
                    home[y] = w
    return home, np.bincount(home, weights=sizes, minlength=windows).astype(np.int64)


def balanced(sizes: list[int], capacity: int) -> np.ndarray:
    """Window of each item such that none exceeds the capacity; every size is at most the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        home, loads = differencing(sizes, windows)
        if loads.max(initial=0) <= capacity:
            return home
        windows += 1


class _Packer:
    """Pieces of one task: (row, start, length, sequence, offset)."""

    def __init__(self, window: int, base: int):
        self.window, self.next = window, base
        self.rests: list[tuple[int, int, int]] = []
        self.held = 0
        self.goal = GROUP * (window - min(SLACK, window // 64))

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, row: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
        full = length - length % self.window
        for start in range(0, full, self.window):
            yield row, start, self.window, self._sequence(), 0
        if full < length:
            rest = length - full
            if self.held + rest >= self.goal:
                head = self.goal - self.held
                self.rests.append((row, full, head))
                yield from self.pack()
                full, rest = full + head, rest - head
            if rest:
                self.rests.append((row, full, rest))
                self.held += rest

    def pack(self) -> Iterator[tuple[int, int, int, int, int]]:
        if not self.rests:
            return
        home = balanced([x[2] for x in self.rests], self.window)
        ids: dict[int, int] = {}
        used: dict[int, int] = {}
        for (row, start, length), w in zip(self.rests, home.tolist(), strict=True):
            if w not in ids:
                ids[w], used[w] = self._sequence(), 0
            yield row, start, length, ids[w], used[w]
            used[w] += length
        self.rests, self.held = [], 0

    def finish(self) -> Iterator[tuple[int, int, int, int, int]]:
        """The last rests: whole windows by differencing, what is over in power-of-two lengths without padding."""
        free = min(SLACK, self.window // 64)
        over = self.held - self.held // self.window * (self.window - free) if self.held >= self.window else self.held
        sizes = [1 << k for k in range(over.bit_length()) if over >> k & 1]
        while sizes:
            size, at = sizes.pop(), 0
            if size > self.window:
                sizes += [size // 2] * 2
                continue
            sequence = self._sequence()
            while at < size:
                row, start, length = self.rests.pop()
                take = min(length, size - at)
                if take < length:
                    self.rests.append((row, start, length - take))
                yield row, start + length - take, take, sequence, at
                at += take
        yield from self.pack()


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, path: str, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and the checksum of its ids (the ids, too, if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(window, TaskContext.get().partitionId() << 36)
        end = END_ID.to_bytes(4, "little")
        open_rows: dict[int, tuple] = {}  # documents with a rest that waits
        number = 0

        def rows(pieces) -> Iterator[tuple]:
            for row, start, length, sequence, offset in pieces:
                doc, raw, total, first = open_rows[row]
                piece = raw[(start - first) * 4 : (start - first + length) * 4]
                yield (doc, start, length, zlib.crc32(piece), total, sequence, offset, *((piece,) if ids else ()))

        schema = _SCHEMA.append(pa.field("ids", pa.binary())) if ids else _SCHEMA

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, _, ids_of, at in encoded(path, batch.column(1)):
                everything, cut, found = ids_of.tobytes(), (at * 4).tolist(), []
                for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True), i):
                    raw = everything[a:b] + end
                    total = len(raw) // 4
                    open_rows[number] = (names[k], raw, total, 0)
                    found += rows(packer.add(number, total))
                    waiting = {x[0] for x in packer.rests[-1:]}
                    if number in waiting:  # only the rest stays in memory
                        first = packer.rests[-1][1]
                        open_rows[number] = (names[k], raw[first * 4 :], total, first)
                    else:
                        del open_rows[number]
                    if len(packer.rests) <= 1 and len(open_rows) > 1:
                        open_rows = {x: open_rows[x] for x in waiting}
                    number += 1
                if found:
                    yield batch_of(found)
        if last := list(rows(packer.finish())):
            yield batch_of(last)
        release_memory()

    limit_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _DDL + ", ids binary" * ids)
