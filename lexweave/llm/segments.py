"""Segments: sorted arrays in files, one per bucket of hashes, which workers map.

A file's name follows from its bucket, so what is sent to workers is a folder. A file appears whole, and repeated attempts of a
task write the same. Folders lie where executors share them, under any file system that pyarrow opens by URI; where files can't
be mapped, a worker reads those that it needs into memory.
"""

from __future__ import annotations

import mmap
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.fs

from .shared import U64, mix

#: Segments of a folder that a worker keeps open, the latest used.
MOST_OPEN = 256


def _mapped(path: str):
    fs, local = pa.fs.FileSystem.from_uri(path)
    if not isinstance(fs, pa.fs.LocalFileSystem):
        with fs.open_input_file(local) as f:
            return f.read()
    with open(local, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def write_segment(folder: str, bucket: int, arrays: list[np.ndarray]) -> None:
    """Writes the arrays with their types and lengths, each at a multiple of 8 bytes, under a name that follows from the bucket.

    A file appears whole; attempts that are repeated write the same."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    own, name = f"{path}/attempt-{uuid.uuid4().hex}", f"{path}/{bucket:x}"
    with fs.open_output_stream(own) as out:
        out.write(np.array([len(arrays), *(v for x in arrays for v in (x.itemsize, len(x)))], np.int64).tobytes())
        for x in arrays:
            out.write(x.tobytes() + bytes(-x.nbytes % 8))
    try:
        fs.move(own, name)
    except OSError:  # some file systems don't replace what another attempt has written
        if fs.get_file_info(name).type != pa.fs.FileType.File:
            raise
        fs.delete_file(own)


def read_segment(folder: str, bucket: int) -> list[np.ndarray] | None:
    try:
        data = _mapped(f"{folder}/{bucket:x}")
    except FileNotFoundError:  # a bucket without n-grams
        return None
    n = int(np.frombuffer(data, np.int64, 1)[0])
    shape, at, out = np.frombuffer(data, np.int64, 2 * n, 8).reshape(-1, 2), 8 + 16 * n, []
    for size, length in shape.tolist():
        out.append(np.frombuffer(data, f"<u{size}", length, at))
        at += size * length + -size * length % 8
    return out


class Segments:
    """The segments of a folder by bucket, opened when they are asked for; it travels to workers as the folder's name."""

    def __init__(self, folder: str):
        self.folder, self._open = folder, OrderedDict()

    def __getstate__(self):
        return self.folder

    def __setstate__(self, folder):
        self.__init__(folder)

    def __getitem__(self, bucket: int) -> list[np.ndarray] | None:
        if bucket not in self._open:
            self._open[bucket] = read_segment(self.folder, bucket)
            if len(self._open) > MOST_OPEN:
                self._open.popitem(last=False)
        self._open.move_to_end(bucket)
        return self._open[bucket]


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type that holds them."""
    most = int(x.max(initial=0))
    return x.astype(next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (U64, 64)) if most < 1 << bits))


def coded(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the rows that the columns make, and the distinct rows one after another; rows are told apart by 64 bits of hash."""
    name = columns[0].astype(U64)
    with np.errstate(over="ignore"):
        for c in columns[1:]:
            name = mix(name * U64(0x9FB21C651E98DF25) + c.astype(U64))
    _, first, code = np.unique(name, return_index=True, return_inverse=True)
    return narrow(code), np.stack([c[first] for c in columns], axis=1).astype(U64).ravel()
