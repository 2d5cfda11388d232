"""Levenshtein distances of many texts at once: one table row per distinct prefix of the right texts, for
all left texts together; prefixes that neighbouring left texts have in common are one column."""

from __future__ import annotations

import numpy as np

#: Cells of the distance table that are worked on at a time.
TABLE_CELLS = 8 << 20
#: Left texts that share a table.
LEFT = 256


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points padded by 0, and lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    width = int(lengths.max(initial=0))
    codes = np.array(texts, dtype=f"=U{max(width, 1)}").view(np.uint32).reshape(len(texts), max(width, 1))[:, :width]
    return codes, lengths


def _sorted(codes: np.ndarray) -> np.ndarray:
    return np.lexsort(codes.T[::-1]) if codes.shape[1] else np.arange(len(codes))


def _new(codes: np.ndarray) -> np.ndarray:
    """Where a sorted text's prefix differs from that of the one before."""
    out = np.ones(codes.shape, dtype=bool)
    if len(codes) > 1 and codes.shape[1]:
        out[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
    return out


def distances(left: list[str], right: list[str], most: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distances of all left to all right texts. Where `most` bounds what matters for each left text, prefixes
    that exceed it for all left texts are dropped; entries above it then are some number above it."""
    b, b_len = _codes(right)
    order = _sorted(b)
    b, b_len = b[order], b_len[order]
    new = _new(b)
    a, a_len = _codes(left)
    at_left = _sorted(a)
    a, a_len = a[at_left], a_len[at_left]
    most = None if most is None else np.asarray(most)[at_left]
    size = max(a.shape[1], b.shape[1]) + 1
    kind = np.uint8 if size < 250 else np.uint16 if size < 65_000 else np.uint32
    out = np.full((len(left), len(right)), np.iinfo(kind).max, dtype=kind)
    step = max(1, TABLE_CELLS // ((a.shape[1] + 1) * LEFT))
    letters, codes = np.unique(b, return_inverse=True)
    codes = codes.reshape(b.shape)
    for lo in range(0, len(left), LEFT):
        for at in range(0, len(right), step):
            here, there = slice(lo, lo + LEFT), slice(at, at + step)
            _part(a[here], a_len[here], at_left[here], letters, codes[there], b_len[there], new[there], order[there], out, None if most is None else most[here])
    return out


def _part(a, a_len, at_left, letters, codes, b_len, new, order, out, most) -> None:
    """Fills out; the table has an entry per place of the left texts, prefix of the right texts and left text, so that rows copy whole."""
    m, one = a.shape[1], out.dtype.type(1)
    # lengths up to which all left texts are equal have one column, which numpy broadcasts
    common = int(np.argmin(np.append((a == a[0]).all(axis=0), False)))
    columns = [1 if j <= common else len(a) for j in range(m + 1)]
    other = [(a[: columns[j + 1], j][None, :] != letters[:, None]).astype(out.dtype) for j in range(m)]  # 1 where the left text's place has another letter
    table = [np.full((1, columns[j]), j, dtype=out.dtype) for j in range(m + 1)]
    node = np.zeros(len(codes), dtype=np.int64)  # each right text's row of the table; -1 if dropped
    depth = 0
    while True:
        done = np.flatnonzero((b_len == depth) & (node >= 0))
        for j in np.unique(a_len) if len(done) else ():
            at = np.flatnonzero(a_len == j)
            out[np.ix_(at_left[at], order[done])] = table[j][node[done]][:, at if columns[j] > 1 else at * 0].T
        live = np.flatnonzero((b_len > depth) & (node >= 0))
        if not len(live):
            return
        # a child of a prefix begins where the text differs from the one before, or has another parent
        starts = new[live, depth].copy()
        starts[0] = True
        starts[1:] |= node[live[1:]] != node[live[:-1]]
        # where texts between two live ones are gone, the difference may lie in one of them
        starts[1:] |= codes[live[1:], depth] != codes[live[:-1], depth]
        first = live[starts]
        letter, parents = codes[first, depth], node[first]
        node[:] = -1
        node[live] = np.cumsum(starts) - 1
        depth += 1
        above = table[0].take(parents, axis=0)
        table[0] = np.full_like(above, depth)
        low = table[0].copy() if most is not None else None
        for j in range(1, m + 1):
            row = other[j - 1].take(letter, axis=0)
            row += above
            above = table[j].take(parents, axis=0)
            np.minimum(row, above + one, out=row)
            np.minimum(row, table[j - 1] + one, out=row)
            table[j] = row
            if low is not None:
                low = np.minimum(low, row, out=low if low.shape == row.shape else None)
        if low is not None:
            kept = (low <= most).any(axis=1)
            if not kept.any():
                return
            if not kept.all():
                node[live] = np.where(kept, np.cumsum(kept) - 1, -1)[node[live]]
                table = [t[kept] for t in table]
