"""Tiles of many small shapes at once: what a task does with its rows in ``tiles.shape_counts``.

A shape comes as its rings on the unit square. The arithmetic is that of ``tiles._outline``, a level at a time over arrays, so both find the same
tiles; here the tiles of a shape stay within the task, and only counts leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20     # tiles, by estimate, that a task holds at once
SCHEMA = "z int, x long, y long, cnt long, inside long"
_ARROW = pa.schema([("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("cnt", pa.int64()), ("inside", pa.int64())])


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _segments(rings: pa.ListArray) -> dict[str, np.ndarray]:
    """Segments of the rows' rings, in the order of the rows; ``f`` is the row. A lone vertex is a segment of length zero."""
    count = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    uv, area, holds = rings.flatten().flatten()
    size = pc.list_value_length(uv).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    at = uv.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    row = np.repeat(np.arange(len(count)), count)
    ring = np.repeat(np.arange(len(size)), size)
    place = _within(size)
    one = np.flatnonzero((place < size[ring] - 1) | (size[ring] == 1))
    two = np.where(size[ring[one]] == 1, one, one + 1)
    ring = ring[one]
    flag = [c.to_numpy(zero_copy_only=False).astype(bool)[ring] for c in (area, holds)]
    return {"u1": at[one, 0], "v1": at[one, 1], "u2": at[two, 0], "v2": at[two, 1], "area": flag[0], "holds": flag[1], "f": row[ring]}


def _level(s: dict[str, np.ndarray], z: int, above: tuple | None) -> tuple[np.ndarray, ...]:
    """(f, x, y, met) of one level, each tile of a shape once; ``above`` has (f, x, y) of the outlines of polygons on the level above."""
    n, last = float(1 << z), (1 << z) - 1
    a1, a2, b1, b2 = (s[k] * n for k in ("u1", "u2", "v1", "v2"))
    low, high = np.minimum(a1, a2), np.maximum(a1, a2)

    def index(v: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(v), 0, last).astype(np.int64)

    c0 = index(low)
    wide = index(high) - c0 + 1
    i = np.repeat(np.arange(len(c0)), wide)
    x = c0[i] + _within(wide)
    low, high, p1, p2, q1, q2 = low[i], high[i], a1[i], a2[i], b1[i], b2[i]
    xa = np.where(x == 0, low, np.maximum(low, x))
    xb = np.where(x == last, high, np.minimum(high, x + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        ya, yb = (np.where(p1 == p2, flat, np.where(side == p1, q1, np.where(side == p2, q2, q1 + (q2 - q1) * ((side - p1) / (p2 - p1)))))
                  for side, flat in ((xa, q1), (xb, q2)))
    r0 = index(np.minimum(ya, yb))
    tall = index(np.maximum(ya, yb)) - r0 + 1
    j = np.repeat(np.arange(len(r0)), tall)
    y, x, i = r0[j] + _within(tall), x[j], i[j]
    f = s["f"][i]

    # A tile of a shape as one number, counted from the corner of the shape's box.
    heads = np.flatnonzero(np.diff(s["f"], prepend=-1))
    x0, y0 = np.zeros(s["f"][-1] + 1, np.int64), np.zeros(s["f"][-1] + 1, np.int64)
    x0[s["f"][heads]] = np.minimum.reduceat(c0, heads) // 2 * 2
    y0[s["f"][heads]] = np.minimum.reduceat(index(np.minimum(b1, b2)), heads) // 2 * 2 - 2
    if above is not None and len(above[0]):
        kf, kx, ky = (np.concatenate([v] * 4) for v in above)
        quarter = np.repeat(np.arange(4), len(above[0]))
        kx, ky = 2 * kx + (quarter & 1), 2 * ky + (quarter >> 1)
    else:
        kf = kx = ky = np.zeros(0, np.int64)
    areas = bool(s["area"].any()) or len(kf) > 0
    f, dx, dy = np.concatenate([f, kf]), np.concatenate([x - x0[f], kx - x0[kf]]), np.concatenate([y - y0[f], ky - y0[kf]])
    w, h = int(dx.max()) + 1, int(dy.max()) + 1
    code = (f * h + dy) * w + dx
    if not areas:
        code = np.unique(code)
        met = np.ones(len(code), bool)
    else:
        turns, outline = np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        middle, ya, yb = y + 0.5, ya[j], yb[j]
        turns[:len(y)] = s["area"][i] & (((ya <= middle) & (middle < yb)) | ((yb <= middle) & (middle < ya)))
        outline[:len(y)] = True
        order = np.argsort(code, kind="stable")
        code = code[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        code, turns, met = code[starts], np.add.reduceat(turns[order], starts), np.logical_or.reduceat(outline[order], starts)
        row = code // w
        ahead = np.cumsum(turns)
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        before = ahead - np.repeat(ahead[begins] - turns[begins], np.diff(begins, append=len(row)))
        kept = met | (before % 2 == 1)
        code, met = code[kept], met[kept]
    row, dx = np.divmod(code, w)
    f, dy = np.divmod(row, h)
    return f, dx + x0[f], dy + y0[f], met


def _sums(z: int, x: np.ndarray, y: np.ndarray, cnt: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    code = x << z | y
    order = np.argsort(code)
    code = code[order]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    code = code[starts]
    cnt, inside = (np.add.reduceat(v[order], starts) if len(starts) else v for v in (cnt, inside))
    return np.full(len(code), z, np.int32), code >> z, code & ((1 << z) - 1), cnt, inside


def _batch(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=_ARROW)


def _chunks(rings: pa.ListArray, heads: np.ndarray, levels: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that begin at one of ``heads`` and hold some ``CHUNK`` tiles, one head's rows at least."""
    count = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    uv = rings.flatten().field("uv")
    size = pc.list_value_length(uv).to_numpy(zero_copy_only=False).astype(np.int64)
    at = uv.flatten().to_numpy(zero_copy_only=False)
    step = np.abs(at[2:] - at[:-2]) if len(at) > 2 else np.zeros(0)
    ends = np.cumsum(size)
    for back in (2, 1):     # steps from ring to ring
        gone = ends[:-1][(ends[:-1] >= back) & (ends[:-1] - back < len(step))] - back
        step[gone] = 0
    tiles = np.append(0, np.cumsum(np.append(step, np.zeros(len(at) - len(step))) * float(1 << levels) + levels))
    cost = tiles[np.append(0, ends)[np.append(0, np.cumsum(count))]]
    part = cost[:-1][heads] // CHUNK
    cuts = heads[np.flatnonzero(np.diff(part, prepend=-1))]
    yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(count)])


def counts(levels: int):
    """Count the rows, a shape each, on every level: ``cnt`` by outline, and ``inside``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rings = batch.column("rings")
            for start, stop in _chunks(rings, np.arange(len(rings)), levels):
                s = _segments(rings.slice(start, stop - start))
                if not len(s["f"]):
                    continue
                holds = np.zeros(s["f"][-1] + 1, bool)
                holds[s["f"]] = s["holds"]
                parts, above = [], None
                for z in range(levels):
                    f, x, y, met = _level(s, z, above)
                    parts.append(_sums(z, x, y, met.astype(np.int64), (~met).astype(np.int64)))
                    up = met & holds[f]
                    above = (f[up], x[up], y[up])
                yield from _batch(parts)
    return run


def _twice(table: pa.Table, levels: int) -> Iterator[pa.RecordBatch]:
    heads = np.flatnonzero(table.column("head").to_numpy())
    rings = table.column("rings").combine_chunks()
    rings = rings.combine_chunks() if isinstance(rings, pa.ChunkedArray) else rings
    for start, stop in _chunks(rings, heads, levels):
        s = _segments(rings.slice(start, stop - start))
        group = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(rings)))[start:stop]
        parts = []
        for z in range(levels):
            if not len(s["f"]):
                break
            f, x, y, _ = _level(s, z, None)
            g = group[f]
            order = np.lexsort((y, x, g))
            g, x, y = g[order], x[order], y[order]
            starts = np.flatnonzero((np.diff(g, prepend=-1) != 0) | (np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
            more = np.diff(starts, append=len(g)) - 1
            starts, more = starts[more > 0], more[more > 0]
            if len(starts):
                parts.append(_sums(z, x[starts], y[starts], -more, np.zeros(len(more), np.int64)))
            # A tile that two rows of a key share lies in one that they share on the level above.
            left = np.isin(group[s["f"]], g[starts])
            s = {k: v[left] for k, v in s.items()}
        yield from _batch(parts)


def repeats(levels: int):
    """What ``counts`` counts too often where rows of lines share a key, as negative numbers. Rows come key by key, the first of each with ``head``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            last = int(np.flatnonzero(table.column("head").to_numpy())[-1])
            kept = table.slice(last)
            if last:
                yield from _twice(table.slice(0, last), levels)
        if kept is not None:
            yield from _twice(kept, levels)
    return run
