"""Operators on probability maps: long rows (image_id, x, y, prob), or one row with the map as an array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside_quad(x: Column, y: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Whether a point is in a convex quadrilateral, edges included: no two edges see it on different sides."""
    turns = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True)]
    return ~(F.greatest(*turns) > 0) | ~(F.least(*turns) < 0)


def dilated(white: DataFrame, width: int, height: int, times: int = 2) -> DataFrame:
    """White pixels (image_id, x, y) after growing by one pixel on all sides, `times` times; the border is never written."""
    for _ in range(times):
        around = [F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
        grown = white.select("image_id", F.explode(F.array(*around)).alias("p")).select("image_id", "p.x", "p.y")
        inner = (F.col("x") >= 1) & (F.col("x") < width - 1) & (F.col("y") >= 1) & (F.col("y") < height - 1)
        white = white.union(grown.where(inner)).distinct()
    return white


def label(white: np.ndarray) -> np.ndarray:
    """4-connected components of a mask, numbered from 1 in raster order; 0 elsewhere.

    Runs of each row are the nodes; runs that touch the row above take the smallest number of what
    they touch, until none changes.
    """
    edge = np.diff(np.pad(white.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    n = len(row)
    if not n:
        return np.zeros(white.shape, np.int32)
    # a run meets those of the row above that end after its start and start before its end
    wide = white.shape[1] + 1
    first = np.searchsorted(row * wide + end, (row - 1) * wide + start, side="right")
    last = np.searchsorted(row * wide + start, (row - 1) * wide + end, side="left")
    met = np.maximum(last - first, 0)
    below = np.repeat(np.arange(n), met)
    above = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met) + np.repeat(first, met)
    root = np.arange(n)
    while True:
        low = np.minimum(root[below], root[above])
        new = root.copy()
        for side in (below, above):
            np.minimum.at(new, root[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    number = np.unique(root, return_inverse=True)[1] + 1
    out = np.zeros(white.shape, np.int32)
    out[white.astype(bool)] = np.repeat(number, end - start)
    return out


def _map(pdf: pd.DataFrame) -> np.ndarray:
    prob = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1))
    prob[pdf["y"], pdf["x"]] = pdf["prob"]
    return prob


def components(grid: DataFrame, threshold: float = 0.3, dilations: int = 0) -> DataFrame:
    """One row a component of the (dilated) mask: bounds, area, and the mean of its probabilities over the threshold."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        prob = _map(pdf)
        parts = label(grown(prob > threshold, dilations))
        rows = []
        for k in range(1, parts.max() + 1):
            y, x = np.nonzero(parts == k)
            p = prob[y, x]
            p = p[p > threshold]
            rows.append((pdf["image_id"].iloc[0], k, x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1, len(x), p.mean() if len(p) else 0.0))
        return pd.DataFrame(rows, columns=["image_id", "component", "x", "y", "w", "h", "area", "score"])

    return grid.groupBy("image_id").applyInPandas(find, "image_id long, component int, x int, y int, w int, h int, area long, score double")


def text_boxes(grid: DataFrame, width: int, height: int, scale: float = 1.0) -> DataFrame:
    """Axis-aligned text boxes of a probability map: mask, grow, label, drop small and weak ones, unclip, rescale."""
    from glintframe.operators.boxes import unclipped

    found = components(grid, dilations=2).where("area >= 9 and w >= 3 and h >= 3 and score >= 0.5")
    c = F.col
    wider = found.select("image_id", "component", "score", *unclipped(c("x"), c("y"), c("w"), c("h"), width, height, 1.6))
    return wider.select("image_id", "component", "score", *((c(u) * scale).alias(n) for u, n in (("ux", "x"), ("uy", "y"), ("uw", "w"), ("uh", "h"))))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the leftmost point, without points on edges."""
    p = sorted(set(map(tuple, points.tolist())))

    def half(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(p if len(p) < 3 else half(p) + half(p[::-1]), points.dtype).reshape(-1, 2)


def hulls(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which sets, their hulls: sets x vertices x 2) of sets x points x 2, for each number of vertices; hull of all sets at once."""
    p = np.take_along_axis(points, np.lexsort((points[..., 1], points[..., 0]))[..., None], 1)
    alone = (p[:, 1:] == p[:, :-1]).all(2).any(1) | (len(p) < 16)  # sets with repeated points, and too few to gain from going together
    for k in np.flatnonzero(alone):
        yield np.array([k]), hull(p[k])[None]
    rest = np.flatnonzero(~alone)
    p = p[rest]
    n, size = p.shape[:2]
    if size < 3 or not n:
        yield from [(rest, p)] if n else []
        return
    every = np.arange(n)
    parts, counts = np.empty((n, 2 * size, 2), p.dtype), np.zeros(n, int)
    for half in (p, p[:, ::-1]):
        out, top = np.empty((n, size + 1, 2), p.dtype), np.zeros(n, int)
        for q in half.swapaxes(0, 1):
            at = np.flatnonzero(top > 1)
            while len(at):
                a, b, c = out[at, top[at] - 2], out[at, top[at] - 1], q[at]
                at = at[(b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]) <= 0]
                top[at] -= 1
                at = at[top[at] > 1]
            out[every, top] = q
            top += 1
        for k in range(int(top.max()) - 1):  # all but the last
            at = np.flatnonzero(top - 1 > k)
            parts[at, counts[at]] = out[at, k]
            counts[at] += 1
    for m in np.unique(counts):
        at = np.flatnonzero(counts == m)
        yield rest[at], parts[at, :m]


def ends_of_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pixels in raster order the first and the last of each row: all that a hull needs."""
    new = np.flatnonzero(np.diff(y)) + 1
    at = np.concatenate([[0], new, new - 1, [len(y) - 1]])
    return np.stack([x[at], y[at]], 1)


def tight_rectangle(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """(cx, cy, w, h, angle) of the smallest rectangle with a side along an edge of a hull; the first of equals; w >= h."""
    return tuple(tight_rectangles(np.asarray(points, float)[None])[0].tolist())


def tight_rectangles(points: np.ndarray) -> np.ndarray:
    """tight_rectangle of each of many hulls of as many vertices (hulls x vertices x 2).

    Projections stay multiples of the edge's length until the end, so that rectangles of equal area over whole numbers compare as equal.
    """
    p = np.asarray(points, float)
    edges = np.roll(p, -1, axis=1) - p
    square = (edges**2).sum(2)
    flat = ~(square >= 1e-12).any(1)
    dx, dy, x, y = edges[..., 0], edges[..., 1], p[:, None, :, 0], p[:, None, :, 1]
    along, across = dx[..., None] * x + dy[..., None] * y, dx[..., None] * y - dy[..., None] * x
    a0, a1, b0, b1 = along.min(2), along.max(2), across.min(2), across.max(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        k = np.argmin(np.where(square >= 1e-12, (a1 - a0) * (b1 - b0) / square, np.inf), axis=1)
        dx, dy, square, a0, a1, b0, b1 = (v[np.arange(len(p)), k] for v in (dx, dy, square, a0, a1, b0, b1))
        cx = (dx * (a1 + a0) / 2 - dy * (b1 + b0) / 2) / square
        cy = (dy * (a1 + a0) / 2 + dx * (b1 + b0) / 2) / square
        length = np.sqrt(square)
        w, h, angle = (a1 - a0) / length, (b1 - b0) / length, np.arctan2(dy, dx)
    turned = w < h
    w, h, angle = np.where(turned, h, w), np.where(turned, w, h), np.where(turned, angle + np.pi / 2, angle)
    while (over := angle > np.pi / 2).any():
        angle = np.where(over, angle - np.pi, angle)
    while (under := angle < -np.pi / 2).any():
        angle = np.where(under, angle + np.pi, angle)
    out = np.stack([cx, cy, w, h, angle], 1)
    out[flat] = 0
    out[flat, :2] = p[flat, 0]
    return out


def corners_of(cx: float, cy: float, w: float, h: float, angle: float) -> np.ndarray:
    """The corners of a turned rectangle."""
    half = np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2
    turn = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
    return half @ turn + [cx, cy]


def in_reading_order(corners: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left: two by x on each side, those by y."""
    c = corners[np.lexsort((corners[:, 1], corners[:, 0]))]
    left, right = c[:2][np.argsort(c[:2, 1], kind="stable")], c[2:][np.argsort(c[2:, 1], kind="stable")]
    return np.stack([left[0], right[0], right[1], left[1]])


def mean_inside(prob: np.ndarray, corners: np.ndarray) -> float:
    """Mean of the pixels in a convex quadrilateral, edges included; 0 without any."""
    low, high = np.floor(corners.min(0)).astype(int) - 1, np.ceil(corners.max(0)).astype(int) + 2
    (left, top), (right, below) = np.maximum(low, 0), np.clip(high, 0, prob.shape[::-1])  # a pixel more a side than the corners span
    prob = prob[top:below, left:right]
    y, x = np.ogrid[top : top + prob.shape[0], left : left + prob.shape[1]]
    turns = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True)]
    inside = (np.max(turns, axis=0) <= 0) | (np.min(turns, axis=0) >= 0)
    return float(prob[inside].mean()) if inside.any() else 0.0


# Mask threshold, least score, least side, growth, most share of a side that a box may span, components looked at.
MASK, SCORE, SIDE, GROWTH, SPAN, MOST = 0.3, 0.5, 3, 1.6, 0.8, 1000


def grown(mask: np.ndarray, times: int) -> np.ndarray:
    """A mask grown by one pixel on all sides, `times` times; the border is never written."""
    for _ in range(times):
        mask, beside = mask.copy(), mask[:, :-2] | mask[:, 1:-1] | mask[:, 2:]
        mask[1:-1, 1:-1] |= beside[:-2] | beside[1:-1] | beside[2:]
    return mask


def turned_boxes(prob: np.ndarray, scale: float = 1.0) -> list[tuple[int, float, float, float, float, float, float]]:
    """(component, cx, cy, w, h, angle, score) of a probability map's turned text boxes, in the picture's coordinates."""
    height, width = prob.shape
    mask = grown(prob > MASK, 2)
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(rows):
        return []
    top, left = rows[0], columns[0]
    parts = label(mask[top : rows[-1] + 1, left : columns[-1] + 1])
    out = []
    for k in range(1, min(int(parts.max()), MOST) + 1):
        y, x = np.nonzero(parts == k)
        y, x = y + top, x + left
        if len(x) < SIDE * SIDE or np.ptp(x) + 1 > int(SPAN * width) or np.ptp(y) + 1 > int(SPAN * height):
            continue
        around = hull(ends_of_rows(x, y))
        if len(around) < 3:
            continue
        cx, cy, w, h, angle = tight_rectangle(around)
        if h < SIDE or (score := mean_inside(prob, corners_of(cx, cy, w, h, angle))) < SCORE:
            continue
        grow = w * h * GROWTH / (2 * (w + h))
        if h + 2 * grow < SIDE + 2:
            continue
        c = in_reading_order(corners_of(cx, cy, w + 2 * grow, h + 2 * grow, angle) * scale)
        if not np.isfinite(c).all() or np.ptp(c[:, 0]) > SPAN * width * scale or np.ptp(c[:, 1]) > SPAN * height * scale:
            continue
        (cx, cy), top, side = (c[0] + c[2]) / 2, c[1] - c[0], c[3] - c[0]
        out.append((k, float(cx), float(cy), float(np.hypot(*top)), float(np.hypot(*side)), float(np.arctan2(top[1], top[0])), score))
    return out


def sharpest(points: np.ndarray, keep: int = 4) -> list[tuple[int, float, float]]:
    """The vertices of a hull that turn most, numbered in the hull's order; none for a hull with fewer."""
    return [] if len(points) < keep else [(n, x, y) for n, (x, y) in enumerate(sharpest_of(points[None], keep)[0].tolist())]


def sharpest_of(points: np.ndarray, keep: int = 4) -> np.ndarray:
    """The vertices, in the hull's order, of each of many hulls of as many vertices, `keep` at least."""
    p = points.astype(float)
    a, b = np.roll(p, 1, axis=1) - p, np.roll(p, -1, axis=1) - p
    cos = (a * b).sum(2) / np.maximum(np.linalg.norm(a, axis=2) * np.linalg.norm(b, axis=2), 1e-12)
    at = np.sort(np.argsort(np.arccos(np.clip(cos, -1, 1)), axis=1, kind="stable")[:, :keep], axis=1)
    return np.take_along_axis(p, at[..., None], 1)


def perspective(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The eight coefficients that map source corners to target corners; None if the corners are degenerate."""
    a, b = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        b += [u, v]
    try:
        out = np.linalg.solve(np.array(a, float), np.array(b, float))
    except np.linalg.LinAlgError:
        return None
    return out if np.isfinite(out).all() and abs(np.linalg.det(np.array(a, float))) > 1e-12 else None


def perspectives(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """perspective of many corners (n x 4 x 2): n x 8 coefficients, and which are any."""
    x, y, u, v = source[..., 0], source[..., 1], target[..., 0], target[..., 1]
    zero, one = np.zeros(x.shape), np.ones(x.shape)
    a = np.stack([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], 2), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], 2)], 2).reshape(-1, 8, 8)
    known = abs(np.linalg.det(a)) > 1e-12
    out = np.zeros((len(a), 8))
    out[known] = np.linalg.solve(a[known], target[known].reshape(-1, 8, 1))[..., 0]
    return out, known & np.isfinite(out).all(1)
