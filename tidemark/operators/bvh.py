"""Bounding-volume hierarchies, ear clipping and exact triangle tests, vectorised with numpy."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

LEAF = 8


class Bvh:
    """A hierarchy of boxes (x0, y0, x1, y1) over items, split at the median of the longer side."""

    def __init__(self, boxes: np.ndarray):
        n = len(boxes)
        self.item = np.arange(n)
        centre = (boxes[:, :2] + boxes[:, 2:]) / 2 if n else np.empty((0, 2))
        box, left, span = [], [], []
        todo = [(0, n)] if n else []
        nodes = list(todo)
        k = 0
        while k < len(nodes):
            a, b = nodes[k]
            own = self.item[a:b]
            sub = boxes[own]
            box.append([sub[:, 0].min(), sub[:, 1].min(), sub[:, 2].max(), sub[:, 3].max()])
            span.append((a, b))
            if b - a > LEAF:
                c = centre[own]
                axis = int(np.argmax(c.max(axis=0) - c.min(axis=0)))
                mid = (b - a) // 2
                self.item[a:b] = own[np.argpartition(c[:, axis], mid)]
                left.append(len(nodes))
                nodes += [(a, a + mid), (a + mid, b)]
            else:
                left.append(-1)
            k += 1
        self.box = np.array(box, dtype=float).reshape(-1, 4)
        self.left = np.array(left, dtype=np.int64)
        self.span = np.array(span, dtype=np.int64).reshape(-1, 2)
        self.boxes = boxes

    def query(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, item number) of every pair of boxes that touch, descending level by level."""
        if not len(self.box) or not len(boxes):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        q, node = np.arange(len(boxes)), np.zeros(len(boxes), dtype=np.int64)
        found_q, found_i = [], []
        while len(q):
            hit = _touch(boxes[q], self.box[node])
            q, node = q[hit], node[hit]
            end = self.left[node] < 0
            if end.any():
                eq, span = q[end], self.span[node[end]]
                size = span[:, 1] - span[:, 0]
                at = np.repeat(span[:, 0] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                items, eq = self.item[at], np.repeat(eq, size)
                ok = _touch(boxes[eq], self.boxes[items])
                found_q.append(eq[ok])
                found_i.append(items[ok])
            q, node = q[~end], self.left[node[~end]]
            q, node = np.concatenate([q, q]), np.concatenate([node, node + 1])
        empty = np.empty(0, dtype=np.int64)
        return np.concatenate([empty, *found_q]), np.concatenate([empty, *found_i])


def _touch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, 0] <= b[:, 2]) & (b[:, 0] <= a[:, 2]) & (a[:, 1] <= b[:, 3]) & (b[:, 1] <= a[:, 3])


def _side(ax: float, ay: float, bx: float, by: float, px: float, py: float) -> int:
    """The exact sign of the turn a, b, p."""
    l, r = (bx - ax) * (py - ay), (by - ay) * (px - ax)
    det = l - r
    if abs(det) > 4e-16 * (abs(l) + abs(r)):
        return 1 if det > 0 else -1
    ax, ay, bx, by, px, py = map(Fraction, (ax, ay, bx, by, px, py))
    exact = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return (exact > 0) - (exact < 0)


def sides(ax, ay, bx, by, px, py) -> np.ndarray:
    """Exact turn signs for arrays: floating point where the error bound allows it, rationals elsewhere."""
    l, r = (bx - ax) * (py - ay), (by - ay) * (px - ax)
    det = l - r
    out = np.sign(det).astype(np.int8)
    for i in np.flatnonzero(np.abs(det) <= 4e-16 * (np.abs(l) + np.abs(r))):
        out[i] = _side(float(ax[i]), float(ay[i]), float(bx[i]), float(by[i]), float(px[i]), float(py[i]))
    return out


def in_triangles(tri: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inside or on, on the border) for rows of triangles (ax, ay, bx, by, cx, cy) and points, exactly."""
    ax, ay, bx, by, cx, cy = tri.T
    s = np.stack([sides(ax, ay, bx, by, px, py), sides(bx, by, cx, cy, px, py), sides(cx, cy, ax, ay, px, py)])
    inside = ~((s > 0).any(axis=0) & (s < 0).any(axis=0))
    flat = (s == 0).all(axis=0)
    return inside & ~flat, inside & (s == 0).any(axis=0) & ~flat


def crossed(tri: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Whether a ray to the right crosses an odd number of a triangle's sides, each without its upper end.

    A side that two triangles share counts for both or neither, so over a fan all but the ring's own sides cancel out.
    """
    ax, ay, bx, by, cx, cy = tri.T
    odd = np.zeros(len(tri), dtype=bool)
    for x1, y1, x2, y2 in ((ax, ay, bx, by), (bx, by, cx, cy), (cx, cy, ax, ay)):
        up = y2 > y1
        # from the lower end to the upper one, whatever way the side is given
        turn = sides(np.where(up, x1, x2), np.where(up, y1, y2), np.where(up, x2, x1), np.where(up, y2, y1), px, py)
        odd ^= ((y1 > py) != (y2 > py)) & (turn > 0)
    return odd


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple[float, ...]] | None:
    """Triangles of a simple closed or open ring; None if it can't be clipped (it crosses itself)."""
    pts = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    if len(pts) < 3:
        return []
    area = sum(Fraction(a[0]) * Fraction(b[1]) - Fraction(b[0]) * Fraction(a[1]) for a, b in zip(pts, pts[1:] + pts[:1]))
    if area < 0:
        pts.reverse()
    xy, n = np.array(pts, dtype=float), len(pts)
    ring, out, misses, i = list(range(n)), [], 0, 0
    # only corners that turn the wrong way can lie in an ear
    bent = np.array([_side(*pts[k - 1], *pts[k], *pts[(k + 1) % n]) <= 0 for k in range(n)])
    while len(ring) > 3:
        n = len(ring)
        if misses > n:
            return None
        at = i % n
        ka, kb, kc = ring[at - 1], ring[at], ring[(at + 1) % n]
        a, b, c = pts[ka], pts[kb], pts[kc]
        turn = _side(*a, *b, *c)
        ear = turn >= 0
        if turn > 0:
            other = xy[bent]
            (x0, x1), (y0, y1) = ((min(a[j], b[j], c[j]), max(a[j], b[j], c[j])) for j in (0, 1))
            other = other[(other[:, 0] >= x0) & (other[:, 0] <= x1) & (other[:, 1] >= y0) & (other[:, 1] <= y1)]
            other = other[[(x, y) not in (a, b, c) for x, y in other.tolist()]] if len(other) else other
            ear = not len(other) or not in_triangles(np.array([[*a, *b, *c]] * len(other), dtype=float), other[:, 0], other[:, 1])[0].any()
        if ear:
            if turn > 0:
                out.append((*a, *b, *c))
            ring.pop(at)
            bent[kb] = False
            n = len(ring)
            for k in (at - 1, at):
                bent[ring[k % n]] = _side(*pts[ring[(k - 1) % n]], *pts[ring[k % n]], *pts[ring[(k + 1) % n]]) <= 0
            misses = 0
        else:
            i, misses = at + 1, misses + 1
    last = [pts[k] for k in ring]
    if _side(*last[0], *last[1], *last[2]) > 0:
        out.append((*last[0], *last[1], *last[2]))
    total = sum(abs((Fraction(t[2]) - Fraction(t[0])) * (Fraction(t[5]) - Fraction(t[1])) - (Fraction(t[4]) - Fraction(t[0])) * (Fraction(t[3]) - Fraction(t[1]))) for t in out)
    return out if total == abs(area) else None


def fan(ring: list[tuple[float, float]]) -> list[tuple[float, ...]]:
    """Triangles from the first corner: a point lies in any ring, even one crossing itself, if in an odd number of them."""
    pts = list(ring[:-1] if ring and ring[0] == ring[-1] else ring)
    return [(*pts[0], *b, *c) for b, c in zip(pts[1:], pts[2:])]
