"""Plane geometry on NumPy arrays, for use within Arrow batches: points are arrays (n, 2), sides arrays (n, 4) of ax, ay,
bx, by, and a shape is its sides.

Two shapes are compared by cutting the sides of both where they meet, and telling of each piece whether it lies inside
the other shape, outside, or along its border; from that follow the relations of the shapes and the sides of their
intersection. Sides are matched in vertical strips, so that only sides near each other are compared.
"""

from __future__ import annotations

import numpy as np

#: Distances, in units of the coordinates, below which points count as one.
CLOSE = 1e-9
#: Pairs of sides and of points and sides that are compared at a time.
PAIRS = 1 << 20


def sides(ring: np.ndarray) -> np.ndarray:
    """The sides of a line or ring of points."""
    return np.concatenate([ring[:-1], ring[1:]], 1)


def ring_area(ring: np.ndarray) -> float:
    """Positive for a ring that turns left, from its first point on."""
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] values, then those of starts[1]."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


def near_pairs(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of boxes of a and b that meet; lo and hi are arrays (n, 2). Boxes are listed by vertical strips
    and compared within them."""
    none = np.zeros(0, np.int64)
    if not len(a_lo) or not len(b_lo):
        return none, none
    if len(a_lo) * len(b_lo) <= 1 << 13:  # strips would not pay
        return np.nonzero(((a_lo[:, None] <= b_hi[None]) & (b_lo[None] <= a_hi[:, None])).all(2))
    left, right = max(a_lo[:, 0].min(), b_lo[:, 0].min()), min(a_hi[:, 0].max(), b_hi[:, 0].max())
    if left > right:
        return none, none
    n = int(min(4096, max(1, np.sqrt(len(a_lo) * len(b_lo)) / 8)))
    width = (right - left) / n or 1.0

    def listed(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(strip, box) by strip."""
        use = np.flatnonzero((hi[:, 0] >= left) & (lo[:, 0] <= right))
        first = np.clip(np.floor((lo[use, 0] - left) / width), 0, n - 1).astype(np.int64)
        last = np.clip(np.floor((hi[use, 0] - left) / width), 0, n - 1).astype(np.int64)
        strip, box = _runs(first, last - first + 1), np.repeat(use, last - first + 1)
        order = np.argsort(strip, kind="stable")
        return strip[order], box[order]

    (a_strip, a_box), (b_strip, b_box) = listed(a_lo, a_hi), listed(b_lo, b_hi)
    begin, end = np.searchsorted(b_strip, a_strip), np.searchsorted(b_strip, a_strip, "right")
    size, found = end - begin, []
    cut = np.append(np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), PAIRS)), len(size))
    for lo, hi in zip(cut[:-1], np.maximum(cut[1:], cut[:-1]), strict=True):
        i, j, strip = np.repeat(a_box[lo:hi], size[lo:hi]), b_box[_runs(begin[lo:hi], size[lo:hi])], np.repeat(a_strip[lo:hi], size[lo:hi])
        meet = ((a_lo[i] <= b_hi[j]) & (b_lo[j] <= a_hi[i])).all(1)
        # a pair is taken in the first strip that both are in
        first = np.floor((np.maximum(a_lo[i, 0], b_lo[j, 0]) - left) / width)
        meet &= np.clip(first, 0, n - 1) == strip
        found.append((i[meet], j[meet]))
    return tuple(np.concatenate([none, *x]) for x in zip(*found, strict=True)) if found else (none, none)


def _boxes(s: np.ndarray, by: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(s[:, :2], s[:, 2:]) - by, np.maximum(s[:, :2], s[:, 2:]) + by


def inside(points: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Whether each point is in the shape whose sides these are, by the number of sides to its right. Points that lie on
    a side may be told either way."""
    lo, hi = _boxes(shape)
    far = hi[:, 0].max(initial=-np.inf)
    i, j = near_pairs(points[:, ::-1], np.stack([points[:, 1], np.maximum(points[:, 0], far)], 1), lo[:, ::-1], hi[:, ::-1])
    x, y = points[i].T
    ax, ay, bx, by = shape[j].T
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return np.bincount(i[crossed], minlength=len(points)) % 2 == 1


def on_sides(points: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """For each point a side of the shape that it lies on, or -1."""
    out = np.full(len(points), -1)
    i, j = near_pairs(points, points, *_boxes(shape, 2 * CLOSE))
    start, way = shape[j, :2], shape[j, 2:] - shape[j, :2]
    to = points[i] - start
    length2 = np.maximum((way * way).sum(1), 1e-300)
    t = np.clip((to * way).sum(1) / length2, 0, 1)
    near = ((to - t[:, None] * way) ** 2).sum(1) <= (2 * CLOSE) ** 2
    out[i[near]] = j[near]
    return out


def _cuts(a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], bool]:
    """Where the sides of a and of b are cut by each other: (side, point) for each, and whether they meet at all. A side
    is cut where an end of another lies on it, by that very point, and where two sides cross, by one point for both."""
    i, j = near_pairs(*_boxes(a, CLOSE), *_boxes(b, CLOSE))
    p, q = a[i], b[j]

    def off(line: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far a point is to the left of a line, and whether it lies on the side itself."""
        way, to = line[:, 2:] - line[:, :2], point - line[:, :2]
        length = np.maximum(np.sqrt((way * way).sum(1)), 1e-300)
        left, along = (way[:, 0] * to[:, 1] - way[:, 1] * to[:, 0]) / length, (way * to).sum(1) / length
        return left, (np.abs(left) <= CLOSE) & (along >= -CLOSE) & (along <= length + CLOSE)

    (g0, a0_on), (g1, a1_on) = off(q, p[:, :2]), off(q, p[:, 2:])
    (h0, b0_on), (h1, b1_on) = off(p, q[:, :2]), off(p, q[:, 2:])
    touch = a0_on | a1_on | b0_on | b1_on
    cross = ~touch & (g0 * g1 < 0) & (h0 * h1 < 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (p[:, :2] + (g0 / (g0 - g1))[:, None] * (p[:, 2:] - p[:, :2]))[cross]
    of_a = np.concatenate([i[b0_on], i[b1_on], i[cross]]), np.concatenate([q[b0_on, :2], q[b1_on, 2:], at])
    of_b = np.concatenate([j[a0_on], j[a1_on], j[cross]]), np.concatenate([p[a0_on, :2], p[a1_on, 2:], at])
    return of_a, of_b, bool((touch | cross).any())


def _pieces(shape: np.ndarray, cut: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The sides, cut at the points given, without pieces that are next to nothing."""
    side, point = cut
    if not len(side):
        return shape
    way = shape[side, 2:] - shape[side, :2]
    t = ((point - shape[side, :2]) * way).sum(1) / np.maximum((way * way).sum(1), 1e-300)
    own = np.arange(len(shape))
    of, t, xy = np.concatenate([own, side, own]), np.concatenate([np.zeros(len(shape)), np.clip(t, 0, 1), np.ones(len(shape))]), np.concatenate([shape[:, :2], point, shape[:, 2:]])
    order = np.lexsort((np.arange(len(of)), t, of))
    of, xy = of[order], xy[order]
    out = np.concatenate([xy[:-1], xy[1:]], 1)[of[1:] == of[:-1]]
    return out[((out[:, 2:] - out[:, :2]) ** 2).sum(1) > CLOSE**2]


def oriented(rings: list[np.ndarray]) -> np.ndarray:
    """The sides of an area, its inner on their left: the outer ring turned left, the holes turned right."""
    rings = [r if (r[0] == r[-1]).all() else np.concatenate([r, r[:1]]) for r in rings]
    return np.concatenate([sides(r if (ring_area(r) > 0) == (k == 0) else r[::-1]) for k, r in enumerate(rings)])


def _placed(pieces: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece 1, 0 or -1 as it lies inside an area, along its border or outside; and whether a piece along the
    border runs the same way as the border does."""
    middle = (pieces[:, :2] + pieces[:, 2:]) / 2
    side = on_sides(middle, shape)
    same = ((pieces[:, 2:] - pieces[:, :2]) * (shape[side, 2:] - shape[side, :2])).sum(1) > 0
    state = np.zeros(len(pieces), int)
    rest = side < 0
    state[rest] = np.where(inside(middle[rest], shape), 1, -1)
    return state, same & ~rest


def _ends(line: np.ndarray) -> np.ndarray:
    """The two ends of a line of sides; none if it is closed."""
    ends = np.stack([line[0, :2], line[-1, 2:]])
    return ends[:0] if ((ends[0] - ends[1]) ** 2).sum() <= CLOSE**2 else ends


def relation(a: np.ndarray, b: np.ndarray, a_area: bool, b_area: bool) -> str:
    """Nine letters T or F: whether the inner, border and outer of a (in turn) have points in common with those of b.

    An area (sides as of ``oriented``) has its sides as border, a line its two ends, and a closed line none."""
    if not len(a) or not len(b):
        return "FF" + "FT"[len(a) > 0] + "FF" + "FT"[len(a) > 0] + "FT"[len(b) > 0] * 2 + "T"
    if b_area and not a_area:
        m = relation(b, a, True, False)
        return "".join(m[k] for k in (0, 3, 6, 1, 4, 7, 2, 5, 8))
    of_a, of_b, meet = _cuts(a, b)
    pa, pb = _pieces(a, of_a), _pieces(b, of_b)
    if a_area and b_area:
        (sa, same), (sb, _) = _placed(pa, b), _placed(pb, a)
        a_in, a_out, b_in, b_out = (sa == 1).any(), (sa == -1).any(), (sb == 1).any(), (sb == -1).any()
        against = ((sa == 0) & ~same).any()
        m = [a_in or b_in or same.any(), b_in, a_out or b_in or against, a_in, meet, a_out, b_out or a_in or against, b_out, True]
    elif a_area:
        state, _ = _placed(pb, a)
        ends = _ends(b)
        nodes = np.concatenate([pb[:, :2], pb[:, 2:]])
        if len(ends):
            nodes = nodes[(((nodes[:, None] - ends[None]) ** 2).sum(2) > CLOSE**2).all(1)]
        end_on = on_sides(ends, a) >= 0
        end_in = ~end_on & inside(ends, a)
        along = (state == 0).any() or (on_sides(nodes, a) >= 0).any()
        bare = (on_sides((pa[:, :2] + pa[:, 2:]) / 2, b) < 0).any()
        m = [(state == 1).any(), end_in.any(), True, along, end_on.any(), bare, (state == -1).any(), (~end_on & ~end_in).any(), True]
    else:
        def seen(pieces: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple:
            """Of a line's inner and ends: whether some lie on the other's inner, on its ends, outside."""
            ends, others = _ends(own), _ends(other)
            close = lambda x, y: (((x[:, None] - y[None]) ** 2).sum(2) <= 4 * CLOSE**2).any(1)
            nodes = np.concatenate([pieces[:, :2], pieces[:, 2:]])
            nodes = nodes[~close(nodes, ends)]
            run = on_sides((pieces[:, :2] + pieces[:, 2:]) / 2, other) >= 0
            node_on, end_on = on_sides(nodes, other) >= 0, on_sides(ends, other) >= 0
            node_at, end_at = close(nodes, others), close(ends, others)
            return run.any() or (node_on & ~node_at).any(), node_at.any(), (~run).any(), (end_on & ~end_at).any(), end_at.any(), (~end_on).any()

        x, y = seen(pa, a, b), seen(pb, b, a)
        m = [x[0] or y[0], x[1] or y[3], x[2], x[3] or y[1], x[4], x[5], y[2], y[5], True]
    return "".join("FT"[bool(x)] for x in m)


def _loops(edges: np.ndarray) -> list[np.ndarray]:
    """Rings of edges of which as many come to each node as leave it; none comes to a node twice.

    At a node a ring goes on by the edge furthest to the right, so that rings do not cross; one that comes to a node
    again is parted there."""
    key = np.round(edges / (10 * CLOSE)).astype(np.int64)
    _, node = np.unique(key.reshape(-1, 2), axis=0, return_inverse=True)
    node = node.reshape(-1, 2)
    angle = np.arctan2(edges[:, 3] - edges[:, 1], edges[:, 2] - edges[:, 0])
    leaving: dict[int, list[int]] = {}
    for k, n in enumerate(node[:, 0].tolist()):
        leaving.setdefault(n, []).append(k)
    used, rings = np.zeros(len(edges), bool), []
    for first in range(len(edges)):
        if used[first]:
            continue
        k, path, spot = first, [], {}
        while True:
            used[k] = True
            spot[int(node[k, 0])] = len(path)
            path.append(k)
            here = int(node[k, 1])
            if here in spot:
                ring = path[spot[here] :]
                for e in ring:
                    del spot[int(node[e, 0])]
                path = path[: len(path) - len(ring)]
                rings.append(np.concatenate([edges[ring, :2], edges[ring[:1], :2]]))
            out = [e for e in leaving.get(here, ()) if not used[e]]
            if not out:
                break
            back = angle[k] + np.pi
            k = max(out, key=lambda e: (back - angle[e]) % (2 * np.pi)) if len(out) > 1 else out[0]
    return rings


def nest(rings: list[np.ndarray]) -> list[tuple[int, list[int]]]:
    """(outer ring, its holes) of rings (closed, of x and y) that do not cross: what lies in an even number of others is
    an outer ring, the rest are holes of the smallest ring around them. A point within each ring tells where it lies, so
    rings may touch."""
    if len(rings) == 1:
        return [(0, [])]
    box = np.array([[*r.min(0), *r.max(0)] for r in rings])
    size = np.array([abs(ring_area(r)) for r in rings])
    depth, parent = np.zeros(len(rings), int), np.full(len(rings), -1)
    for k, r in enumerate(rings):
        around = np.flatnonzero((box[:, 0] <= box[k, 0]) & (box[:, 1] <= box[k, 1]) & (box[:, 2] >= box[k, 2]) & (box[:, 3] >= box[k, 3]) & (size > size[k]))
        if len(around):
            point = inner_point(r)
            around = [j for j in around if inside(point[None], sides(rings[j]))[0]]
            depth[k] = len(around)
            parent[k] = min(around, key=lambda j: size[j], default=-1)
    return [(k, [j for j in range(len(rings)) if parent[j] == k and depth[j] % 2]) for k in np.flatnonzero(depth % 2 == 0).tolist()]


def intersection(a: np.ndarray, b: np.ndarray, least: float = 1e-14) -> list[list[np.ndarray]]:
    """The areas, each its rings with the outer one first, that two areas (sides as of ``oriented``) have in common. Points
    and lines in common are none, nor are rings of an area up to ``least``."""
    of_a, of_b, _ = _cuts(a, b)
    pa, pb = _pieces(a, of_a), _pieces(b, of_b)
    (sa, same), (sb, _) = _placed(pa, b), _placed(pb, a)
    rings = [r for r in _loops(np.concatenate([pa[(sa == 1) | same], pb[sb == 1]])) if abs(ring_area(r)) > least]
    return [[rings[k] for k in (outer, *holes)] for outer, holes in nest(rings)] if rings else []


def inner_point(ring: np.ndarray) -> np.ndarray:
    """A point within a ring: between the first two sides on a level between two of its points' heights."""
    heights = np.unique(ring[:, 1])
    if len(heights) < 2:
        return ring[0]
    gap = int(np.argmax(np.diff(heights)))
    y = (heights[gap] + heights[gap + 1]) / 2
    s = sides(ring)
    s = s[(s[:, 1] > y) != (s[:, 3] > y)]
    x = np.sort(s[:, 0] + (y - s[:, 1]) / (s[:, 3] - s[:, 1]) * (s[:, 2] - s[:, 0]))
    widest = int(np.argmax(x[1::2] - x[::2]))
    return np.array([(x[2 * widest] + x[2 * widest + 1]) / 2, y])
