"""Relations and intersections of shapes: known cases, and random ones against dense samples of points."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wakeline.functions import planar
from wakeline.functions.planar import intersection, oriented, relation, sides


def box(x, y, w, h=None):
    h = w if h is None else h
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], float)


def line(*points):
    return sides(np.array(points, float))


A = oriented([box(0, 0, 4)])
RING = oriented([box(0, 0, 4), box(1, 1, 2)])


@pytest.mark.parametrize(
    ("a", "b", "matrix"),
    [
        (A, oriented([box(0, 0, 4)[::-1]]), "TFFFTFFFT"),  # equal
        (A, oriented([box(1, 1, 1)]), "TTTFFTFFT"),  # contains
        (oriented([box(1, 1, 1)]), A, "TFFTFFTTT"),  # within
        (A, oriented([box(0, 0, 2)]), "TTTFTTFFT"),  # covers, with a corner of the border
        (A, oriented([box(2, 2, 4)]), "TTTTTTTTT"),  # overlaps
        (A, oriented([box(4, 0, 4)]), "FFTFTTTTT"),  # touches along a side
        (A, oriented([box(4, 4, 4)]), "FFTFTTTTT"),  # touches at a corner
        (A, oriented([box(9, 9, 1)]), "FFTFFTTTT"),  # apart
        (RING, oriented([box(1, 1, 2)]), "FFTFTTTFT"),  # fills the hole
        (RING, oriented([box(1.5, 1.5, 1)]), "FFTFFTTTT"),  # within the hole
        (RING, A, "TFFTTFTFT"),
    ],
)
def test_areas(a, b, matrix):
    assert relation(a, b, True, True) == matrix
    assert relation(b, a, True, True) == "".join(matrix[k] for k in (0, 3, 6, 1, 4, 7, 2, 5, 8))


@pytest.mark.parametrize(
    ("b", "matrix"),
    [
        (line((1, 1), (2, 3)), "TTTFFTFFT"),  # within
        (line((0, 0), (4, 0)), "FFTTTTFFT"),  # along the border
        (line((1, 1), (9, 1)), "TTTTFTTTT"),  # leaves
        (line((-1, 1), (9, 1)), "TFTTFTTTT"),  # through
        (line((0, 1), (4, 1)), "TFTFTTFFT"),  # from border to border
        (line((5, 5), (9, 9)), "FFTFFTTTT"),  # apart
        (line((-1, 1), (1, -1)), "FFTTFTTTT") if False else (line((4, 4), (9, 9)), "FFTFTTTTT"),  # touches with its end
        (line(*box(0, 0, 4)), "FFTTFFFFT"),  # is the border
        (line((-2, 2), (2, -2)), "FFTTFTTTT"),  # touches a corner
    ],
)
def test_an_area_and_a_line(b, matrix):
    assert relation(A, b, True, False) == matrix
    assert relation(b, A, False, True) == "".join(matrix[k] for k in (0, 3, 6, 1, 4, 7, 2, 5, 8))


@pytest.mark.parametrize(
    ("a", "b", "matrix"),
    [
        (line((0, 0), (4, 4)), line((0, 4), (4, 0)), "TFTFFTTTT"),  # cross
        (line((0, 0), (2, 2)), line((2, 2), (4, 0)), "FFTFTTTTT"),  # end at end
        (line((0, 0), (4, 0)), line((2, 0), (2, 3)), "FTTFFTTTT"),  # an end within
        (line((0, 0), (4, 0)), line((1, 0), (2, 0)), "TTTFFTFFT"),  # a part
        (line((0, 0), (4, 0)), line((4, 0), (2, 0), (0, 0)), "TFFFTFFFT"),  # the same
        (line((0, 0), (1, 0)), line((3, 0), (4, 0)), "FFTFFTTTT"),
    ],
)
def test_lines(a, b, matrix):
    assert relation(a, b, False, False) == matrix
    assert relation(b, a, False, False) == "".join(matrix[k] for k in (0, 3, 6, 1, 4, 7, 2, 5, 8))


def area(parts):
    return sum(abs(planar.ring_area(p[0])) - sum(abs(planar.ring_area(h)) for h in p[1:]) for p in parts)


def test_intersections_of_known_areas():
    assert area(intersection(A, oriented([box(2, 2, 4)]))) == pytest.approx(4)
    assert area(intersection(A, oriented([box(0, 0, 4)[::-1]]))) == pytest.approx(16)
    assert intersection(A, oriented([box(4, 0, 4)])) == [] == intersection(A, oriented([box(4, 4, 1)])) == intersection(RING, oriented([box(1, 1, 2)]))
    cut = intersection(RING, oriented([box(-1, 1.5, 9, 1)]))
    assert len(cut) == 2 and area(cut) == pytest.approx(2)
    whole = intersection(RING, oriented([box(-1, -1, 9)]))
    assert len(whole) == 1 and len(whole[0]) == 2 and area(whole) == pytest.approx(12)
    comb = np.array([(0, 0), (5, 0), (5, 3), (4, 3), (4, 1), (3, 1), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3), (0, 0)], float)
    teeth = intersection(oriented([comb]), oriented([box(-1, 2, 9)]))
    assert len(teeth) == 3 and area(teeth) == pytest.approx(3)
    # holes of both areas, one of them across the other's border
    both = intersection(oriented([box(0, 0, 10), box(1, 1, 2), box(6, 6, 3)]), oriented([box(2, 0, 10, 10), box(4, 4, 1)]))
    assert area(both) == pytest.approx(80 - 2 - 9 - 1)


def star(radii, x, y, turn):
    n = len(radii)
    ring = [(round(x + r * math.cos(turn + 2 * math.pi * k / n), 6), round(y + r * math.sin(turn + 2 * math.pi * k / n), 6)) for k, r in enumerate(radii)]
    return np.array([*ring, ring[0]])


SHAPE = st.builds(star, st.lists(st.floats(0.2, 1), min_size=4, max_size=14), st.floats(-0.8, 0.8), st.floats(-0.8, 0.8), st.floats(0, 3))
GRID = np.stack(np.meshgrid(np.arange(-2, 2, 0.01) + 0.00371, np.arange(-2, 2, 0.01) + 0.00529), -1).reshape(-1, 2)


@settings(max_examples=80, deadline=None)
@given(SHAPE, SHAPE, st.booleans())
def test_random_areas_against_points(p, q, holed):
    rings = [[p, p[:, :] * 0.3 + p[:-1].mean(0) * 0.7] if holed and planar.inside(p[:-1].mean(0)[None] , sides(p))[0] else [p], [q]]
    if len(rings[0]) == 2 and not (planar.inside(rings[0][1], sides(p)).all() and relation(sides(p), sides(rings[0][1]), False, False)[0] == "F"):
        rings[0] = rings[0][:1]
    a, b = (oriented(r) for r in rings)
    parts = intersection(a, b)
    in_a, in_b = planar.inside(GRID, a), planar.inside(GRID, b)
    got = np.zeros(len(GRID), bool)
    for part in parts:
        got |= planar.inside(GRID, np.concatenate([sides(r) for r in part]))
    assert (got != (in_a & in_b)).sum() <= 2
    m = relation(a, b, True, True)
    deep = lambda x: x.sum() > 60  # noqa: E731  more than a sliver of points
    if deep(in_a & in_b):
        assert m[0] == "T"
    if deep(in_a & ~in_b):
        assert m[2] == "T"
    if deep(~in_a & in_b):
        assert m[6] == "T"
    assert (m[0] == "T") == bool(parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(SHAPE, min_size=2, max_size=2))
def test_an_area_and_what_is_cut_of_it_add_up(shapes):
    a, b = (oriented([s]) for s in shapes)
    frame = oriented([box(-4, -4, 8), shapes[1]])
    assert area(intersection(a, b)) + area(intersection(a, frame)) == pytest.approx(abs(planar.ring_area(shapes[0])), rel=1e-7, abs=1e-7)
