"""Objects of masks against a flood fill."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from evalframe.operators import graph as G
from evalframe.operators import objects as O

MASK = "image_id long, row_px long, col_px int, class_index int"


def flood(cells, connectivity, width):
    """(object, at edge) of each cell of one image, one cell at a time."""
    around = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r or c) and (connectivity == 8 or not (r and c))]
    found = {}
    for start in sorted(cells):
        if start in found:
            continue
        found[start], stack = start, [start]
        while stack:
            r, c = stack.pop()
            for dr, dc in around:
                to = (r + dr, c + dc)
                if to not in found and cells.get(to) == cells[start]:
                    found[to] = start
                    stack.append(to)
    span = range(-width, width + 1)
    return {(r, c): (found[r, c], any(cells.get((r + i, c + j), k) != k for i in span for j in span)) for (r, c), k in cells.items()}


def masks(rng):
    """A noisy image with gaps, a spiral that winds through all tiles, one even image at negative places, and one pixel."""
    noisy = {(r, c): rng.choice([0, 0, 1, 2]) for r in range(40) for c in range(33) if rng.random() < 0.9}
    spiral, at, step, ends = {}, [0, 0], (0, 1), (0, 0, 36, 36)
    grid = np.zeros((37, 37), int)
    while True:
        grid[tuple(at)] = 1
        ahead = lambda n: (at[0] + n * step[0], at[1] + n * step[1])
        free = lambda p: all(0 <= x <= 36 for x in p) and not grid[p]
        if not free(ahead(1)) or (all(0 <= x <= 36 for x in ahead(2)) and grid[ahead(2)]):
            step = (step[1], -step[0])
            if not free(ahead(1)) or (all(0 <= x <= 36 for x in ahead(2)) and grid[ahead(2)]):
                break
        at = list(ahead(1))
    spiral = {(r, c): int(grid[r, c]) for r in range(37) for c in range(37)}
    return {1: noisy, 2: spiral, 3: {(r, c): 5 for r in range(-20, 20) for c in range(-3, 25)}, 4: {(1000, 7): 1}}


@pytest.mark.parametrize("connectivity,width,tile", [(8, 1, 8), (4, 2, 7), (8, 3, 256)])
def test_labels_equal_a_flood_fill(spark, connectivity, width, tile):
    images = masks(random.Random(6))
    rows = [(i, r, c, k) for i, cells in images.items() for (r, c), k in cells.items()]
    df = spark.createDataFrame([*rows, (None, 1, 1, 1), (1, None, 1, 1), (1, 500, 500, None)], MASK).withColumns({n: O.F.lit(3) for n in ("key", "tile_row", "own", "object_row")})
    got = {(r.image_id, r.row_px, r.col_px): ((r.object_row, r.object_col), r.at_edge) for r in O.label_objects(df, connectivity=connectivity, width=width, tile=tile).collect()}
    want = {(i, *p): x for i, cells in images.items() for p, x in flood(cells, connectivity, width).items()}
    assert got == want
    assert len({x for (i, _, _), (x, _) in got.items() if i == 2}) == 2  # the spiral and what is around it


def test_table_and_failures(spark):
    images = {1: {(r, c): int(3 <= r < 6 and 3 <= c < 6) * 2 for r in range(20) for c in range(20)}, 2: {(0, c): 0 for c in range(9)}}
    rows = [(i, r, c, k) for i, cells in images.items() for (r, c), k in cells.items()]
    wrong = [(i, r, c, (r, c) in ((3, 3), (3, 4), (4, 4), (5, 5), (3, 5), (19, 19)) and i == 1) for i, r, c, _ in rows]
    labelled = O.label_objects(spark.createDataFrame(rows, MASK), tile=4)
    table = O.object_table(labelled, spark.createDataFrame(wrong, "image_id long, row_px long, col_px long, wrong boolean"))
    got = {(r.image_id, r.object_row, r.object_col): r.asDict() for r in table.collect()}
    small = got[1, 3, 3]
    assert (small["pixels"], small["wrong_pixels"], small["edge_pixels"], small["edge_errors"]) == (9, 5, 8, 4)
    assert [small[c] for c in ("first_row", "last_row", "first_col", "last_col")] == [3, 5, 3, 5]
    assert got[1, 0, 0]["pixels"] == 391 and got[1, 0, 0]["edge_pixels"] == 16 and len(got) == 3
    out = {r.image_id: r for r in O.spatial_failures(table).collect()}
    assert (out[1].errors, out[1].edge_errors, out[1].small_objects, out[1].small_failures, out[1].categories) == (6, 4, 1, 1, ["edge_error", "small_object_failure"])
    assert (out[2].errors, out[2].small_objects, out[2].categories) == (0, 0, [])
    assert O.label_objects(spark.createDataFrame([], MASK)).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 2000 + i) for i in range(300)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = [tuple(r) for r in G.connected_components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")).collect()]
    assert dict(got) == {x: find(x) for x in root} and len(got) == len(root)
    assert max(Counter(c for _, c in got).values()) == 301
    chain = O.components_of(5000, np.arange(4999), np.arange(1, 5000))
    assert not chain.any() and O.components_of(3, np.zeros(0, int), np.zeros(0, int)).tolist() == [0, 1, 2]
    with pytest.raises(RuntimeError, match="did not settle"):
        G.connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"), rounds=1)
