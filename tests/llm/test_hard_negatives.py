"""Hard negatives against exhaustive search on odd vectors; the query has SQL."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftwise.llm.hard_negatives import Block, Mining, _best_in_windows, _best_of_label, mine

SCHEMA = "vec_id bigint, label int, embedding array<float>, ids string, anchors string, place string, key string"


def brute(rows, dim, every):
    fine = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows
            if i is not None and y is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in {x[0]: x for x in sorted(fine, reverse=True) if x[0] % every == 0}.values():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in fine if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            inside = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(inside)]
    return sorted(out)


def odd(rng, n, dim):
    """Clusters, ties, repeated rows and ids, nulls, zeros and values that aren't finite."""
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(i, rng.randrange(3), [round(x + rng.gauss(0, 0.3), 1) for x in rng.choice(centres)]) for i in range(n)]
    rows += [(n, None, rows[0][2]), (n + 1, 1, None), (n + 2, 1, [None] + rows[0][2][1:]), (n + 3, 1, [math.nan] * dim), (n + 4, 0, [math.inf] * dim), (None, 1, rows[1][2]), (n + 5, 2, [0.0] * dim),
             (n + 6, 2, [1.0]), *rows[:4], (0, 2, rows[5][2]), (n + 10, 1, rows[3][2]), (n + 11, 0, rows[3][2])]
    return rows


@pytest.mark.parametrize("block, anchors", [(4096, 4096), (16, 8)])
def test_odd_vectors(spark, block, anchors):
    rows = odd(random.Random(block), 150, 8)
    df = spark.createDataFrame([(*r, "?", "?", "?", "?") for r in rows], SCHEMA).repartition(3)
    mining = Mining(dim=8, block=block, anchors=anchors)
    assert sorted(map(tuple, mine(df, F.col("vec_id") % 5 == 0, mining).collect())) == brute(rows, 8, 5)
    assert mine(df.limit(0), F.col("vec_id") % 5 == 0, mining).count() == 0


def test_scan_drops_rows_early():
    """The bitmap shrinks before all dimensions are read, and the result is exact."""
    rng = np.random.default_rng(1)
    values = rng.integers(-60, 60, (400, 64)) * np.where(np.arange(64) < 8, 40, 1)
    labels = rng.integers(0, 2, 400)
    block = Block({"ids": list(range(400)), "labels": labels.tolist(), "dims": [np.ascontiguousarray(values[:, d], dtype=np.int64).tobytes() for d in range(64)]})
    read = []
    scan = block.scan

    def counted(anchor, rows, narrow):
        def told(least, most):
            read.append(len(least))
            return narrow(least, most)
        return scan(anchor, rows, told)
    block.scan = counted
    anchor = values[0]
    scores = values @ anchor
    best = sorted((-int(scores[i]), i) for i in range(1, 400) if labels[i] == labels[0])[:5]
    assert _best_of_label(block, anchor, 0, int(labels[0]), 5) == [(i, -s) for s, i in best]
    assert read[1] < read[0] / 4
    windows = [(int(np.percentile(scores, a)), int(np.percentile(scores, b))) for a, b in ((90, 95), (10, 12), (99, 99))]
    for (low, high), found in itertools.zip_longest(windows, _best_in_windows(block, anchor, int(labels[0]), windows, 3)):
        inside = sorted((-int(scores[i]), i) for i in range(400) if labels[i] != labels[0] and low <= scores[i] <= high)[:3]
        assert found == [(i, -s) for s, i in inside]
