"""Fills against plain loops, and no frame to the end of a partition: Spark walks one anew for each row, so it takes quadratic time."""

import random

import pytest

from plumbline.operators import impute


def plain(rows, method):
    """Values of (r, v) pairs in order of r, gaps filled."""
    v = [x for _, x in sorted(rows)]
    at = [i for i, x in enumerate(v) if x is not None]
    out = []
    for i, x in enumerate(v):
        p, n = max((j for j in at if j <= i), default=None), min((j for j in at if j >= i), default=None)
        if method == "bfill":
            out.append(None if n is None else v[n])
        elif p is None or n is None:
            out.append(None if p == n else v[n if p is None else p])
        else:
            out.append(x if p == n else v[p] + (v[n] - v[p]) * (i - p) / (n - p))
    return out


@pytest.mark.parametrize("method", ["bfill", "interpolate"])
@pytest.mark.parametrize("by", [None, ["k"]])
def test_no_frame_to_the_end(spark, method, by):
    rnd = random.Random(8)
    rows = [(r, r * r % 3, None if rnd.random() < 0.4 or not 20 < r < 380 else float(rnd.randint(0, 99))) for r in rnd.sample(range(1000), 400)]
    out = impute.fill(spark.createDataFrame(rows, "r long, k long, v double").repartition(5), "v", method, order="r", by=by)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    got = [(x["k"], x["v"]) for x in out.orderBy("r").collect()]
    for k in {k for _, k, _ in rows} if by else {None}:
        want = plain([(r, v) for r, g, v in rows if k in (None, g)], method)
        have = [v for g, v in got if k in (None, g)]
        assert len(have) == len(want) and all(a == b or None not in (a, b) and abs(a - b) < 1e-9 for a, b in zip(have, want))
