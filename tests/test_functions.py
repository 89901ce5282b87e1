import math

import pytest
from pyspark.sql import functions as F

from bagweave.functions import vectors as V

REFRAME_2D = [
    ((0, 0), (1, 1), (0, 1), (0.5, 0.5)),
    ((1, 1), (2, 2), (1, 2), (0.5, 0.5)),
    ((2, 2), (1, 1), (1, 2), (0.5, -0.5)),
    ((0, 0), (2, 1), (0, 1), (0.2, 0.4)),
    ((0, 0), (1, 2), (0, 1), (0.4, 0.2)),
    ((0, 0), (1, 0), (0, 1), (0, 1)),
    ((1, 0), (0, 0), (0, 1), (1, -1)),
    ((0, 0), (2, 0), (0, 1), (0, 0.5)),
    ((0, 0), (0, 1), (0, 1), (1, 0)),
    ((0, 0), (0, 0.9), (0, 1), (1.111111, 0)),
    ((0, 0), (0, 1), (-0.1, 0.9), (0.9, 0.1)),
]
REFRAME_3D = [
    ((0, 0, 0), (1, 1, 1), (1, 1, 0), (0.666667, 0, -0.471405)),
    ((0, 0, 0), (1, 1, 1), (1, 1, 1), (1, 0, 0)),
    ((0, 0, 0), (1, 1, 1), (0, 0, 1), (0.333333, 0, 0.471405)),
    ((0, 0, 0), (1, 1, 1), (1, 0, 0), (0.333333, -0.408248, -0.235702)),
]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


@pytest.mark.parametrize("case", REFRAME_2D + REFRAME_3D)
def test_reframe(spark, case):
    origin, target, point, want = case
    got = value(spark, V.reframe(vec(*origin), vec(*target), vec(*point), dims=len(origin)))
    assert got == pytest.approx(want, abs=1e-6)


def test_degenerate_frame_holds_nan(spark):
    assert any(map(math.isnan, value(spark, V.reframe(vec(0, 0), vec(0, 0), vec(0, 1)))))


@pytest.mark.parametrize(("angle", "want"), [(2 * math.pi - 0.02, -0.02), (-math.pi, -math.pi), (math.pi, math.pi), (-math.pi / 4, -math.pi / 4)])
def test_wrap(spark, angle, want):
    assert value(spark, V.wrap_radians(F.lit(angle))) == pytest.approx(want)


def test_permutations():
    rows = list(V.permutations(4, 2))
    assert len(rows) == 12 and rows == sorted(rows)
    with pytest.raises(ValueError):
        V.permutations(2, 3)


def test_division_as_floating_point(spark):
    assert math.isnan(value(spark, V.divide(F.lit(0.0), F.lit(0.0))))
    assert value(spark, V.divide(F.lit(-1.0), F.lit(0.0))) == -math.inf


def test_lists(spark):
    assert value(spark, V.removed_at(vec(1, 2, 3), 1)) == [1, 3]
    assert value(spark, V.put_at(vec(1, 2, 3), 0, F.lit(9.0))) == [9, 2, 3]
    assert value(spark, V.without_suffix(F.lit("a.json"))) == "a"
    assert value(spark, V.pinned(F.lit(5), F.array(F.lit(1)), F.array(F.lit(5)))) == 1
