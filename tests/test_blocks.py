"""Arrow kernels: ragged and missing vectors, centres without numbers, blocks by checked size."""

import numpy as np
import pyarrow as pa
import pytest

from tidepool.operators import assign
from tidepool.operators.blocks import nearest_index, read_blocks, vector_matrix
from tidepool.session import Limits, width_of


def test_ragged_vectors_are_an_error():
    with pytest.raises(ValueError):
        vector_matrix(pa.array([[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]))
    with pytest.raises(ValueError):
        vector_matrix(pa.array([[1.0, 2.0]]), 3)
    got = vector_matrix(pa.array([[1.0, 2.0], None, [3.0, 4.0]]).slice(1), 2)
    assert np.isnan(got[0]).all() and got[1].tolist() == [3.0, 4.0]


@pytest.mark.parametrize("d", [2, 20])
def test_centres_without_numbers_are_far(d):
    x, c = np.zeros((2, d)), np.stack([np.full(d, np.nan), np.ones(d), np.full(d, 2.0)])
    idx, best = nearest_index(x, c)
    assert idx.tolist() == [1, 1] and best == pytest.approx([d, d])
    assert np.isinf(nearest_index(x, c[:1])[1]).all()


def test_inline_and_block_ways_agree_on_a_null_centre(spark):
    points = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 5.0]), (2, None)], "id long, x array<double>")
    centres = spark.createDataFrame([(0, [0.0, 1.0]), (1, None), (2, [5.0, 4.0])], "mc_id long, centre array<double>")
    ways = [{r["id"]: r["mc_id"] for r in assign.assign_nearest(points, centres, limits=limits).collect()}
            for limits in (Limits(), Limits(inline_terms=0), Limits(inline_terms=0, block_rows=2))]
    assert ways[0] == ways[1] == ways[2] == {0: 0, 1: 2, 2: -1}


def test_blocks_cover_the_model_and_leave_nothing_cached(spark):
    model = spark.range(500).selectExpr("id", "array(id * 1.0D, 2.0D) AS v")
    for limits in (Limits(), Limits(block_rows=50), Limits(block_bytes=2000)):
        blocks = list(read_blocks(model, "id", limits))
        assert sorted(np.concatenate([b["id"] for b in blocks]).tolist()) == list(range(500))
        assert all(len(b) <= limits.block_rows for b in blocks)
    next(read_blocks(model, "id", Limits(block_rows=50))).columns
    assert not model.storageLevel.useMemory


def test_width_is_checked(spark):
    rows = "x array<double>"
    assert width_of(spark.createDataFrame([([1.0, 2.0],), (None,)], rows)) == 2 and width_of(spark.createDataFrame([], rows)) == 0
    with pytest.raises(ValueError):
        width_of(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], rows))
