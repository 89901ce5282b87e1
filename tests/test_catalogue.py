"""Queries that must cover whole tables."""

import numpy as np
import pytest

from bagweave import catalogue
from bagweave.session import read_table

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("how", "of"), [("min", np.min), ("max", np.max), ("mean", np.mean)])
def test_vectors_are_aggregated_in_all_dimensions(spark, how, of):
    x = np.array([r[0] for r in read_table(spark, DATA, "embeddings").select("embedding").collect()], float)
    got = {r.dim: r.x for r in catalogue.queries()[f"vec_{how}_all"](spark, DATA).collect()}
    assert x.shape[1] == 64 and got == {i: pytest.approx(v, abs=1e-5) for i, v in enumerate(of(x, axis=0))}
