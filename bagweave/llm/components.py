"""Connected components by random-mate contraction, as SQL joins over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagweave.session import discard, materialize


#: Rounds of contraction that one plan unwinds.
UNWIND = 3


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in list(up)]
    hooks = [r for r in rows if r[0] != r[1]]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in hooks], pa.int64()) for i in (0, 1)], ["u", "to"])


def random_mate(edges: DataFrame, seed: int = 17, finish_edges: int = 0) -> DataFrame:
    """(v, root) for every vertex that has an edge to another vertex; root is one vertex of v's component.

    edges: u bigint, v bigint. Each round tosses a coin for every vertex; a vertex with tails that has a neighbour with
    heads collapses into the smallest of them; the edges are relabelled, loops and repeats vanish. About a quarter or
    more of the vertices go in each round, until no edge is left. The labels are then unwound, last round first. A hub
    keeps its rows apart by Spark's skew join, and its neighbours are combined before the shuffle.

    finish_edges: when at most so many edges are left, one task contracts these at once (a bound on its input).
    """
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    left = materialize(edges.where("u <> v").select(*pair).distinct())
    hooks, n = [], 0
    while not left.isEmpty():
        if finish_edges and left.count() <= finish_edges:
            hooks.append(materialize(left.select("u", "v").coalesce(1).mapInArrow(_union_find, "u bigint, to bigint")))
            break
        coin = lambda c, n=n: F.expr(f"pmod(xxhash64({c}, {n}, {seed}), 2)")
        # each edge says both ways who may collapse into whom; one of them at most is a tail that sees a head
        hook = F.when((coin("u") == 0) & (coin("v") == 1), F.struct("u", F.col("v").alias("to"))).when((coin("v") == 0) & (coin("u") == 1), F.struct(F.col("v").alias("u"), F.col("u").alias("to")))
        hook = materialize(left.select(hook.alias("h")).where("h is not null").groupBy("h.u").agg(F.min("h.to").alias("to")))
        a, b = (hook.select(F.col("u").alias(k), F.col("to").alias(f"{k}_to")) for k in ("a", "b"))
        moved = left.join(a, F.col("u") == F.col("a"), "left").join(b, F.col("v") == F.col("b"), "left").select(F.coalesce("a_to", "u").alias("u"), F.coalesce("b_to", "v").alias("v"))
        after = materialize(moved.where("u <> v").select(*pair).distinct())
        discard(left)
        hooks.append(hook)
        left, n = after, n + 1
    discard(left)
    if not hooks:
        return edges.sparkSession.createDataFrame([], "v bigint, root bigint")
    labels, written, open_ = None, None, []
    for k, hook in enumerate(reversed(hooks)):
        open_.append(hook)
        if labels is None:
            labels = hook.select(F.col("u").alias("v"), F.col("to").alias("root"))
        else:
            old = labels.select(F.col("v").alias("w"), F.col("root").alias("w_root"))
            own = hook.join(old, F.col("to") == F.col("w"), "left").select(F.col("u").alias("v"), F.coalesce("w_root", "to").alias("root"))
            labels = own.unionByName(labels)
        # some rounds are unwound by one plan, whose size stays bounded
        if (k + 1) % UNWIND == 0 or k + 1 == len(hooks):
            labels = materialize(labels)
            for table in (*open_, written):
                discard(table)
            written, open_ = labels, []
    roots = labels.select(F.col("root").alias("v"), "root").distinct()
    return labels.unionByName(roots)
