import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from bagweave.operators import learning, scores
from bagweave.operators.statistics import bootstrap_p_value, multinomial, sample
from bagweave.plans import tree as T


def test_propagate_letters(spark):
    """Six letters: of 30 ordered pairs 2 are equal, 18 differ, and 10 hold a sign that is no letter."""
    entities = spark.createDataFrame([(1, i, float(ord(c)) if c.isalpha() else float("nan")) for i, c in enumerate("Hello!")], "bag_id bigint, entity_id bigint, letter double")
    bags = spark.createDataFrame([(1, True)], "bag_id bigint, label boolean")
    split = T.Split(T.difference(T.property_of("letter")), (0, 1), T.Equals(0), T.Leaf(), T.Leaf(), T.Leaf())
    tree = T.numbered(T.Root(T.Var(T.Var(split))))
    rows = T.propagate(tree, bags, entities, keep=2).groupBy("leaf_id").count().collect()
    assert {r[0]: r[1] for r in rows} == {4: 2, 5: 18, 6: 10}


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_binding_counts(spark, n):
    bags = spark.createDataFrame([(1, True)], "bag_id bigint, label boolean")
    entities = spark.createDataFrame([(1, i) for i in range(n)], "bag_id bigint, entity_id bigint")
    rows = bags
    for d in range(3):
        rows = T.bind(rows, T.candidates(entities, None, d), d)
    want = math.prod(max(1, n - d) for d in range(3))
    assert rows.count() == want


def test_participants(spark):
    bags = spark.createDataFrame([(1, True), (2, False)], "bag_id bigint, label boolean")
    entities = spark.createDataFrame([(b, i) for b in (1, 2) for i in range(3)], "bag_id bigint, entity_id bigint")
    pins = spark.createDataFrame([(1, 0, 9)], "bag_id bigint, depth int, entity_id bigint")
    rows = T.bind(bags, T.candidates(entities, pins, 0), 0).collect()
    assert sorted((r.bag_id, r.v0) for r in rows) == [(1, 9), (2, 0), (2, 1), (2, 2)]


def test_greedy_probabilities():
    counts = {((1, 2), False): 3, ((1,), False): 1, ((1,), True): 4, ((2,), True): 1}
    got = scores.greedy_probabilities(counts, [1, 2])
    assert got[1] == (0.5, 10.0, 4, 4)
    assert got[2] == (0.5 * (1 - 1e-6), 3.0, 1, 0)


def walk_sweep(bags, seed_label):
    """Brute force: the first best cut over all edge distances."""
    edges = sorted({d for near, far, _ in bags for d in (near, far)})
    best = (-math.inf, 0.0)
    share = lambda p, n: p / (p + n) if p + n else 0.0
    ll = lambda p, n: (p * math.log(p / (p + n)) if p else 0) + (n * math.log(n / (p + n)) if n else 0)
    for i, d in enumerate(edges):
        count = lambda side: [sum(1 for a, b, x in bags if x == lab and side(a, b)) for lab in (True, False)]
        y, m, n = count(lambda a, b: b <= d), count(lambda a, b: a <= d < b), count(lambda a, b: a > d)
        hot = share(y[0] + m[0], y[1] + m[1]) > share(n[0] + m[0], n[1] + m[1])
        if hot != seed_label:
            continue
        yes, no = ([y[k] + m[k] for k in (0, 1)], n) if hot else (y, [n[k] + m[k] for k in (0, 1)])
        score = ll(*yes) + ll(*no)
        if score > best[0] + 1e-9:
            best = (score, (d + edges[i + 1]) / 2 if i + 1 < len(edges) else d)
    return best


def test_threshold_sweep_against_walk(spark):
    rng, rows, want = random.Random(4), [], {}
    for case in range(40):
        bags = []
        for b in range(rng.randint(1, 7)):
            a, c = sorted((rng.randint(0, 5), rng.randint(0, 5)))
            bags.append((float(a), float(c), rng.random() < 0.5))
            rows.append((case, b, bags[-1][2], float(a), float(c)))
        want[case] = walk_sweep(bags, True)
    df = spark.createDataFrame(rows, "case int, bag_id int, label boolean, near double, far double")
    got = {r["case"]: (r["score"], r["threshold"]) for r in scores.best_threshold(df, F.lit(True), ("case",)).collect()}
    for case, (score, threshold) in want.items():
        assert got[case] == (pytest.approx(score), pytest.approx(threshold))


def test_tree_algebra():
    tree = T.numbered(T.Root(T.Var(T.Split(T.valid(1), (0,), T.Equals(1), T.Leaf(), T.Leaf(), T.Leaf()))))
    assert [n.id for n in T.walk(tree)] == list(range(6))
    assert T.depth_of(tree, 3) == 1 and T.find(tree, 4).probability == 0.5
    assert '"predicate"' in T.to_json(tree)


def test_expansions():
    found = learning.expansions(0, [T.property_of("a"), T.difference(T.property_of("a"))])
    assert [(n, i) for n, _, i in found] == [(1, (0,)), (2, (0, 1))]


def test_significance_and_sampling(spark):
    assert bootstrap_p_value([(0, 50, 0.9), (50, 0, 0.1)], [(50, 50, 0.5)]) < 0.01
    assert multinomial(1000, (0.2, 0.1, 0.4, 0.3), 2000).mean(0) == pytest.approx([200, 100, 400, 300], rel=0.03)
    assert sample(spark.range(4000), "binomial", (1000, 0.3)).agg(F.avg("sample")).first()[0] == pytest.approx(300, rel=0.02)


def test_search():
    assert learning.best_first_search([1], lambda x: -abs(x - 10), lambda x: [x + 1] if x < 20 else []) == 10


def test_learner_finds_the_rule(spark):
    rng = random.Random(1)
    bags = [(b, b % 2 == 0) for b in range(90)]
    entities = [(b, b * 10 + i, 5.0 + rng.random() if label and i == 0 else rng.random()) for b, label in bags for i in range(2)]
    tree = learning.learn(spark.createDataFrame(bags, "bag_id bigint, label boolean"), spark.createDataFrame(entities, "bag_id bigint, entity_id bigint, x double"), learning.Config((T.property_of("x"),), max_rounds=1, seed_bags=3))
    best = max(T.leaves(tree), key=lambda x: x.probability)
    assert best.probability > 0.9 and len(list(itertools.islice(T.walk(tree), 10))) == 6


def test_learner_goes_on_until_no_expansion_is_accepted(spark, monkeypatch):
    """Ten expansions are significant, the eleventh is not; the other steps are stubs."""
    calls = itertools.count()
    monkeypatch.setattr(learning, "bootstrap_p_value", lambda *_: 0.01 if next(calls) < 10 else 1.0)
    monkeypatch.setattr(learning, "fit_leaves", lambda root, *_: (root, {}))
    monkeypatch.setattr(learning.S, "best_leaf", lambda counts, probabilities, ids: ids[-1])
    monkeypatch.setattr(learning.S, "signatures", lambda _: {})
    monkeypatch.setattr(learning.T, "propagate", lambda *_: None)
    monkeypatch.setattr(learning, "expansions", lambda depth, functions: [(0, functions[0], (0,))])
    monkeypatch.setattr(learning, "_points_at", lambda *_: None)
    monkeypatch.setattr(learning, "materialize", lambda x: x)
    monkeypatch.setattr(learning, "discard", lambda _: None)
    monkeypatch.setattr(learning, "seed_search", lambda *_: ((0.0,), 1.0, 0.0))
    bags = spark.createDataFrame([(b, b % 2 == 0) for b in range(30)], "bag_id bigint, label boolean")
    tree = learning.learn(bags, None, learning.Config((T.property_of("x"),)))
    assert sum(isinstance(n, T.Split) for n in T.walk(tree)) == 10 and next(calls) == 11


def test_packed_bags_are_bound_without_shuffles(spark):
    """The same sets of leaves and points as with joins, for a tree with variables in two branches."""
    rng = random.Random(4)
    bags = spark.createDataFrame([(b, b % 3 == 0) for b in range(40)] + [(99, True)], "bag_id bigint, label boolean")
    entities = spark.createDataFrame([(b, i, None if rng.random() < 0.1 else float(rng.randrange(5))) for b in range(40) for i in range(b % 5)], "bag_id bigint, entity_id bigint, x double")
    pins = spark.createDataFrame([(4, 0, 2), (9, 1, 3), (9, 0, 77)], "bag_id bigint, depth int, entity_id bigint")
    f, g = T.property_of("x"), T.distance(T.property_of("x"))
    below = [T.Var(T.Split(h, (0, 1), T.DistanceThreshold((c,), 1.0), T.Leaf(), T.Leaf(), T.Leaf())) for h, c in ((g, 0.0), (T.valid(2), 1.0))]
    tree = T.numbered(T.Root(T.Var(T.Split(f, (0,), T.DistanceThreshold((1.0,), 1.0), *below, T.Leaf()))))
    for participants in (None, pins):
        packed = learning.materialize(T.packed(bags, entities, participants, ("x",)).withColumn("row", F.monotonically_increasing_id()))
        rows = T.propagate(tree, packed, entities, participants)
        assert scores.signatures(rows) == scores.signatures(T.propagate(tree, bags, entities, participants))
        assert not any(x in rows._jdf.queryExecution().executedPlan().toString() for x in ("Join", "Exchange"))
        for leaf in T.leaves(tree)[:1]:
            for new, function in ((0, f), (1, g)):
                of = (new, function, (0,) if function is f else (0, T.depth_of(tree, leaf.id)))
                want = {(r.bag_id, tuple(r.point)) for r in learning._points_at(tree, leaf.id, of, bags, entities, participants).collect() if r.point[0] == r.point[0] and r.point[0] is not None}
                got = [(r.bag_id, tuple(p)) for r in learning._points_at(tree, leaf.id, of, packed, entities, participants).collect() for p in r.points]
                assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_seeds_are_swept_as_by_windows(spark, monkeypatch, most):
    monkeypatch.setattr(learning, "DRIVER_EDGES", most)
    rng = random.Random(5)
    rows = [(b, b % 2 == 0, [float(rng.randrange(8)), float("nan") if rng.random() < 0.1 else rng.random()]) for b in range(60) for _ in range(4)]
    points = spark.createDataFrame(rows, "bag_id bigint, label boolean, point array<double>")
    center = (1.0, 0.5)
    best = scores.best_threshold(scores.near_far(points, F.array(*map(F.lit, center))), F.lit(True)).first()
    assert learning._swept(learning._by_bag(points), [center, (40.0, 0.0)])[0] == (pytest.approx(best["score"]), pytest.approx(best["threshold"]))
