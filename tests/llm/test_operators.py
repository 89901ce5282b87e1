"""The operators on small fixtures, against brute force, exact round trips and counts."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bagweave.llm import clusters, components, leakage, packing, runs, splits, splitting, tokens, vectors

VEC = "feature_id bigint, feature array<double>, cell string, vec string"


def unit_rows(n, dim, seed, spread=0.01):
    rng = np.random.default_rng(seed)
    centres = np.abs(rng.normal(size=(max(1, n // 6), dim)))
    x = centres[rng.integers(0, len(centres), n)] + np.abs(rng.normal(size=(n, dim))) * spread
    return np.round(x / np.linalg.norm(x, axis=1, keepdims=True) * 400)


@pytest.mark.parametrize(("block", "split"), [(65_536, 1600), (20, 1600), (65_536, 30)])
def test_pairs_against_brute_force(spark, monkeypatch, block, split):
    """Also with groups in blocks, and with cells that are divided further."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "SPLIT_ROWS", split)
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    x = unit_rows(600, 16, 1)
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist(), "a", "b") for i, v in enumerate(x)]
    bad = [(900, None, "a", "b"), (901, [1.0] * 5, "a", "b"), (902, [0.0] * 16, "a", "b"), (903, [float("nan")] * 16, "a", "b"), (None, [1.0] * 16, "a", "b")]
    df = spark.createDataFrame(rows + rows[:5] + bad, VEC)
    got = {(r.a, r.b) for r in vectors.similar_pairs(df, "feature_id", "feature", 16, 10, 0.05).collect()}
    u = vectors.unit(x)
    d = np.linalg.norm(u[:, None] - u[None], axis=2)
    np.fill_diagonal(d, 9)
    rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1, kind="stable")
    want = {(min(i, j), max(i, j)) for i, j in zip(*np.nonzero((d <= 0.05) & (rank < 10)), strict=True)}
    assert len(want) > 100 and got <= want | {(min(i, j), max(i, j)) for i, j in zip(*np.nonzero(d <= 0.05), strict=True)}
    assert len(want & got) >= 0.99 * len(want)
    assert vectors.similar_pairs(df.limit(0), "feature_id", "feature", 16, 10, 0.05).count() == 0


def test_nearest_recall(spark):
    x = unit_rows(1200, 16, 2, spread=0.3)
    df = spark.createDataFrame([(i, v.tolist(), "", "") for i, v in enumerate(x)], VEC)
    got = {}
    for r in vectors.nearest(df, "feature_id", "feature", 16, k=10, probes=3, query_every=5).collect():
        got.setdefault(r.id, set()).add(r.other)
    u = vectors.unit(x)
    hits = 0
    for i in range(0, len(x), 5):
        d = np.linalg.norm(u - u[i], axis=1)
        d[i] = 9
        hits += len(got[i] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(got) and len(got) == 240


def test_nearest_recall_with_many_cells(spark, monkeypatch):
    """Rows without clear neighbours in 100 cells, of which the default must search enough."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    x = np.round(np.abs(np.random.default_rng(4).normal(size=(4000, 32))) * 100) + 1
    df = spark.createDataFrame([(i, v.tolist(), "", "") for i, v in enumerate(x)], VEC)
    assert len(vectors.train_index(df, "feature_id", "feature", 32).centres) == 100
    u, recall = vectors.unit(x), {}
    for probes in (None, 8):
        got = {}
        for r in vectors.nearest(df, "feature_id", "feature", 32, k=10, probes=probes, query_every=20).collect():
            got.setdefault(r.id, set()).add(r.other)
        hits = 0
        for i in range(0, len(x), 20):
            d = np.linalg.norm(u - u[i], axis=1)
            d[i] = 9
            hits += len(got[i] & set(np.argsort(d)[:10].tolist()))
        recall[probes] = hits / 2000
    assert recall[None] >= 0.9 > recall[8]


def test_scan_is_within_its_bound():
    """Four-bit codes, two a byte, and 16-bit tables give the scores of the codewords."""
    x = vectors.unit(np.abs(np.random.default_rng(0).normal(size=(500, 37)))).astype(np.float32)
    index = vectors.Index.train(x.astype(float), 500)
    own = vectors._nearest_centre(x, index.centres)
    codes = index.encode(x, x - index.centres[own])
    packed = vectors.pack_codes(codes)
    assert packed.shape == (500, 10) and (vectors.unpack_codes(packed, 19).T == codes).all()
    tables = vectors._Tables(x[:40], index.books)
    sums = tables.scan(vectors.unpack_codes(packed, 19))
    true = index.decode(codes) @ x[:40].T - tables.base - tables.step * sums
    assert sums.dtype == np.uint16 and true.min() >= -1e-5 and true.max() <= tables.slop + 1e-5


def test_quantisation_favours_parallel_error():
    x = vectors.unit(np.abs(np.random.default_rng(0).normal(size=(3000, 64)))).astype(np.float32)
    index = vectors.Index.train(x.astype(float), 3000)
    own = vectors._nearest_centre(x, index.centres)
    error = x - (index.decode(index.encode(x, x - index.centres[own])) + index.centres[own])
    parallel = np.abs((error * x).sum(1)).mean()
    index.eta = 1.0
    plain = x - (index.decode(index.encode(x, x - index.centres[own])) + index.centres[own])
    assert parallel < 0.8 * np.abs((plain * x).sum(1)).mean()


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000, i) for i in range(1001, 1300)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    for finish in (0, 100):
        got = {r.v: r.root for r in components.random_mate(df, finish_edges=finish).collect()}
        assert set(got) == {x for e in edges if e[0] != e[1] for x in e}
        for a, b in itertools.combinations(list(got)[:200], 2):
            assert (got[a] == got[b]) == (find(a) == find(b))
    assert components.random_mate(df.limit(0)).count() == 0


BAGS = "bag_id bigint, label boolean, list_bag_id bigint, source string"
ENTITIES = "bag_id bigint, entity_id bigint, source string"


def test_related_bags(spark):
    bags = [(1, True, None, "s"), (2, None, None, None), (3, False, None, "s"), (4, True, 3, "s"), (5, True, None, "s"), (6, True, 5, "s"), (1, True, None, "s"), (None, True, None, "s"), (8, True, 99, "s")]
    entities = [(1, 7, ""), (2, 7, ""), (2, 8, ""), (3, 9, ""), (5, 0, ""), (99, 9, ""), (99, 8, ""), (None, 7, ""), (3, None, ""), (1, 7, "")]
    found = splits.related_bags(spark.createDataFrame(bags, BAGS), spark.createDataFrame(entities, ENTITIES))
    assert {(r.bag_id, r.group_id) for r in found.collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)}
    dealt = splits.grouped_splits(spark.createDataFrame(bags, BAGS), spark.createDataFrame(entities, ENTITIES)).collect()
    of = {r.bag_id: r.split for r in dealt}
    assert set(of) == {1, 2, 3, 4, 5, 6, 8} and of[1] == of[2] and of[3] == of[4] and of[5] == of[6] and len(dealt) == 7


def test_split_shares(spark):
    bags = spark.range(4000).select(F.col("id").alias("bag_id"), (F.col("id") % 3 == 0).alias("label"), F.lit(None).cast("bigint").alias("list_bag_id"), F.lit("").alias("source"))
    entities = spark.range(4000).select(F.col("id").alias("bag_id"), F.when(F.col("id") < 1300, 1).otherwise((F.col("id") / 2).cast("bigint") + 5000).alias("entity_id"), F.lit("").alias("source"))
    rows = splits.grouped_splits(bags, entities).groupBy("split").agg(F.count("*").alias("n")).collect()
    shares = {r["split"]: r["n"] / 4000 for r in rows}
    assert shares == {"train": pytest.approx(0.8, abs=0.03), "validation": pytest.approx(0.1, abs=0.03), "test": pytest.approx(0.1, abs=0.03)}


def brute_clusters(x, radius, least):
    left, out = set(range(len(x))), set()
    d = np.linalg.norm(x[:, None] - x[None], axis=2) <= radius
    while left:
        part, front = set(), {left.pop()}
        while front:
            part |= front
            front = {int(j) for i in front for j in np.flatnonzero(d[i])} & left
            left -= front
        if len(part) >= least:
            out |= {(i, min(part)) for i in part}
    return out


def test_vector_clusters(spark):
    x = unit_rows(400, 32, 5, spread=0.15)
    df = spark.createDataFrame([(i, v.tolist(), "", "") for i, v in enumerate(x)] + [(0, x[0].tolist(), "", ""), (None, [1.0] * 32, "", ""), (999, None, "", "")], VEC)
    links, parts = clusters.vector_links(df, "feature_id", "feature", 32, 0.3)
    want = brute_clusters(vectors.unit(x), 0.3, 4)
    got = {(r.rec_id, r.cluster_id) for r in clusters.clusters_of(parts, 4).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    medoids = clusters.split_loose(links, clusters.clusters_of(parts, 4)).collect()
    assert len(medoids) == len(got) and {m.rec_id for m in medoids} == {g[0] for g in got}


@pytest.mark.parametrize("distance", [0.3, 0.45])
def test_links_within_a_group_are_found(distance):
    """Recall of single pairs at just below the distance, by bands alone; unlike pairs are never joined."""
    rng = np.random.default_rng(1)
    x = vectors.unit(np.abs(rng.normal(size=(800, 128)) ** 3))
    step = rng.normal(size=x.shape) * x.mean()
    step -= (step * x).sum(1, keepdims=True) * x
    angle = 2 * np.arcsin(distance * 0.99 / 2)
    y = x * np.cos(angle) + vectors.unit(step) * np.sin(angle)
    both = np.concatenate([x, y]).astype(np.float32)
    label = clusters.group_components(both, np.ones(1600, bool), distance)
    assert (label[800:] == label[:800]).mean() >= (0.95 if distance < 0.4 else 0.7)
    near = np.sqrt(np.maximum(0, 2 - 2 * both @ both.T)) <= distance + 1e-3
    assert all(near[i, label == label[i]].sum() > 1 for i in range(0, 1600, 50) if (label == label[i]).sum() > 1)


def test_alike_rows_in_a_bucket_with_an_unlike_smallest_one(spark, monkeypatch):
    """All rows share one bucket, whose smallest id is like none of them."""
    monkeypatch.setattr(clusters, "band_key", lambda hashes, chosen: np.zeros(hashes.shape[1], np.uint64))
    x = np.eye(8, dtype=np.float32)[[0, 1, 1, 1, 2, 2, 3]]
    assert clusters.group_components(x, np.ones(7, bool), 0.3).tolist() == [0, 1, 1, 1, 4, 4, 6]
    # guests are compared with rows at home only
    assert clusters.group_components(x, np.arange(7) == 1, 0.3).tolist() == [0, 1, 1, 1, 4, 5, 6]


@pytest.mark.parametrize("block", [100_000, 40])
def test_groups_and_blocks_join_up(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "GROUP_ROWS", 60)
    monkeypatch.setattr(clusters, "BLOCK_ROWS", block)
    x = unit_rows(500, 32, 6, spread=0.15)
    df = spark.createDataFrame([(i, v.tolist(), "", "") for i, v in enumerate(x)], VEC)
    _, parts = clusters.vector_links(df, "feature_id", "feature", 32, 0.3)
    want = brute_clusters(vectors.unit(x), 0.3, 4)
    got = {(r.rec_id, r.cluster_id) for r in clusters.clusters_of(parts, 4).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


@pytest.mark.parametrize("cap", [8192, 7])
def test_point_clusters(spark, monkeypatch, cap):
    monkeypatch.setattr(clusters, "CELL_CAP", cap)
    rng = np.random.default_rng(2)
    x = np.round(rng.uniform(-6, 6, size=(150, 2)), 3)
    rows = [(i, 1, v.tolist()) for i, v in enumerate(x)] + [(500, 1, None), (501, 1, [float("nan"), 0.0]), (502, 1, [0.0]), (503, 2, [0.0, 0.0]), (None, 1, [0.0, 0.0]), (0, 1, x[0].tolist())]
    df = spark.createDataFrame(rows, "point_id bigint, split_id bigint, point array<double>")
    parts = components.random_mate(clusters.point_links(df, "point_id", "split_id", "point", 0.9))
    assert {(r.rec_id, r.cluster_id) for r in clusters.clusters_of(parts, 3).collect()} == brute_clusters(x, 0.9, 3)
    assert clusters.point_links(df.limit(0), "point_id", "split_id", "point", 0.5).count() == 0


def test_long_loose_clusters_are_split_to_the_end(spark):
    """A chain of 60 points and a tight cluster; the chain needs some 20 medoids, and each takes only what is near it."""
    x = [0.8 * i for i in range(60)] + [100.0 + 0.01 * i for i in range(12)]
    df = spark.createDataFrame([(i, 1, [v]) for i, v in enumerate(x)], "point_id bigint, split_id bigint, point array<double>")
    links = clusters.point_links(df, "point_id", "split_id", "point", 0.9)
    members = clusters.clusters_of(components.random_mate(links), 12)
    split = clusters.split_loose(links, members).collect()
    assert len(split) == 72 and all(abs(x[r.rec_id] - x[r.medoid]) <= 0.9 for r in split if r.cluster_id == 0)
    points = clusters.usable_points(df, "point_id", "split_id", "point").select("id", F.col("point").alias("vec"))
    made = clusters.typical_members(members, points, 0.9).collect()
    chain = [r for r in made if r.cluster_id == 0]
    assert sum(r["size"] for r in chain) == 60 and max(r["size"] for r in chain) <= 3 and len(chain) >= 20
    assert [(r.medoid, r["size"], r.typical) for r in made if r.cluster_id == 60] == [(60, 12, [60, 61, 62])]


def test_large_clusters_are_regrouped_in_blocks(spark, monkeypatch):
    """Blocks give the same groups as one task, for loose and tight clusters."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.cumsum(rng.uniform(0.1, 0.6, 70)), 200 + rng.uniform(0, 0.4, 30)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:, None])], "id bigint, vec array<double>")
    members = spark.createDataFrame([(i, 0 if i < 70 else 70, 70 if i < 70 else 30) for i in range(100)], "rec_id bigint, cluster_id bigint, size bigint")
    whole = {tuple(map(str, r)) for r in clusters.typical_members(members, df, 0.9).collect()}
    monkeypatch.setattr(clusters, "MEMBERS", 9)
    assert {tuple(map(str, r)) for r in clusters.typical_members(members, df, 0.9).collect()} == whole and len(whole) > 10


STATES = "game_id bigint, state_idx bigint, time bigint, subtime bigint, new_session boolean, players array<struct<team:int,index:bigint,location:array<double>,orientation:double,kick_power:double,kick_angle:double>>, received_at bigint, chunk string"
NAN = float("nan")


def state(game, i, x, new=False, received=0, orientation=0.0, kick=None, players=None):
    own = [(0, 1, [x, 0.0], orientation, kick, NAN), (1, 1, [5.0, 5.0], 179.5 if i % 2 else -179.5, NAN, None)]
    return (game, i, i, 0, new, (own[::-1] if i % 3 else own) if players is None else players, received, "z")


@pytest.mark.parametrize(("chunks", "fan_in"), [(1, 32), (3, 32), (16, 2)])
def test_runs(spark, monkeypatch, chunks, fan_in):
    monkeypatch.setattr(runs, "FAN_IN", fan_in)
    rows = [state(1, i, 0.04 * i) for i in range(9)] + [state(1, 3, 0.12, received=9), state(1, 9, 5.0), state(1, 10, 5.05, new=True), state(1, 11, 5.0), state(1, 12, 5.0, kick=3.0), state(1, 13, 5.0, players=[]), state(1, 14, 5.0, players=[]), (None, 1, 1, 0, False, None, 0, "z"), (1, 15, None, None, None, None, 0, "z")]
    rows += [state(2, i, 0.0, orientation=3.0 * i) for i in range(3)] + [state(3, i, 0.0) for i in range(40)]
    random.Random(1).shuffle(rows)
    got = {tuple(r) for r in runs.collapse_runs(spark.createDataFrame(rows, STATES), chunks=chunks).collect()}
    assert got == {(1, 0, 8, 9, 8, 0), (1, 10, 11, 2, 1, 0), (3, 0, 39, 40, 39, 0)}
    assert runs.collapse_runs(spark.createDataFrame(rows, STATES).limit(0)).count() == 0


def test_plan_fills_containers():
    rng = random.Random(2)
    for capacity in (10, 64, 300):
        counts = {n: rng.randrange(0, 40) for n in range(1, capacity + 1)}
        lines = packing.plan_containers(counts, capacity)
        placed = {}
        for m, held in lines:
            assert sum(held) <= capacity and m > 0
            for x in held:
                placed[x] = placed.get(x, 0) + m
        assert placed == {k: v for k, v in counts.items() if v}
        least = max(sum(k * v for k, v in counts.items()) / capacity, sum(v for k, v in counts.items() if 2 * k > capacity))
        assert sum(m for m, _ in lines) <= 1.05 * least + 2


def test_pack(spark):
    sizes = [5, 5, 3, 7, 10, 23, 0, None, 10, 1, 1, 1] + [4] * 200
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, n_tokens bigint")
    rows = packing.pack(df, 10).collect()
    use, got = {}, {}
    for r in rows:
        use[r.container_id] = use.get(r.container_id, 0) + r.size
        got[r.id] = got.get(r.id, 0) + r.size
    assert max(use.values()) <= 10 and got == {i: s or 0 for i, s in enumerate(sizes)}
    assert {r.id for r in rows if r.n_pieces > 1} == {5} and len({(r.id, r.piece_no) for r in rows}) == len(rows)
    assert packing.pack(df.limit(0), 10).count() == 0


TEXTS = [None, "", "short text", "Words and words. " * 300, "a" * 9000, "线圈" * 3000, "One\n\nTwo three?\n" * 400, "mixed 线圈，文字。" * 500, " " * 9000, "tail\ud800 " * 900, "x'y's don't " * 600]


@pytest.mark.parametrize("size", [1 << 20, 700, 90])
def test_pieces(spark, tmp_path, size):
    texts = [t if t is None else tokens.well_formed(t) for t in TEXTS]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(3, texts[3], "copy")], "doc_id bigint, text string, row string")
    rows = splitting.split_texts(df, "doc_id", "text", 200, 20, range_bytes=size).collect()
    count = lambda t: len(tokens.encoding(tokens.DEFAULT_VOCABULARY).encode_ordinary(t))
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {i for i, t in enumerate(texts) if t and count(t) > 200}
    counter = splitting._Counter(tokens.DEFAULT_VOCABULARY)
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r.piece_no)
        text = texts[i]
        assert pieces[0].char_start == 0 and pieces[-1].char_end == len(text)
        # ranges of any size give the pieces of the whole text
        assert [(p.char_start, p.char_end, p.n_tokens) for p in pieces] == splitting.cut(text, counter, 200, 20)
        for p in pieces:
            assert count(text[p.char_start : p.char_end]) == p.n_tokens <= 200
        for a, b in itertools.pairwise(pieces):
            assert a.char_start < b.char_start <= a.char_end < b.char_end
            assert count(text[b.char_start : a.char_end]) >= 15
    for i, text in enumerate(texts):
        if text:
            (tmp_path / f"{i}.txt").write_bytes(text.encode())
    files = splitting.split_files(spark, f"{tmp_path}/*.txt", 200, 20, range_bytes=size).collect()
    assert {(int(r.id.rsplit("/", 1)[1][:-4]), *r[1:]) for r in files} == {tuple(r) for r in rows} and len(files) == len(rows)


def edits_of(words, seed, share):
    rng, out = random.Random(seed), []
    for w in words:
        if rng.random() < share:
            out += [["changed"], [], [w, "added"]][rng.randrange(3)]
        else:
            out.append(w)
    return out


def test_leaks(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [pick(60) for _ in range(12)] + [pick(10)]
    docs, want = [], set()
    for i in range(40):
        item = i % 12
        passage = items[item][5:45]
        if i % 4 == 0:
            text, hit = pick(50) + passage[:20] + pick(60), True
        elif i % 4 == 1:
            text, hit = pick(90) + edits_of(passage, i, 0.05), None
        elif i % 4 == 2:
            text, hit = pick(20) + passage[:14] + pick(30), False
        else:
            text, hit = pick(120), False
        spaced = "  ".join(w.upper() + rng.choice(["", ",", "&nbsp;", ".\n"]) if k % 5 else w[:1] + "​" + w[1:] for k, w in enumerate(text))
        docs.append((i, spaced))
        if hit:
            want.add((i, item))
    docs += [(90, None), (91, ""), (92, " ".join(items[12]))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(t), "") for i, t in enumerate(items)] + [(99, None, ""), (0, " ".join(items[0]), "")], "item_id bigint, text string, id string")
    for block in (10**9, 700):
        got = {(r.id, r.item_id) for r in leakage.leaked(d, b, "doc_id", "text", block_chars=block).collect()}
        brute = set()
        chars, cuts = leakage.normalise([t for _, t in docs])
        held = [leakage.words_of(leakage.normalise([" ".join(t)])[0])[0] for t in items]
        for k, (i, _) in enumerate(docs):
            w = leakage.words_of(chars[cuts[k] : cuts[k + 1]])[0]
            brute |= {(i, j) for j, x in enumerate(held) if leakage.aligned(x, w, -len(x), len(w), 20, 7)}
        assert want <= brute and got == brute
    assert leakage.leaked(d.limit(0), b, "doc_id", "text").count() == 0
    assert leakage.leaked(d, b.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("longest", [1, 2, 9])
def test_leak_filter_loses_nothing(longest):
    """Copies with edits, among them words of up to 500 characters, of items with words as short as one character:
    what aligns over all diagonals is found."""
    rng = random.Random(longest)
    pick = lambda n, of="abcdefghijklmnop": ["".join(rng.choice(of) for _ in range(rng.randint(1, longest))) for _ in range(n)]
    items = [pick(rng.choice([20, 21, 40, 60])) for _ in range(20)]
    docs = []
    for i in range(200):
        own = items[i % 20]
        start = rng.randrange(max(1, len(own) - 19))
        passage = own[start : start + rng.choice([20, 21, 28, 35])]
        for _ in range(rng.choice([1, len(passage) // 7, len(passage) // 7 + 1])):
            at, long = rng.randrange(len(passage)), "q" * rng.choice([1, 30, 100, 200, 500])
            passage[at : at + rng.randrange(2)] = rng.choice([[long], []])
        docs.append(" ".join(pick(rng.randrange(40)) + passage + pick(rng.randrange(40))))
    index = leakage.Index.of(list(range(20)), [" ".join(x) for x in items], leakage.Q, 20, 7)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(docs)], ["id", "text"])
    out = next(iter(leakage._matches(index, 20, 7)(iter([batch]))))
    chars, cuts = leakage.normalise(docs)
    want = set()
    for d in range(200):
        w = leakage.words_of(chars[cuts[d] : cuts[d + 1]])[0]
        want |= {(d, j) for j, x in enumerate(index.words) if leakage.aligned(x, w, -len(x), len(w), 20, 7)}
    assert len(want) > 100 and set(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)) == want


def test_alignment_counts_edits():
    a = np.arange(40, dtype=np.uint64)
    ok = lambda b: leakage.aligned(a, np.array(b, np.uint64), -60, 60, 20, 7)
    # two of twenty words may be missing, also at an end
    assert ok(list(range(5, 25))) and ok(list(range(5, 23))) and not ok(list(range(5, 22)))
    assert ok([0, 1, 2, 99, *range(4, 15), 98, *range(16, 20)])
    assert not ok([0, 1, 2, 99, *range(4, 9), 97, *range(10, 15), 98, *range(16, 19)])
    assert ok([*range(10), 77, *range(10, 20)])
    assert ok([*range(10), *range(11, 21)])




def test_no_link_is_lost_by_bands_or_groups(spark, monkeypatch):
    """Bands that find nothing and groups without guests; the clusters are those of all pairs."""
    monkeypatch.setattr(clusters, "band_key", lambda hashes, chosen: np.arange(hashes.shape[1]).astype(np.uint64))
    monkeypatch.setattr(clusters, "GROUP_ROWS", 60)
    monkeypatch.setattr(clusters, "CROSS", -1.0)
    monkeypatch.setattr(clusters, "PAGE_ROWS", 50)
    x = unit_rows(300, 32, 6, spread=0.15)
    df = spark.createDataFrame([(i, v.tolist(), "", "") for i, v in enumerate(x)], VEC)
    _, parts = clusters.vector_links(df, "feature_id", "feature", 32, 0.3)
    assert {(r.rec_id, r.cluster_id) for r in clusters.clusters_of(parts, 4).collect()} == brute_clusters(vectors.unit(x), 0.3, 4)


def test_all_pairs_in_balls_and_parts(spark, monkeypatch):
    """Groups without guests cut the clusters; balls, wide components and single rows, some of them with signs, are tied."""
    monkeypatch.setattr(clusters, "GROUP_ROWS", 60)
    monkeypatch.setattr(clusters, "CROSS", -1.0)
    for name, value in {"PAGE_ROWS": 70, "PARTS": 6, "STRIP": 16, "WIDTH": 48, "BALL_ROWS": 3, "PAGES_KEPT": 2}.items():
        monkeypatch.setattr(clusters, name, value, raising=False)
    angle = np.linspace(0, 2.5, 40)
    wide = np.zeros((40, 32))
    wide[:, 0], wide[:, 1] = np.cos(angle), np.sin(angle)
    x = np.concatenate([unit_rows(300, 32, 6, spread=0.15), np.round(wide * 400), np.round(np.random.default_rng(8).normal(size=(40, 32)) * 100)])
    df = spark.createDataFrame([(i, v.tolist(), "", "") for i, v in enumerate(x)], VEC)
    _, parts = clusters.vector_links(df, "feature_id", "feature", 32, 0.3)
    assert {(r.rec_id, r.cluster_id) for r in clusters.clusters_of(parts, 4).collect()} == brute_clusters(vectors.unit(x), 0.3, 4)


def test_a_task_gets_few_pages_at_once(spark, monkeypatch):
    """Pairs of pages come in small batches, however many a task has: each is some MB of an executor's memory."""

    def sizes(max_distance, dim):
        def run(batches):
            for n, batch in enumerate(batches):
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([1000 + n])], ["u", "v"])

        return run

    seen = []
    monkeypatch.setattr(clusters, "_page_links", sizes)
    monkeypatch.setattr(clusters, "PAGE_ROWS", 5)
    monkeypatch.setattr(clusters, "random_mate", lambda edges, **_: seen.append(edges) or spark.createDataFrame([], "v bigint, root bigint"))
    df = spark.createDataFrame([(i, v.tolist(), "", "") for i, v in enumerate(unit_rows(400, 16, 3))], VEC)
    clusters.vector_links(df, "feature_id", "feature", 16, 0.3)
    got = [r.u for r in seen[-1].where("v >= 1000").collect()]
    assert got and max(got) <= 4
