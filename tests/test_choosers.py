import math

import pandas as pd

from bagweave.operators import choosers

STATES = "game_id bigint, state_idx bigint, new_session boolean, ball array<double>, players array<struct<team:int,index:bigint,location:array<double>,orientation:double,kick_power:double,kick_angle:double>>"
NAN = math.nan


def item(y, grasped=False, velocity=0.0, orientation=0.0):
    return {"id": 1, "alive": True, "grasped": grasped, "location": [0.0, y], "velocity": [0.0, velocity], "extent": [0.2, 0.5], "orientation": orientation}


def episodes(*rows):
    return choosers.drop_episodes(pd.DataFrame([(i, cleared, items) for i, (cleared, items) in enumerate(rows)], columns=["state_idx", "cleared", "items"]))


def test_drops():
    held, released, falling, ground, high = (False, [item(2, True)]), (False, [item(2)]), (False, [item(1, velocity=-1)]), (False, [item(0.5)]), (False, [item(1.5)])
    # the state of release itself, at rest or not, does not end the episode
    assert episodes(held, released, falling, ground) == [(1, 3, False)]
    assert episodes(held, released, falling, high) == [(1, 3, True)]
    # gone, also in the state of release
    assert episodes(held, released, (False, [])) == [(1, 2, True)] and episodes(held, (False, []), (False, [])) == [(1, 2, True)]
    # a cleared table gives no label, and clearing while held is no drop
    assert episodes(held, released, (True, []), ground) == [] and episodes(held, (True, [item(2)]), ground) == []
    # grasps in between are ignored
    assert episodes(held, released, (False, [item(2, True, velocity=-1)]), ground, held, released, high) == [(1, 3, False), (5, 6, True)]
    assert episodes() == []


def test_ground_by_orientation(spark):
    rows = [(o, [0.2, 0.5], [0.0, 0.5]) for o in (-1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0)]
    df = spark.createDataFrame(rows, "o double, extent array<double>, location array<double>")
    got = {r.o: r.g for r in df.select("o", choosers.on_ground(df.extent, df.location, df.o).alias("g")).collect()}
    assert got == {o: o in (-1.0, 0.0, 1.0) for o, _, _ in rows}


def test_drop_bags(spark):
    kinds = "array<struct<id:bigint,alive:boolean,grasped:boolean,location:array<double>,velocity:array<double>,extent:array<double>,orientation:double>>"
    low = {**item(-1.0), "id": 2}
    rows = [("a", 0, False, [item(2.0, True), low]), ("a", 1, False, [item(2.0), low]), ("a", 2, False, [item(0.5), low])]
    bags, entities = choosers.drop_bags(spark.createDataFrame(rows, f"log string, state_idx bigint, cleared boolean, items {kinds}"), "log")
    assert [(r.bag_id.state_idx, r.rest_idx, r.label) for r in bags.collect()] == [(1, 2, False)]
    assert [(r.bag_id.state_idx, r.entity_id, list(r.location)) for r in entities.collect()] == [(1, 1, [0.0, 2.0])]


def player(team, index, x, y, kick=NAN):
    return (team, index, [x, y], 0.0, kick, NAN)


def test_hold_and_pass_bags(spark):
    quiet = [player(0, 1, 0.0, 0.0), player(0, 2, 5.0, 0.0), player(1, 1, 0.0, 9.0)]
    kick = [player(0, 1, 0.0, 0.0, 50.0), *quiet[1:]]
    rows = [(1, i, i == 15, [2.0 if i == 1 else 0.0, 0.0], kick if i in (0, 5) else quiet) for i in range(20)]
    bags, entities, pins = choosers.hold_pass_bags(spark.createDataFrame(rows, STATES), "game_id")
    assert sorted((r.bag_id.state_idx, r.kind, r.label) for r in bags.collect()) == [(0, "pass", False), (5, "hold", True)]
    assert entities.count() == 8
    assert sorted((r.bag_id.state_idx, r.depth, r.entity_id) for r in pins.collect()) == [(0, 0, 1), (0, 1, 2), (5, 0, 1), (5, 1, 3)]
    both = [(1, i, False, [0.0, 0.0], [player(0, 1, 0.0, 0.0, 1.0), player(0, 2, 1.0, 1.0, 1.0)]) for i in range(20)]
    try:
        choosers.hold_pass_bags(spark.createDataFrame(both, STATES), "game_id")[0].collect()
    except Exception as e:
        assert "several kickers" in str(e)
    else:
        raise AssertionError
    assert choosers.hold_pass_bags(spark.createDataFrame(both, STATES), "game_id", strict=False)[0].count() == 24
