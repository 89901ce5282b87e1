import json

import pytest

from bagweave.sources import logs, tables

BLOCKS = """item 1
type 1 block
alive 1 true
extent 1 0.5 0.5
pos 1 0.0 0.5
time sim 1 0.1
posvel 1 0.0 -1.0
time sim 2 0.2
"""
GAME = """ULG5
(team 1 Keepers Takers 0 0)
(show 1 ((b) 0 0 0 0) ((l 1) 0 1 -1 0 0 0 30) ((r 1) 0 1 5 5 0 0 0) ((r 2) 0 0 5 5 0 0 0))
(show 1 ((b) 0 1 1 0))
"""


def test_table(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("%Bag Location Size Location\n1 0.0 1.0 2.0\n1 3.0 1.5 4.0 9\n3 1 2 3\n")
    rows = tables.read_table(spark, str(path)).orderBy("Bag", "Size").collect()
    assert [(r.Bag, list(r.Location), r.Size) for r in rows] == [(1.0, [0.0, 2.0], 1.0), (1.0, [3.0, 4.0], 1.5), (3.0, [1.0, 3.0], 2.0)]
    path.write_text("Bag Size\n1\n")
    with pytest.raises(Exception, match="short row"):
        tables.read_table(spark, str(path)).collect()


def test_block_log(spark, tmp_path):
    (tmp_path / "a.log").write_text(BLOCKS)
    states, items = logs.read_block_log(spark, str(tmp_path))
    assert [r.time for r in states.orderBy("state_idx").collect()] == [0.0, 0.1, 0.2]
    assert [list(r.velocity) for r in items.orderBy("state_idx").collect()] == [[0, 0], [0, -1], [0, -1]]


def test_game_log(spark, tmp_path):
    (tmp_path / "a.rcg").write_text(GAME)
    rows = logs.read_game_log(spark, str(tmp_path / "a.rcg")).collect()
    assert sorted((r.state_idx, r.time, r.subtime, r.kind, r.team, r["index"]) for r in rows) == [(0, 1, 0, "ball", -1, 0), (0, 1, 0, "player", 0, 1), (0, 1, 0, "player", 1, 1), (1, 1, 1, "ball", -1, 0)]
    (tmp_path / "a.rcl").write_text("1,0\tRecv Keepers_1: (kick 50 0)\n1,0\tRecv Coach: (x)\n9,0\tRecv Keepers_1: (kick 1 1)\n")
    names = logs.team_names(logs.read_lines(spark, str(tmp_path / "a.rcg")))
    commands = logs.read_commands(spark, logs.command_path(str(tmp_path / "a.rcg")))
    joined = logs.with_commands(logs.read_game_log(spark, str(tmp_path / "a.rcg")), commands, names)
    assert [(r["index"], r.kick_power) for r in joined.where("kick_power > 0 and not isnan(kick_power)").collect()] == [(1, 50.0)]


def test_games_do_not_mix(spark, tmp_path):
    """Two games with the same times and swapped team names; a kick of a player who isn't there is an error."""
    (tmp_path / "a.rcg").write_text(GAME)
    (tmp_path / "b.rcg").write_text(GAME.replace("Keepers Takers", "Takers Keepers"))
    (tmp_path / "a.rcl").write_text("1,0\tRecv Keepers_1: (kick 50 0)\n1,0\tRecv Keepers_1: (kick 60 0)\n")
    (tmp_path / "b.rcl").write_text("1,0\tRecv Keepers_1: (kick 70 0)\n")
    states, names = logs.read_game_log(spark, f"{tmp_path}/*.rcg"), logs.team_names(logs.read_lines(spark, f"{tmp_path}/*.rcg"))
    joined = logs.with_commands(states, logs.read_commands(spark, f"{tmp_path}/*.rcl"), names).where("not isnan(kick_power)")
    assert sorted((r.log[-1], r.team, r["index"], r.kick_power) for r in joined.collect()) == [("a", 0, 1, 60.0), ("b", 1, 1, 70.0)]
    (tmp_path / "b.rcl").write_text("1,0\tRecv Keepers_2: (kick 70 0)\n")
    with pytest.raises(Exception, match="no player 2"):
        logs.with_commands(states, logs.read_commands(spark, f"{tmp_path}/*.rcl"), names).collect()


def test_export_document(spark):
    bags = spark.createDataFrame([(1, True), (2, False)], "bag_id bigint, label boolean")
    entities = spark.createDataFrame([(1, 0, "ball", [0.0, 1.0]), (1, 1, "player", [2.0, 3.0])], "bag_id bigint, entity_id int, type string, location array<double>")
    pins = spark.createDataFrame([(1, 0, 1)], "bag_id bigint, depth int, entity_id int")
    graphs = tables.bags_to_json(bags, entities, ("location",), pins)
    document = json.loads("".join(r.line for r in tables.export_lines(graphs, ("location",)).collect()))
    assert document[1] == ["location"] and [g["label"] for g in document[0]] == [True, False]
    assert [(i["type"], i["location"], i["__instantiable_depth__"]) for i in document[0][0]["items"]] == [("ball", [[0.0], [1.0]], 1), ("player", [[2.0], [3.0]], 0)]


def test_descriptors(spark, tmp_path):
    (tmp_path / "7.key").write_text("2 4\n1 2 3 4\n1 2\n3 4\n5 6 7 8\n9 9 9 9\n")
    rows = tables.read_descriptors(spark, str(tmp_path)).collect()
    assert [(r.file, list(r.location), r.scale, list(r.feature)) for r in rows] == [(7, [1, 2], 3.0, [1, 2, 3, 4]), (7, [5, 6], 7.0, [9, 9, 9, 9])]
