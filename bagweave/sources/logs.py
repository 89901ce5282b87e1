"""Block-world and soccer simulator logs as state tables.

One log is a sequence whose lines change a current state; logs are independent of each other, so they are read file by
file in parallel, and replayed inside the task that read them.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# block world

_BLOCK_STATE = "state_idx bigint, time double, cleared boolean"
_BLOCK_ITEM = "id bigint, alive boolean, color array<double>, extent array<double>, grasped boolean, grasping boolean, location array<double>, orientation double, orientation_velocity double, type string, velocity array<double>"


def _new_item(item_id: int) -> dict:
    return {"id": item_id, "alive": False, "color": [0.0] * 3, "extent": [0.0] * 2, "grasped": False, "grasping": False, "location": [0.0] * 2, "orientation": 0.0, "orientation_velocity": 0.0, "type": "none", "velocity": [0.0] * 2}


class BlockReplay:
    """The current state of a block-world log, which its lines change one by one."""

    def __init__(self, index: int = 0, time: float = 0.0, cleared: bool = False, items: dict[int, dict] | None = None):
        self.index, self.time, self.cleared, self.items = index, time, cleared, items or {}

    def snapshot(self) -> tuple[int, float, bool, list[dict]]:
        return self.index, self.time, self.cleared, [dict(x) for x in self.items.values()]

    def feed(self, line: str) -> tuple[int, float, bool, list[dict]] | None:
        """Takes over one line; a `time sim` line gives the state as it was before it."""
        args = line.split()
        if not args:
            return None
        command, args, items = args[0], args[1:], self.items
        if command == "clear":
            self.cleared = True
        elif command == "time":
            if args[:1] == ["sim"]:
                made = self.snapshot()
                self.index, self.cleared, self.time = self.index + 1, False, float(args[2])
                return made
        elif command == "item":
            items[int(args[0])] = _new_item(int(args[0]))
        elif command == "grasp" or command == "release":
            for key, name in zip(args, ("grasping", "grasped"), strict=False):
                if int(key) in items:
                    items[int(key)][name] = command == "grasp"
        elif args and args[0].lstrip("-").isdigit() and (item := items.get(int(args[0]))) is not None:
            values = args[1:]
            if command == "destroy":
                del items[item["id"]]
            elif command == "alive":
                item["alive"] = values[0] == "true"
            elif command == "type":
                if values[0] in ("block", "tool"):
                    item["type"] = values[0]
            elif command == "color":
                item["color"] = [float(v) for v in values[:3]]
            elif command in ("extent", "pos", "posvel"):
                item[{"extent": "extent", "pos": "location", "posvel": "velocity"}[command]] = [float(v) for v in values[:2]]
            elif command == "rot":
                item["orientation"] = float(values[0])
            elif command == "rotvel":
                item["orientation_velocity"] = float(values[0])
        return None


def replay_blocks(lines: Iterator[str]) -> Iterator[tuple[int, float, bool, list[dict]]]:
    """(state_idx, time, cleared, items) for each `time sim` line, as it was before the line, and for the end."""
    replay = BlockReplay()
    for line in lines:
        if (made := replay.feed(line)) is not None:
            yield made
    yield replay.snapshot()


#: States of a log that go to Spark at once.
_STATES = 2000
BLOCK_ROWS = f"log string, {_BLOCK_STATE}, items array<struct<{','.join(x.replace(' ', ':', 1) for x in _BLOCK_ITEM.split(', '))}>>"


def read_block_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(states, items) of block-world logs; `log` names the file. An unknown command or id changes nothing."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, text in zip(part["log"], part["value"], strict=True):
                states = replay_blocks(iter(text.splitlines()))
                while rows := [(name, *state) for state in itertools.islice(states, _STATES)]:
                    yield pd.DataFrame(rows, columns=["log", "state_idx", "time", "cleared", "items"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log"), "value")
    rows = files.mapInPandas(parse, BLOCK_ROWS)
    return rows.select("log", "state_idx", "time", "cleared"), rows.select("log", "state_idx", F.explode("items").alias("item")).select("log", "state_idx", "item.*")


# soccer

_TOKEN = re.compile(r'\(|\)|"((?:[^"\\]|\\.)*)"|[^\s()"]+')


def parse_expression(text: str) -> list:
    """Nested lists of numbers and words of one parenthesised line."""
    out: list = []
    stack = [out]
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t == "(":
            stack.append([])
            stack[-2].append(stack[-1])
        elif t == ")":
            if len(stack) == 1:
                raise ValueError("unbalanced )")
            stack.pop()
        elif m[1] is not None:
            stack[-1].append(m[1])
        else:
            try:
                stack[-1].append(float(t))
            except ValueError:
                stack[-1].append(t)
    if len(stack) > 1:
        raise ValueError("unbalanced (")
    return out


def read_game(text: str) -> Iterator[tuple]:
    """(state_idx, time, subtime, kind, team, index, x, y, orientation) of the `show` lines of a game log."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != "ULG5":
        raise ValueError("not a game log of version ULG5")
    index, last, sub = 0, None, 0
    for line in lines[1:]:
        if not line.startswith("(show "):
            continue
        shown = parse_expression(line)[0]
        time = int(shown[1])
        sub = sub + 1 if time == last else 0
        last = time
        for entry in shown[2:]:
            name = entry[0]
            if name == ["b"]:
                yield index, time, sub, "ball", -1, 0, entry[1], entry[2], float("nan")
            elif len(name) == 2 and entry[2] != 0:
                yield index, time, sub, "player", 0 if name[0] == "l" else 1, int(name[1]), entry[3], entry[4], entry[7]
        index += 1


def team_names(lines: DataFrame) -> DataFrame:
    """(log, team, name) from the first `(team …)` line of each log. lines: log, line_no, value."""
    first = lines.where(F.col("value").startswith("(team ")).groupBy("log").agg(F.min_by("value", "line_no").alias("value"))
    part = lambda n: F.regexp_extract("value", r"^\(team \S+ (\S+) (\S+)", n)
    return first.select("log", F.explode(F.array(F.struct(F.lit(0).alias("team"), part(1).alias("name")), F.struct(F.lit(1).alias("team"), part(2).alias("name")))).alias("t")).select("log", "t.*")


def read_game_log(spark: SparkSession, path: str) -> DataFrame:
    """(log, state_idx, time, subtime, kind, team, index, location, orientation) of game logs, file by file."""
    schema = "log string, state_idx bigint, time bigint, subtime bigint, kind string, team int, index bigint, location array<double>, orientation double"

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, text in zip(part["log"], part["value"], strict=True):
                rows = [(name, s, t, u, kind, team, i, [x, y], o) for s, t, u, kind, team, i, x, y, o in read_game(text)]
                yield pd.DataFrame(rows, columns=["log", "state_idx", "time", "subtime", "kind", "team", "index", "location", "orientation"])

    return spark.read.text(path, wholetext=True).select(log_stem(F.input_file_name()).alias("log"), "value").mapInPandas(parse, schema)


def command_path(game_path: str) -> str:
    """The command log beside a game log."""
    if not game_path.endswith(".rcg"):
        raise ValueError(f"not a game log: {game_path}")
    return game_path[:-4] + ".rcl"


def log_stem(name):
    """What the files of one game have in common: the name of the game log without its ending."""
    return F.regexp_replace(name, r"\.rc[gl]$", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, line_no, value): log is the file's `log_stem`; line_no rises within a file."""
    return spark.read.text(path).select(log_stem(F.input_file_name()).alias("log"), F.monotonically_increasing_id().alias("line_no"), "value")


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """(log, line_no, time, subtime, team_name, index, power, angle, new_session) of kicks and session starts; others are
    left out."""
    head = F.regexp_extract("value", r"^(\d+),(\d+)\t", 1).try_cast("bigint")
    sub = F.regexp_extract("value", r"^(\d+),(\d+)\t", 2).try_cast("bigint")
    who = r"Recv (\w+)_(\d+): "
    kick = r"\(kick ([-+.\deE]+) ([-+.\deE]+)\)"
    get = lambda pattern, n: F.regexp_extract("value", pattern, n)
    session = F.col("value").rlike(r"\t\((\S+ ){2}Keepaway")
    rows = read_lines(spark, path).select("log", "line_no", head.alias("time"), sub.alias("subtime"), F.nullif(get(who, 1), F.lit("")).alias("team_name"), get(who, 2).try_cast("bigint").alias("index"), get(kick, 1).try_cast("double").alias("power"), get(kick, 2).try_cast("double").alias("angle"), session.alias("new_session"))
    return rows.where("time is not null and (new_session or (power is not null and team_name is not null and team_name <> 'Coach'))")


def with_commands(states: DataFrame, commands: DataFrame, names: DataFrame) -> DataFrame:
    """states with kick_power, kick_angle (NaN for none) and new_session, log by log.

    Commands without a state are ignored; a kick by a player that its state doesn't show is an error. Of several kicks of
    a player in one state the last one holds. names: log, team, name.
    """
    at, who = ["log", "time", "subtime"], ["log", "time", "subtime", "team", "index"]
    last = lambda c: F.max_by(c, "line_no").alias(f"kick_{c}")
    kicks = commands.where("power is not null").withColumnRenamed("team_name", "name").join(F.broadcast(names), ["log", "name"]).groupBy(*who).agg(last("power"), last("angle"))
    shown = states.where("kind = 'player'").select(*who, F.lit(True).alias("shown")).distinct()
    kicks = kicks.join(states.select(*at).distinct(), at, "left_semi").join(shown, who, "left")
    missing = F.raise_error(F.concat(F.lit("no player "), F.col("index").cast("string"), F.lit(" at "), F.col("time").cast("string"))).cast("double")
    kicks = kicks.select(*who, F.when(F.col("shown"), F.col("kick_power")).otherwise(missing).alias("kick_power"), "kick_angle")
    sessions = commands.where("new_session").select(*at, F.lit(True).alias("new_session")).distinct()
    joined = states.join(kicks, who, "left").join(sessions, at, "left")
    nan = F.lit(float("nan"))
    return joined.withColumns({"kick_power": F.coalesce("kick_power", nan), "kick_angle": F.coalesce("kick_angle", nan), "new_session": F.coalesce("new_session", F.lit(False))})


# replay and sessions as windows


def last_values(events: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each event with the last value that is not NULL of every column, up to and with it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumns({f"last_{c}": F.last(c, ignorenulls=True).over(w) for c in columns})


def session_ids(events: DataFrame, by: str, order: list[str], starts: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("session_id", F.sum(F.when(F.col(starts), 1).otherwise(0)).over(w))


def implied_subtimes(states: DataFrame, by: str) -> DataFrame:
    return states.withColumn("subtime", F.row_number().over(Window.partitionBy(by, "time").orderBy("state_idx")) - 1)
