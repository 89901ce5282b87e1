"""Runs of near-identical consecutive states, by associative run summaries.

The states are range-partitioned by (game, time, subtime, state), so that each partition is a chunk of the global
order, however large one game is. Every chunk encodes its runs locally; only its first and last run can continue in a
neighbouring chunk. Those boundary runs, at most two a chunk, are joined by a parallel prefix merge: on each level every
task joins some neighbouring chunks into one, which again has two boundary runs, until one is left.

Results for special input: states without game or index are left out; copies of a state (same game and index, next to
each other in the order) count once, the earliest received one stays; a state without players, or with a player whose
identity, place or direction is missing or NaN, resembles no state; a missing time sorts first; an empty table has no
runs; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagweave.session import materialize

#: Added to the tolerances, since differences of decimal fractions carry rounding errors.
EPS = 1e-9
#: Chunks whose boundary runs one task of the prefix merge joins.
FAN_IN = 32
_SUMS = ("game_id", "first_idx", "last_idx", "n_states", "time_0", "subtime_0", "time_1", "subtime_1")
_FLAT = ("team", "index", "x", "y", "orientation", "kick_power", "kick_angle")
_SCHEMA = (
    "chunk int, position int, is_first boolean, is_last boolean, "
    + ", ".join(f"{c} bigint" for c in _SUMS)
    + ", head array<array<double>>, tail array<array<double>>, head_new boolean"
)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(number of players of each state, one row of seven values for each player)."""
    players = batch.column("players")
    n = np.nan_to_num(np.asarray(pc.list_value_length(players).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    values = players.flatten()
    if len(values) == 0:
        return n, np.empty((0, 7))
    at = values.field("location")
    two = pc.equal(pc.list_value_length(at), 2)
    xy = np.full((len(values), 2), np.nan)
    ok = np.asarray(pc.fill_null(two, False).to_numpy(zero_copy_only=False), dtype=bool)
    xy[ok] = pc.cast(at.filter(pa.array(ok)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, 2)
    number = lambda c: pc.cast(values.field(c), pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    return n, np.column_stack([number("team"), number("index"), xy, number("orientation"), number("kick_power"), number("kick_angle")]).astype(float)


def near(a: np.ndarray, b: np.ndarray, distance: float, degrees: float) -> np.ndarray:
    """For rows of the seven values of a player: are they the same player, in nearly the same posture?"""
    turn = np.abs(a[:, 4] - b[:, 4]) % 360.0
    same_kick = ((a[:, 5:] == b[:, 5:]) | (np.isnan(a[:, 5:]) & np.isnan(b[:, 5:]))).all(1)
    return (a[:, :2] == b[:, :2]).all(1) & (np.abs(a[:, 2:4] - b[:, 2:4]) <= distance + EPS).all(1) & (np.minimum(turn, 360.0 - turn) <= degrees + EPS) & same_kick


def _links(n: np.ndarray, values: np.ndarray, new: np.ndarray, distance: float, degrees: float) -> np.ndarray:
    """For each state but the first: is it near-identical to the one before it (which is of the same game)?"""
    if len(n) < 2:
        return np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(n)])
    able = (n[1:] == n[:-1]) & (n[1:] > 0) & ~new[1:]
    which = np.flatnonzero(able)
    if len(which) == 0:
        return able
    sizes = n[which + 1]
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    good = near(values[np.repeat(offsets[which], sizes) + within], values[np.repeat(offsets[which + 1], sizes) + within], distance, degrees)
    able[which] = np.logical_and.reduceat(good, np.cumsum(sizes) - sizes)
    return able


def _chunk_runs(distance: float, degrees: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams one sorted chunk; holds one batch and the open run."""
        chunk, position, first, pending, last = 0, 0, True, None, None
        out: list[list] = []

        def state(i, keys, n, values, offsets):
            return [list(map(float, r)) for r in values[offsets[i] : offsets[i + 1]]]

        def flush():
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * len(_SUMS), pa.list_(pa.list_(pa.float64())), pa.list_(pa.list_(pa.float64())), pa.bool_()]
            names = ["chunk", "position", "is_first", "is_last", *_SUMS, "head", "tail", "head_new"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        def close(run, is_last):
            nonlocal position, first
            sums, head, tail, new = run
            if first or is_last or sums[3] >= 2:
                edge = first or is_last
                out.append([chunk, position, first, is_last, *sums, head if edge else None, tail if edge else None, new])
                position += 1
            first = False

        for batch in batches:
            if batch.num_rows == 0:
                continue
            chunk = batch.column("chunk")[0].as_py()
            n, values = _flat(batch)
            game, idx, time, sub = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("game_id", "state_idx", "time", "subtime"))
            new = np.asarray(batch.column("new_session").to_numpy(zero_copy_only=False), dtype=bool)
            keep = np.ones(len(n), bool)
            keep[1:] = (game[1:] != game[:-1]) | (idx[1:] != idx[:-1])
            if last is not None:
                keep[0] = (game[0], idx[0]) != last[:2]
            values, rows = values[np.repeat(keep, n)], np.flatnonzero(keep)
            if len(rows) == 0:
                continue
            n, game, idx, time, sub, new = (x[rows] for x in (n, game, idx, time, sub, new))
            offsets = np.concatenate([[0], np.cumsum(n)])
            link = np.zeros(len(n), bool)
            link[1:] = _links(n, values, new, distance, degrees) & (game[1:] == game[:-1])
            if last is not None and last[0] == game[0]:
                before = np.array(last[2], dtype=float).reshape(-1, 7)
                link[0] = _links(np.array([len(before), n[0]]), np.concatenate([before, values[: n[0]]]), np.array([False, new[0]]), distance, degrees)[0]
            starts = np.flatnonzero(~link)
            whole = lambda x: None if x != x else int(x)
            if link[0]:
                end = (starts[0] if len(starts) else len(n)) - 1
                pending[0][2:4] = [int(idx[end]), pending[0][3] + end + 1]
                pending[0][6:8] = [whole(time[end]), whole(sub[end])]
                pending[2] = state(end, None, n, values, offsets)
            for k, s in enumerate(starts):
                end = (starts[k + 1] if k + 1 < len(starts) else len(n)) - 1
                if pending is not None:
                    close(pending, False)
                # the players of a run's ends are needed at the chunk's ends only
                ends = first or k + 1 == len(starts)
                pending = [[int(game[s]), int(idx[s]), int(idx[end]), int(end - s + 1), whole(time[s]), whole(sub[s]), whole(time[end]), whole(sub[end])], state(s, None, n, values, offsets) if ends else None, state(end, None, n, values, offsets) if ends else None, bool(new[s])]
            last = (game[-1], idx[-1], state(len(n) - 1, None, n, values, offsets))
            if out:
                yield flush()
                out.clear()
        if pending is not None:
            close(pending, True)
            yield flush()

    return run


def _merge(distance: float, degrees: float, fan_in: int):
    def run(table: pa.Table) -> pa.Table:
        """Joins the boundary runs of some neighbouring chunks into those of one larger chunk and the runs between."""
        rows = table.sort_by([("chunk", "ascending"), ("position", "ascending")]).to_pylist()
        group, made = rows[0]["chunk"] // fan_in, [rows[0]]
        for row in rows[1:]:
            open_, joins = made[-1], False
            if open_["is_last"] and row["is_first"] and open_["game_id"] == row["game_id"]:
                a, b = (np.array(x, dtype=float).reshape(-1, 7) for x in (open_["tail"], row["head"]))
                joins = bool(_links(np.array([len(a), len(b)]), np.concatenate([a, b]), np.array([False, row["head_new"]]), distance, degrees)[0])
            if joins:
                sums = {k: row[k] for k in ("last_idx", "time_1", "subtime_1", "tail", "is_last")}
                made[-1] = open_ | sums | {"n_states": open_["n_states"] + row["n_states"]}
            else:
                made.append(row)
        for i, row in enumerate(made):
            row.update(chunk=group, position=i, is_first=i == 0, is_last=i + 1 == len(made))
        return pa.Table.from_pylist(made, schema=table.schema)

    return run


def collapse_runs(states: DataFrame, distance: float = 0.05, degrees: float = 2.0, chunks: int | None = None) -> DataFrame:
    """One row per longest run of near-identical consecutive states of a game, runs of one state left out.

    Columns: game_id, first_idx, last_idx, n_states, duration_time, duration_subtime (last minus first state).
    """
    spark = states.sparkSession
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["game_id", "time", "subtime", "state_idx"]
    player = "players array<struct<team:int,index:bigint,location:array<double>,orientation:double,kick_power:double,kick_angle:double>>"
    narrow = states.where("game_id is not null and state_idx is not null").select(
        *order, F.coalesce("new_session", F.lit(False)).alias("new_session"), "received_at", F.array_sort(F.filter("players", lambda p: p.isNotNull())).cast(player.split(" ", 1)[1]).alias("players")
    )
    sorted_ = narrow.repartitionByRange(chunks, *order).sortWithinPartitions(*order, "received_at").withColumn("chunk", F.spark_partition_id()).drop("received_at")
    parts = materialize(sorted_.mapInArrow(_chunk_runs(distance, degrees), _SCHEMA))
    inner = parts.where("not is_first and not is_last").select(*_SUMS)
    # a level joins FAN_IN neighbouring chunks in each task, so the last one has few rows however many chunks there are
    edges, level = parts.where("is_first or is_last"), chunks
    while level > 1:
        merged = edges.groupBy(F.floor(F.col("chunk") / FAN_IN)).applyInArrow(_merge(distance, degrees, FAN_IN), _SCHEMA)
        level = -(-level // FAN_IN)
        if level == 1:
            edges = merged
            break
        merged = materialize(merged)
        inner = inner.unionByName(merged.where("not is_first and not is_last").select(*_SUMS))
        edges = merged.where("is_first or is_last")
    return inner.unionByName(edges.select(*_SUMS)).where("n_states >= 2").select("game_id", "first_idx", "last_idx", "n_states", (F.col("time_1") - F.col("time_0")).alias("duration_time"), (F.col("subtime_1") - F.col("subtime_0")).alias("duration_subtime"))
