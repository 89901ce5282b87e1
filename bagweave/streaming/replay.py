"""Block-world logs as streams: the state of every log is kept between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bagweave.sources.logs import BLOCK_ROWS, BlockReplay


def replay_stream(lines: DataFrame) -> DataFrame:
    """(log, state_idx, time, cleared, items) for each `time sim` line of a stream of lines, as `replay_blocks` gives them
    but for the state at the end, since a stream has none.

    lines: log, line_no, value. Within a micro-batch a log's lines are taken in the order of line_no; a line that comes
    in a later batch counts as later. What is kept of a log is its current items, not its lines.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        replay = BlockReplay()
        if state.exists:
            index, time, cleared, items = json.loads(state.get[0])
            replay = BlockReplay(index, time, cleared, {x["id"]: x for x in items})
        whole = pd.concat(list(parts)).sort_values("line_no")
        rows = [(key[0], *made) for line in whole["value"] if (made := replay.feed(line)) is not None]
        state.update((json.dumps(replay.snapshot()),))
        yield pd.DataFrame(rows, columns=["log", "state_idx", "time", "cleared", "items"])

    return lines.groupBy("log").applyInPandasWithState(step, BLOCK_ROWS, "state string", "append", GroupStateTimeout.NoTimeout)
