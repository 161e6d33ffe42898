"""The ordered folds on streams: one feed's state is kept between micro-batches and fed its new rows in order.

The same step functions serve batch replay (operators.folds.fold_rows), so both give the same rows when a feed's rows
come in order. Rows of a micro-batch are sorted; a row older than those of an earlier micro-batch is folded when it
comes, as arrival order is the order of the live system. A fold with an end needs the rows' time: rows behind the
watermark are left out as late, and a feed that has been idle for long enough by the watermark is finished, its last
rows are given and its state goes. A key's rows of one micro-batch are held together, so the source should bound its
micro-batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold_stream(
    stream: DataFrame,
    keys: list[str],
    order: list[str],
    start: Callable[[], Any],
    step: Callable[[Any, dict], list[tuple]],
    ddl: str,
    finish: Callable[[Any], list[tuple]] | None = None,
    event_time: str | None = None,
    late: str = "10 seconds",
    idle_ms: int = 60_000,
) -> DataFrame:
    """Rows that ``step(state, row)`` returns for each row, and ``finish(state)`` once a key's rows are over: when the
    watermark, ``late`` behind the latest ``event_time``, is ``idle_ms`` beyond the key's last row."""
    if finish and not event_time:
        raise ValueError("a fold with an end needs the column of the rows' time")
    names = [c.strip().split()[0] for c in ddl.split(",")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = pickle.loads(state.get[0])
            state.remove()
            yield pd.DataFrame(finish(held), columns=names)
            return
        held, last = (pickle.loads(state.get[0]), state.get[1]) if state.exists else (start(), 0)
        rows = pd.concat(batches, ignore_index=True).sort_values(order, kind="stable")
        if finish:
            last = max(last, int(rows[event_time].max().timestamp() * 1000))
            rows = rows.drop(columns=event_time)
        out = [o for r in rows.to_dict("records") for o in step(held, r)]
        state.update((pickle.dumps(held), last))
        if finish:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.EventTimeTimeout if finish else GroupStateTimeout.NoTimeout
    rows = stream.withWatermark(event_time, late) if finish else stream
    return rows.groupBy(*keys).applyInPandasWithState(run, ddl, "state binary, last long", "append", timeout)
