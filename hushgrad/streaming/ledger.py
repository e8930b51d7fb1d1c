"""A budget ledger over a stream (an extension): per user, steps are admitted until their filter refuses one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from hushgrad.operators import accounting

OUT = "user_id long, event_id long, admitted boolean, steps long, spent_epsilon double"
STATE = "steps long, squares double, deltas double, closed boolean"


def admitted(events: DataFrame, epsilon: float, delta: float, cost: tuple[float, float]) -> DataFrame:
    """One row for each event (user_id, event_id): whether the user's budget admits it. After a refusal all are refused."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        steps, squares, deltas, closed = state.get if state.exists else (0, 0.0, 0.0, False)
        spent = accounting.Spent(steps, squares, deltas)
        for frame in frames:
            rows = []
            for e in sorted(frame.event_id):
                closed = closed or not accounting.permits(spent, cost, epsilon, delta)
                if not closed:
                    spent = spent.plus(*cost)
                rows.append((key[0], e, not closed, spent.steps, spent.epsilon(delta)))
            yield pd.DataFrame(rows, columns=["user_id", "event_id", "admitted", "steps", "spent_epsilon"])
        state.update((spent.steps, spent.squares, spent.deltas, bool(closed)))

    return events.select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
