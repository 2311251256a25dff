"""Page states as a stream: each event against the last state of its page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.schemas import TRANSITIONS

OUT = "page_id string, event_id long, at timestamp, from_state string, to_state string, allowed boolean"


def checked_states(events: DataFrame) -> DataFrame:
    """Every event (page_id, event_id, at, status) with the state before it and whether the move is allowed.

    The state kept per page is its last state alone. Events of a page in one
    batch are taken in the order of their time and id; staying in a state is
    always allowed, and so is the first event of a page.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        before, fine = [], []
        for status in rows["status"]:
            before.append(last)
            fine.append(last is None or last == status or status in TRANSITIONS.get(last, ()))
            last = status
        state.update((last,))
        yield pd.DataFrame({"page_id": rows["page_id"], "event_id": rows["event_id"], "at": rows["at"], "from_state": before, "to_state": rows["status"], "allowed": fine})

    return events.groupBy("page_id").applyInPandasWithState(step, OUT, "last string", "append", GroupStateTimeout.NoTimeout)


def daily_moves(checked: DataFrame, late: str = "2 days") -> DataFrame:
    """Moves per day and target state; events later than ``late`` no longer change a day that is out."""
    return checked.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("day"), "to_state").agg(F.count("*").alias("moves"), F.count_if(~F.col("allowed")).alias("refused"))
