"""Health of sites over a stream of runs: consecutive errors, reset by a run with hits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..fixed import DISABLE_AFTER


def _count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fails = state.get[0] if state.exists else 0
    rows = pd.concat(list(frames)).sort_values(["run_at", "event_id"])
    for hits, error in zip(rows["hits"], rows["error"]):
        fails = 0 if hits > 0 else fails + (error is not None and error == error)
    state.update((fails,))
    yield pd.DataFrame({"domain": [key[0]], "fails": [fails], "disabled": [fails >= DISABLE_AFTER]})


def consecutive_failures(runs: DataFrame) -> DataFrame:
    """A stream of runs (domain, run_at, event_id, hits, error) -> each domain's state after each batch. Runs of a batch are taken in order of time."""
    out = "domain string, fails long, disabled boolean"
    return runs.groupBy("domain").applyInPandasWithState(_count, out, "fails long", "update", GroupStateTimeout.NoTimeout)
