"""Incremental detection of candidates: what each title has come to is kept in the stream's state, across batches and restarts.

A title is *rejected* at once if it can't be a new meme. It becomes a *candidate* when two scrapes at most ``apart`` from each other hold it, and is *scored* as
soon as the scorer answers for it. A scored or rejected title never comes back. A candidate without a score that is not seen for
``apart`` is *expired* (by a later scrape, or by a timer once the watermark has passed), and may become one anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

APART = timedelta(hours=48)
TRANSITION = "title string, n int, status string, since timestamp, score double"
_STATE = "status string, last timestamp, n int"


def acceptable(title: str, known: list[str], noise: list[str]) -> bool:
    """As in batch detection: 4 to 30 characters, ten or more if there are digits, neither a known name nor noise inside."""
    return 4 <= len(title) <= 30 and not (len(title) < 10 and any("0" <= c <= "9" for c in title)) and not any(w in title for w in [*known, *noise])


def transitions(stream: DataFrame, scorer: Callable[[str], float | None], known: list[str], noise: list[str], apart: timedelta = APART, late: str = "48 hours") -> DataFrame:
    """(title, n, status, since, score): the changes of status, numbered by title. stream: (title, scrape); rows without a title are left out.

    Rows within a batch may come in any order, batches in the order of scrapes up to ``late``. Run it in update mode.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (title,) = key
        out: list[tuple] = []
        status, last, n = state.get if state.exists else ("seen", None, 0)

        def to(new: str, since: datetime, score: float | None = None) -> None:
            nonlocal status, n
            status, n = new, n + 1
            out.append((title, n, new, since, score))

        if state.hasTimedOut:
            if status == "candidate":
                to("expired", last + apart)
                status = "seen"
                state.update((status, None, n))  # its numbers go on; it needs no timer
            elif n == 0:
                state.remove()
            else:
                state.update((status, None, n))
        elif status not in ("scored", "rejected"):
            scrapes = list(pd.DatetimeIndex(np.unique(np.concatenate([f["scrape"].to_numpy() for f in frames]))).to_pydatetime())
            if not state.exists and not acceptable(title, known, noise):
                to("rejected", scrapes[0])
            for at in scrapes if status != "rejected" else ():
                if last is not None and at < last:
                    continue  # late, and nothing new
                if last is not None and at - last > apart and status == "candidate":
                    to("expired", last + apart)
                    status = "seen"
                elif last is not None and last < at <= last + apart and status == "seen":
                    to("candidate", at)
                last = at
                if status == "candidate" and (score := scorer(title)) is not None:
                    to("scored", at, float(score))
                    break
            state.update((status, last, n))
            if status in ("seen", "candidate"):
                state.setTimeoutTimestamp(int((last + apart).timestamp() * 1000))
        if out:
            yield pd.DataFrame(out, columns=["title", "n", "status", "since", "score"]).astype({"score": "float64"})

    rows = stream.filter("title is not null and scrape is not null").withWatermark("scrape", late).select("title", "scrape")
    return rows.groupBy("title").applyInPandasWithState(step, TRANSITION, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def standing(changes: DataFrame) -> DataFrame:
    """(title, status, since, score): where each title stands, by its last change."""
    last = changes.groupBy("title").agg(F.max(F.struct("n", "status", "since", "score")).alias("m"))
    return last.select("title", "m.status", "m.since", "m.score")
