"""Parents of processes as they start: keyed state of what each process id was, forgotten with age.

A start is put to the state of its own (host, pid) and asks the state of (host, parentPid)
who that was. State is keyed by both, so a busy host is spread over its process ids. A
key keeps its newest starts only, counts those it had to forget, and is deleted by a timer
once the watermark has passed its newest start by the horizon, which bounds all state by what starts in that time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .flows import timed

#: Starts that a key keeps.
KEPT = 16
_FOUND = "id long, ts long, parent long, forgotten long"


def _base(name: str | None) -> str | None:
    return name.rsplit("\\", 1)[-1].lower() if name is not None else None


class Starts(StatefulProcessor):
    """The newest starts of one (host, pid)."""

    def __init__(self, within: int, horizon: int, kept: int) -> None:
        self.within, self.horizon, self.kept = within, horizon, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.starts = handle.getListState("starts", "ts long, id long, name string")
        self.lost = handle.getValueState("lost", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of Spark's interface
        frames = pd.concat(list(rows))
        known = [tuple(r) for r in self.starts.get()] if self.starts.exists() else []
        lost = self.lost.get()[0] if self.lost.exists() else 0
        own = frames[frames["asks"] == False]  # noqa: E712  a column
        known = sorted({*known, *zip(own["ts"].tolist(), own["id"].tolist(), own["name"].tolist(), strict=True)}, key=lambda s: s[:2])
        asked = frames[frames["asks"]]
        times, out = [s[0] for s in known], []
        for i, ts, named in zip(asked["id"].tolist(), asked["ts"].tolist(), asked["name"].tolist(), strict=True):
            at = bisect_left(times, ts) - 1  # the last start before
            found = known[at] if at >= 0 and ts - 1 - times[at] <= self.within else None
            agrees = found is not None and (named is None or _base(named) == _base(found[2]))
            out.append((i, ts, found[1] if agrees else None, lost))
        if len(own):
            lost += max(0, len(known) - self.kept)
            known = known[-self.kept :]
            self.starts.put(known)
            self.lost.update((lost,))
            self.handle.registerTimer(known[-1][0] + self.horizon)
        if out:
            yield pd.DataFrame(out, columns=["id", "ts", "parent", "forgotten"]).astype({"parent": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest = max((r[0] for r in self.starts.get()), default=None) if self.starts.exists() else None
        if newest is not None and newest + self.horizon <= expiredTimerInfo.getExpiryTimeInMs():
            self.starts.clear()
            self.lost.clear()
        return iter(())

    def close(self) -> None:
        pass


def parents(stream: DataFrame, within: int = 7 * 86_400_000, horizon: int | None = None, late: str = "10 minutes", kept: int = KEPT) -> DataFrame:
    """(id, ts, parent, forgotten) for each start (id, ts, host, pid, parentPid, name, parentName): the last earlier start of that pid on its host, if its name agrees.

    A parent counts if it started at most ``within`` ms before, is still among its key's newest ``kept`` starts, and has come in the same batch or an
    earlier one; ``forgotten`` says how many starts of the key had been let go. Keys go ``horizon`` ms (as long as ``within``) after their newest
    start. Rows later than the watermark, without a host or a time are dropped, rows without a parentPid get none. The session's
    state store has to be RocksDB's (spark.sql.streaming.stateStore.providerClass).
    """
    rows = timed(stream.where("host is not null and ts is not null"), late)
    start = F.struct(F.col("pid").alias("key"), F.lit(False).alias("asks"), F.col("name").alias("name"))
    ask = F.struct(F.coalesce("parentPid", F.lit(-1)).cast(stream.schema["pid"].dataType).alias("key"), F.lit(True).alias("asks"), F.col("parentName").alias("name"))
    events = rows.select("id", "ts", "at", F.lower("host").alias("host"), F.explode(F.array(start, ask)).alias("x")).select("id", "ts", "at", "host", "x.key", "x.asks", "x.name").where("key is not null")
    return events.groupBy("host", "key").transformWithStateInPandas(Starts(within, horizon or within, kept), _FOUND, "append", "EventTime")
