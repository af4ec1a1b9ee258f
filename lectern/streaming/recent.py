"""Recent searches kept over a stream of searches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Searches that are kept for a user.
SIZE = 5


def last_seen(events: DataFrame, user: str, what: str, when: str, late: str = "1 hour") -> DataFrame:
    """Per user and folded value the last time it was seen, in days: state older than the watermark goes."""
    day = F.window(when, "1 day")
    return events.withWatermark(when, late).groupBy(user, F.lower(what).alias("folded"), day).agg(F.max(when).alias("seen")).select(user, "folded", "seen")


def remembered(kept: list[tuple[int, str]], new: list[tuple[int, str]], size: int = SIZE) -> list[tuple[int, str]]:
    """The last ``size`` different searches, newest first, of (time, text): case aside, as last written; no blank ones.

    Times decide, not the order of arrival; of equal times the text.
    """
    last: dict[str, tuple[int, str]] = {}
    for at, text in sorted([*kept, *((at, text.strip()) for at, text in new)]):
        if text:
            last[text.lower()] = at, text
    return sorted(last.values(), key=lambda r: (-r[0], r[1]))[:size]


def recent_searches(events: DataFrame, user: str, what: str, when: str, late: str = "1 hour", keep: str = "90 days", size: int = SIZE) -> DataFrame:
    """Each user's last ``size`` searches after every batch that brings one: user, searches (newest first), seen.

    The list is state of the user, a few texts, in the stream's checkpoint.
    Searches later than the watermark are dropped by it; a user who has not
    searched for ``keep`` of the events' time is forgotten and gives an empty
    list.  Null users, texts and times give nothing.
    """
    millis = int(pd.Timedelta(keep).total_seconds() * 1000)
    key = events.schema[user].dataType
    out = T.StructType([T.StructField(user, key), T.StructField("searches", T.ArrayType(T.StringType())), T.StructField("seen", T.TimestampType())])
    state = T.StructType([T.StructField("times", T.ArrayType(T.LongType())), T.StructField("texts", T.ArrayType(T.StringType()))])

    def step(who: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame({user: [who[0]], "searches": [[]], "seen": [pd.NaT]}).astype({"seen": "datetime64[ns]"})
            return
        kept = list(zip(*held.get)) if held.exists else []
        new = [r for f in frames for r in zip(f["__micros"].tolist(), f["__search"].tolist())]
        now = remembered(kept, new, size)
        if not now:
            return
        held.update(([at for at, _ in now], [text for _, text in now]))
        held.setTimeoutTimestamp(max(now[0][0] // 1000, held.getCurrentWatermarkMs()) + millis)
        yield pd.DataFrame({user: [who[0]], "searches": [[text for _, text in now]], "seen": [pd.Timestamp(now[0][0], unit="us")]})

    own = events.where(F.col(user).isNotNull() & F.col(what).isNotNull() & F.col(when).isNotNull()).withWatermark(when, late)
    told = own.select(user, when, F.unix_micros(when).alias("__micros"), F.col(what).alias("__search"))
    return told.groupBy(user).applyInPandasWithState(step, out, state, "update", GroupStateTimeout.EventTimeTimeout)
