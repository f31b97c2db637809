"""Views and listings as streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from gevel.operators.dedup import HOUR
from gevel.operators.rollups import first_of
from gevel.sources.dealt import upsert_dealt


#: The state store that timers and expiry need, and how often views that the watermark has passed are judged, in milliseconds.
STORE, PACE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", 60_000


class _Hourly(StatefulProcessor):
    """The views of one property. They wait until the watermark has passed them, and are then judged in their order, whatever order they came in; a user or session is forgotten an hour after its last view that counted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "viewer string", "at long")
        self.waiting = handle.getListState("waiting", "at long, id long, user_id long, session_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(r["at"], r["id"], r["user_id"], r["session_id"]) for r in rows]
        self.waiting.appendList(new)
        self._wake(at for at, *_ in new)
        return iter(())

    def _wake(self, times: Iterable[int]) -> None:
        """A timer at the end of each pace of the times, which are in microseconds."""
        for k in {t // 1000 // PACE for t in times}:
            self.handle.registerTimer((k + 1) * PACE)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        self._count(initialState["at"], initialState["user_id"], initialState["session_id"])

    def _count(self, at: int, user: int | None, session: str | None) -> None:
        for who in ([f"u{user}"] if user is not None else []) + ([f"s{session}"] if session is not None else []):
            if self._since(who, at) >= 0:
                self.last.updateValue((who,), (at,))
        self._wake([at + HOUR * 1_000_000])

    def _since(self, who: str, at: int) -> int:
        return at - self.last.getValue((who,))[0] if self.last.containsKey((who,)) else HOUR * 1_000_000

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in waiting if r[0] < upto]
        if due:
            self.waiting.put(rest) if (rest := waiting[len(due) :]) else self.waiting.clear()
        for at, ident, user, session in due:
            who = f"u{user}" if user is not None else f"s{session}"
            if self._since(who, at) >= HOUR * 1_000_000:
                self._count(at, user, session)
                yield Row(id=ident, property_id=key[0], viewer=who[1:], at=at, user_id=user, session_id=session)
        for (who,) in [k for k, (at,) in self.last.iterator() if at + HOUR * 1_000_000 <= upto]:
            self.last.removeKey((who,))


def hourly_stream(views: DataFrame, lateness: str = "10 minutes", held: DataFrame | None = None) -> DataFrame:
    """As hourly() over a stream of (id, property_id, user_id, session_id, viewed_at): each view that counts, once the watermark has passed it by a minute at most. Views later than the watermark don't count. Views without a user and a session are left to the caller, as they need no state.

    held: what hourly() has found before the stream begins; views of its last hour hold back as they would have in one long stream. State is kept in RocksDB: per property the times of users and sessions of the last hour, and the views that wait.
    """
    views.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = views.where("user_id is not null or session_id is not null").withWatermark("viewed_at", lateness)
    rows = rows.select("id", "property_id", F.col("user_id").cast("long").alias("user_id"), "session_id", "viewed_at", F.unix_micros("viewed_at").alias("at"))
    before = None
    if held is not None:
        some = held.where("user_id is not null or session_id is not null")
        before = some.select("property_id", F.col("user_id").cast("long").alias("user_id"), "session_id", F.unix_micros("viewed_at").alias("at")).groupBy("property_id")
    out = rows.groupBy("property_id").transformWithState(_Hourly(), "id long, property_id long, viewer string, at long, user_id long, session_id string", "Append", "EventTime", before)
    return out.select("id", "property_id", "viewer", F.timestamp_micros("at").alias("viewed_at"), "user_id", "session_id")


def weekly_counts(events: DataFrame, key: str, ts: str, slide: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Counts of the last seven days by key, for every slide."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, "7 days", slide).alias("week"), key).agg(F.count("*").alias("n")).select(key, F.col("week.end").alias("until"), "n")


def upsert_stream(batches: DataFrame, path: str, keys: list[str], overwrite: list[str], order: str, parts: int, checkpoint: str) -> StreamingQuery:
    """Keeps a dealt table (see gevel.sources.dealt) of the latest row for each key: each batch rewrites only the parts that its keys are in. A batch that is tried again changes nothing more. The rows of a batch are taken by `order`, the last of a key counts. The table must be there."""

    def write(df: DataFrame, number: int) -> None:
        upsert_dealt(first_of(df, keys, F.desc(order)), path, keys, overwrite, parts, f"{number}")

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
