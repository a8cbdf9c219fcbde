"""Sessions in managed state: a timer closes each when its window has passed, and whoever asks reads the open ones.

The state of a visitor's key is one row, the run of hits that may still go on. A batch's hits of the key are joined to
it in time order; what lies a window or more before the last run is closed at once. The last run's timer is set to the
moment when it will have been idle for the window, in event time, so it closes when the watermark passes that moment,
whether or not anything of that visitor comes again. The state lives in RocksDB beside the checkpoint; `open_now` reads
it without touching the stream.

Defined results: crawlers take no part; a run without a counted view is no session and what precedes its first counted
view does not belong to it; hits of one second are ordered by `seq`, which `follow` makes of path and kind; hits older than the watermark are late and left
out, as Spark does in event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from footfall.sources import hits as wire

#: A run of hits: what a session is made of while it goes on, and when it has closed. Moments are epoch seconds.
RUN = (
    "visitor_hash string, started_at long, last_seen_at long, pageviews long, entry_path string, last_path string, referrer string, "
    "user_agent string, max_scroll int, first_seq long, last_seq long"
)
SESSION = f"site_id int, session_key string, {RUN}"
CLOSED = SESSION.replace("_at long", "_at timestamp")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(parts: list[dict], window: int) -> list[dict]:
    """Runs from runs and single hits: those less than `window` seconds after what came before go on with it."""
    out: list[dict] = []
    for p in sorted(parts, key=lambda p: (p["started_at"], p["first_seq"])):
        last = out[-1] if out else None
        if last is None or p["started_at"] - last["last_seen_at"] >= window:
            if p["pageviews"]:
                out.append(dict(p))
            continue
        last["pageviews"] += p["pageviews"]
        last["max_scroll"] = max(last["max_scroll"], p["max_scroll"])
        if (p["last_seen_at"], p["last_seq"]) >= (last["last_seen_at"], last["last_seq"]):
            last |= {k: p[k] for k in ("last_seen_at", "last_seq", "last_path")}
    return out


class Live(StatefulProcessor):
    def __init__(self, window: int):
        self._window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", RUN)

    def _rows(self, key: tuple, runs: list[dict]) -> Iterator[Row]:
        for r in runs:
            yield Row(site_id=key[0], session_key=key[1], **r)

    def _close_at(self, run: dict) -> int:
        """Milliseconds; a timer fires once the watermark is past it, a session closes at the moment itself."""
        return (run["last_seen_at"] + self._window) * 1000 - 1

    def _held(self) -> dict | None:
        return dict(zip([c.split(" ")[0] for c in RUN.split(", ")], self._open.get(), strict=True)) if self._open.exists() else None

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803  Spark's names
        held = self._held()
        hits = [
            {
                "visitor_hash": r.visitor_hash, "started_at": r.at, "last_seen_at": r.at, "pageviews": int(r.is_view), "entry_path": r.path, "last_path": r.path,
                "referrer": r.referrer, "user_agent": r.user_agent, "max_scroll": r.scroll or 0, "first_seq": r.seq, "last_seq": r.seq,
            } for r in rows
        ]
        runs = joined(hits + ([held] if held else []), self._window)
        if held:
            self._handle.deleteTimer(self._close_at(held))
        if runs:
            self._open.update(tuple(runs[-1].values()))
            self._handle.registerTimer(self._close_at(runs[-1]))
        yield from self._rows(key, runs[:-1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        held = self._held()
        if held and self._close_at(held) <= expiredTimerInfo.getExpiryTimeInMs():
            self._open.clear()
            yield from self._rows(key, [held])


def live_sessions(hits: DataFrame, window: int, delay: str = "10 minutes") -> DataFrame:
    """Sessions of a stream of hits as they close; `delay`: how long hits may come late."""
    view = F.coalesce((F.col("kind") == "view") & F.col("count_view"), F.lit(False))
    rows = hits.where("kind <> 'crawler'").withWatermark("ts", delay)
    few = rows.select("site_id", "session_key", "ts", F.unix_timestamp("ts").alias("at"), "seq", "path", "visitor_hash", "referrer", "user_agent", view.alias("is_view"), F.col("scroll_bucket").alias("scroll"))
    return _timed(few.groupBy("site_id", "session_key").transformWithState(Live(window), SESSION, "Append", "EventTime"))


def _timed(runs: DataFrame) -> DataFrame:
    return runs.withColumn("started_at", F.timestamp_seconds("started_at")).withColumn("last_seen_at", F.timestamp_seconds("last_seen_at"))


@contextmanager
def managed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps timers and named states; a stream takes it up when it starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def follow(spark: SparkSession, folder: str, closed: str, checkpoint: str, window: int, delay: str = "10 minutes", files_per_trigger: int = 1000) -> StreamingQuery:
    """Take in what has arrived and stop: sessions that close are appended to `closed`, once each; open ones stay in the
    state below `checkpoint`."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    found = wire.usable(wire.decode(lines)).withColumn("seq", F.xxhash64("path", "kind"))  # lines have no numbers; any fixed order will do
    with managed_state(spark):
        writer = live_sessions(found, window, delay).writeStream.format("parquet").option("path", closed).option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(availableNow=True).start()


def open_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that were open after the last batch, from the state: the columns of CLOSED."""
    held = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return _timed(held.select("key.site_id", "key.session_key", "value.*"))
