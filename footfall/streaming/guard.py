"""Nonces and the rate limit of beacons while they stream in, whatever batches they come in.

Two steps of managed state, one after the other. The first holds how many beacons of a visitor came in each of the last
minutes; a beacon over the limit goes. Minutes do not depend on each other, so its keys are hours of visitors. The second
holds the nonces of pages that the server has counted, each with the moment until which it may be claimed. A beacon whose
nonce is held claims it: its view is counted already, so it counts none, and the nonce is gone, so a beacon that repeats
it is an ordinary view again. Nonces do not depend on each other either, so its keys are a visitor's nonces dealt into
PARTS. So a visitor with very many beacons is in no one place, and what a task holds at once is an hour or a part of one.
Nonces and minutes are let go by timers when the watermark passes their end, so the state holds what `ttl` and two
minutes bring and not what there ever was.

Defined results: within a batch rows are taken by (ts, seq), batches one after the other; a row without a nonce or that
asks for no view claims nothing; rows older than the watermark are late and left out, as Spark does in event time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What comes in: `served` marks a page that the server counted, other rows are beacons; value: the hit in wire form.
ARRIVAL = "site_id int, visitor_hash string, ts timestamp, seq long, served boolean, nonce string, count_view boolean, value string"
GUARDED = "site_id int, visitor_hash string, ts timestamp, seq long, served boolean, nonce string, count_view boolean, value string"
#: Parts of a visitor's nonces; most visitors have fewer nonces than that in a batch.
PARTS = 64


class _Step(StatefulProcessor):
    """A row of state for each key, read and written once a batch: what is held, by name, and until which second."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", self.STATE)  # keys of a state's maps are text

    def _read(self) -> dict:
        held = self._held.get()
        return dict(held[0]) if held else {}

    def _ends(self, key: str, value: int) -> int:
        """The millisecond from which an entry is not needed any more."""
        raise NotImplementedError

    def _take(self, key: tuple, rows: list, held: dict) -> Iterator[Row]:
        raise NotImplementedError

    def _keep(self, held: dict, past: int) -> None:
        """Write what ends after the moment `past`, in milliseconds."""
        ends = {k: self._ends(k, v) for k, v in held.items()}
        if not (left := {k: v for k, v in held.items() if ends[k] > past}):
            return self._held.clear()
        self._held.update((left,))
        self._handle.registerTimer(max(ends[k] for k in left))

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803  Spark's names
        held = self._read()
        yield from self._take(key, sorted(rows, key=lambda r: (r.ts, r.seq)), held)
        self._keep(held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        if held := self._read():
            self._keep(held, expiredTimerInfo.getExpiryTimeInMs())
        return iter(())


class Limit(_Step):
    """Pages that were served pass, and the first beacons of each minute."""

    STATE = "minutes map<string,bigint>"

    def __init__(self, limit: int):
        self._limit = limit

    def _ends(self, key: str, value: int) -> int:
        return (int(key) + 2) * 60_000

    def _take(self, key: tuple, rows: list, held: dict) -> Iterator[Row]:
        for r in rows:
            if not r.served:
                minute = str(r.at // 60)
                if (n := held.get(minute, 0)) >= self._limit:
                    continue
                held[minute] = n + 1
            yield Row(site_id=key[0], visitor_hash=key[1], ts=r.ts, seq=r.seq, served=r.served, nonce=r.nonce, count_view=r.count_view, value=r.value)


class Claims(_Step):
    """Beacons with what is left of their views."""

    STATE = "nonces map<string,bigint>"

    def __init__(self, ttl: int):
        self._ttl = ttl

    def _ends(self, key: str, value: int) -> int:
        return (value + 1) * 1000

    def _take(self, key: tuple, rows: list, held: dict) -> Iterator[Row]:
        for r in rows:
            if r.served:
                if r.nonce:
                    held[r.nonce] = r.at + self._ttl
                continue
            counts = r.count_view
            if counts and r.nonce in held:
                counts = r.at > held.pop(r.nonce)
            yield Row(site_id=key[0], visitor_hash=key[1], ts=r.ts, seq=r.seq, served=False, nonce=r.nonce, count_view=counts, value=r.value)


def guarded(arrivals: DataFrame, limit: int, ttl: int, delay: str = "10 minutes") -> DataFrame:
    """The beacons of a stream of ARRIVAL rows that are within the limit, with what is left of their views."""
    at, part = F.unix_timestamp("ts"), F.pmod(F.xxhash64(F.coalesce("nonce", F.lit(""))), F.lit(PARTS)).cast("int")
    rows = arrivals.withWatermark("ts", delay).withColumns({"served": F.coalesce("served", F.lit(False)), "count_view": F.coalesce("count_view", F.lit(False))})
    few = rows.select("site_id", "visitor_hash", F.floor(at / 3600).alias("hour"), "ts", at.alias("at"), "seq", "served", "nonce", "count_view", "value")
    within = few.groupBy("site_id", "visitor_hash", "hour").transformWithState(Limit(limit), GUARDED, "Append", "EventTime", eventTimeColumnName="ts")
    left = within.withColumns({"at": at, "part": part})
    out = left.groupBy("site_id", "visitor_hash", "part").transformWithState(Claims(ttl), GUARDED, "Append", "EventTime")
    return out.withColumn("ts", F.timestamp_seconds(at)).drop("served")
