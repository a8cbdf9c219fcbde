"""Results of reports, kept beside the store until the days that they are made of change."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators.store import Store
from footfall.plans.ranges import DateRange
from footfall.plans.reports import Reports

#: Results are read for so many seconds, then made anew.
LIFE = 24 * 3600


class ReportCache:
    """A result is known by the report's name and arguments, site, range, counter, and what the store holds for these
    days: a late hit, an import, a fold or a compaction of a day in range gives it another name, one elsewhere does not.

    A range that includes today is never kept. Two jobs may make the same result at once; the first to publish counts.
    """

    def __init__(self, store: Store, life: float = LIFE):
        self.store, self.life = store, life

    def report(
        self, name: str, tables: tuple[str, ...], read: Callable[[Reports], DataFrame], site_id: int, period: DateRange, today: dt.date, counter: str = "exact", arguments: tuple = (),
    ) -> DataFrame:
        """`read` of the reports over these tables, its rows in the same order; `arguments`: what else tells its result
        apart, as values that JSON can hold. `tables` must name every rollup that it reads."""
        own, at = self.store, self.store.snapshot()

        def made(period: DateRange) -> DataFrame:
            return read(Reports(own.spark, own.cube(*tables, at=at), site_id, period, counter))

        if period.end >= today:
            return made(period)
        # a report may look at the period before as well
        first = min(period.start, period.previous().start)
        said = [name, list(arguments), site_id, period.start.isoformat(), period.end.isoformat(), counter, sorted(tables)]
        key = hashlib.sha256(json.dumps([said, own.stamp(tables, site_id, first.isoformat(), period.end.isoformat(), at)]).encode()).hexdigest()
        entry = self._entry(key)
        if entry is None:
            entry = f"results/{key}/{uuid.uuid4().hex}"
            made(period).withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{own.root}/{entry}")
            # a marker that ran out gives way; where another job was faster, both results are the same
            own._delete(f"cached/{key}")
            own._publish(f"cached/{key}", {"entry": entry})
        return own.spark.read.parquet(f"{own.root}/{entry}").orderBy("_row").drop("_row")

    def _entry(self, key: str) -> str | None:
        marker = f"cached/{key}"
        if not self.store._exists(marker) or self.store._age(marker) >= self.life:
            return None
        return self.store._read_text(marker)["entry"]

    def tidy(self) -> int:
        """Delete results that ran out, those that no marker names included; how many keys went."""
        gone = 0
        for key in self.store._names("results"):
            if self.store._age(f"results/{key}") >= self.life and self._entry(key) is None:
                self.store._delete(f"cached/{key}")
                self.store._delete(f"results/{key}")
                gone += 1
        return gone
