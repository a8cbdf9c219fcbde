"""Rollups on disk: idempotent per-batch deltas over a base that is versioned by day.

`root/delta/<table>/feed=<s>/batch=<n>/attempt=<a>` holds what one attempt at a micro-batch of a source adds. A batch
counts once its marker `root/batches/<s>/<n>` is there, which is written last and names the attempt: what an attempt
that failed has left is never read, and of two attempts at one batch the first to publish its marker counts.
`root/base/<table>/version=<k>/site_id=/date=` holds what maintenance has folded, each day in the version that the
manifest names for it, so folding or compacting a day rewrites that day and no other.

Whoever reads takes one snapshot: the manifest with the highest number, then the attempts of the batches it has not
folded. All tables of a report and all steps of a fold use the same one, so batches that are written meanwhile are in
none of it, and `tidy` keeps what a snapshot may still name for a while.

Maintenance holds a numbered lock. Its number fences what it publishes: a manifest is only published by the holder of
the last lock and only as the successor of the one it read, so a job that stalled until its lease ran out and wakes
later publishes nothing, and its files lie under version names of its own.

The first value of a measure that is never overwritten (a page's element) is the base's, then that of the earliest
batch.
"""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.rollups import Cube, added_up
from footfall.plans.ranges import months_before
from footfall.schema import HOURLY, ROLLUPS, rollup_schema
from footfall.settings import Settings

#: A maintenance lock older than this many seconds is that of a job that died.
LEASE = 6 * 3600
#: What no snapshot names any more is kept this many seconds for those who took theirs before.
GRACE = 3600
#: Sources whose names begin so hold imported history.
IMPORTED = "import-"


@dataclass(frozen=True)
class Snapshot:
    """state: the manifest; batches: by source the batches it has not folded, each with the attempt that counts."""

    state: dict
    batches: dict[str, dict[int, str]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; on one machine a folder of its own."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="footfall-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def by_day(rows: DataFrame) -> DataFrame:
    """Dealt out so that a day is in few files; Spark splits large days and joins small ones."""
    return rows.hint("rebalance", "site_id", "date")


@contextmanager
def _writers(at_once: int = 6) -> Iterator[Callable[[DataFrame, str], None]]:
    """Rollups are small beside hits, so several are written at a time; all are there at the end, or it fails."""
    with ThreadPoolExecutor(at_once) as pool:
        jobs: list[Future] = []

        def write(rows: DataFrame, path: str) -> None:
            plan = by_day(rows).write.partitionBy("site_id", "date")
            jobs.append(pool.submit(inheritable_thread_target(rows.sparkSession)(plan.parquet), path))

        yield write
        for job in jobs:
            job.result()


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _age(self, name: str) -> float:
        return time.time() - self._fs.getFileStatus(self._path(f"{self.root}/{name}")).getModificationTime() / 1000

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def _publish(self, name: str, body: dict) -> bool:
        """A small file, there whole or not at all; False if it is there already, which is left alone."""
        hidden, place = self._path(f"{self.root}/new/{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        self._fs.mkdirs(place.getParent())
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        plain = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)  # without OVERWRITE
        try:
            hadoop.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(hidden, place, plain)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(hidden, False)
            return False
        return True

    def _read_text(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # state

    def manifest(self) -> dict:
        """number; versions: by table and day the version in force; folded: by source the last batch in the base;
        compacted: days before this one have no hours; since: the first day kept; fence: the lock it was written under;
        own: the sites and days of the base that hits have counted, and not imports alone."""
        numbers = [int(n) for n in self._names("manifest") if n.isdigit()]
        empty = {"number": 0, "versions": {}, "folded": {}, "compacted": "", "since": "", "fence": 0, "own": []}
        return empty | ({"number": max(numbers), **self._read_text(f"manifest/{max(numbers)}")} if numbers else {})

    def snapshot(self) -> Snapshot:
        """The store as it stands now; what is written later does not change what it shows."""
        state = self.manifest()
        pending = {s: [b for b in self.written(s) if b > state["folded"].get(s, -1)] for s in self._names("batches")}
        return Snapshot(state, {s: {b: self.note(b, s)["attempt"] for b in own} for s, own in pending.items()})

    def _succeed(self, state: dict, fence: int) -> None:
        """Publish the manifest that follows `state`, unless another maintainer has taken over since."""
        if max(self._locks()) != fence:
            raise RuntimeError("another job maintains this store now")
        body = {k: v for k, v in state.items() if k != "number"} | {"fence": fence}
        if not self._publish(f"manifest/{state['number'] + 1}", body):
            raise RuntimeError("another job has published meanwhile")

    def _locks(self) -> list[int]:
        return [int(n) for n in self._names("locks") if n.isdigit()]

    @contextmanager
    def only_one(self) -> Iterator[int]:
        """Maintenance by one job at a time; the number of its lock, or the job fails."""
        last = max(self._locks(), default=0)
        if last and not self._exists(f"locks/{last}.done") and self._age(f"locks/{last}") < LEASE:
            raise RuntimeError("another job maintains this store")
        if not self._publish(f"locks/{last + 1}", {}):
            raise RuntimeError("another job maintains this store")
        try:
            yield last + 1
        finally:
            self._publish(f"locks/{last + 1}.done", {})

    # batches

    def written(self, source: str = "hits") -> list[int]:
        return sorted(int(n) for n in self._names(f"batches/{source}") if n.isdigit())

    def note(self, batch: int, source: str = "hits") -> dict:
        """What the batch's marker says of it."""
        return self._read_text(f"batches/{source}/{batch}")

    def is_written(self, batch: int, source: str = "hits") -> bool:
        return batch <= self.manifest()["folded"].get(source, -1) or self._exists(f"batches/{source}/{batch}")

    def write_delta(self, batch: int, cube: Cube, source: str = "hits", note: dict | None = None, still_open: DataFrame | None = None) -> bool:
        """What a batch adds, and summaries of the sessions that are open after it; False for a batch that is written
        already, which is left alone."""
        if self.is_written(batch, source):
            return False
        attempt = f"a{uuid.uuid4().hex}"
        with _writers() as write:
            for name, rows in cube.tables.items():
                write(rows, f"{self.root}/delta/{name}/feed={source}/batch={batch}/attempt={attempt}")
        if still_open is not None:
            still_open.write.parquet(f"{self.root}/open/{batch}/{attempt}")
        if not self._publish(f"batches/{source}/{batch}", {**(note or {}), "attempt": attempt}):
            return False
        if still_open is not None:
            self._delete(f"open/{batch - 2}")  # the one before may be read again by a replay
        return True

    # reading

    def _delta(self, name: str, at: Snapshot) -> DataFrame | None:
        if not any(at.batches.values()) or not self._names(f"delta/{name}"):
            return None
        wanted = F.lit(False)
        for s, own in at.batches.items():
            if own:
                wanted = wanted | ((F.col("feed") == s) & F.col("batch").isin(list(own)) & F.col("attempt").isin(list(own.values())))
        rows = self._read(f"delta/{name}", f"{rollup_schema(name)}, feed string, batch int, attempt string")
        return rows.where(wanted).withColumn("_order", F.col("batch").cast("long")).drop("feed", "batch", "attempt")

    def _read(self, folder: str, schema: str) -> DataFrame:
        """The files below a folder, with the partition columns that their paths name."""
        path = f"{self.root}/{folder}"
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)

    def _base(self, name: str, at: Snapshot) -> DataFrame | None:
        days = at.state["versions"].get(name, {})
        if not days:
            return None
        of: dict[str, list[str]] = {}
        for day, version in days.items():
            of.setdefault(version, []).append(day)
        rows = self._read(f"base/{name}", f"{rollup_schema(name)}, version string")
        wanted = F.lit(False)
        for version, own in of.items():
            wanted = wanted | ((F.col("version") == version) & F.col("date").isin([F.lit(d).cast("date") for d in own]))
        return rows.where(wanted).withColumn("_order", F.lit(-1).cast("long")).drop("version")

    def table(self, name: str, where: Column | None = None, at: Snapshot | None = None) -> DataFrame | None:
        """A rollup at a snapshot, or now; `where`: a condition on site_id and date, which reaches the partitions."""
        at = at or self.snapshot()
        parts = [x for x in (self._base(name, at), self._delta(name, at)) if x is not None]
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if at.state["since"]:
            rows = rows.where(F.col("date") >= F.lit(at.state["since"]).cast("date"))
        return added_up(rows if where is None else rows.where(where), name)

    def cube(self, *names: str, at: Snapshot | None = None) -> Cube:
        """All rollups of one snapshot, or those named; what nothing was written to has no rows."""
        at = at or self.snapshot()
        tables = {n: self.table(n, at=at) for n in names or ROLLUPS}
        return Cube({n: self.spark.createDataFrame([], rollup_schema(n)) if t is None else t for n, t in tables.items()})

    # maintenance

    def rewrite(self, change: Callable[[str, DataFrame], DataFrame], also: Callable[[str, str], bool] = lambda name, day: False, **state: str) -> list[str]:
        """Fold all written batches, and the days of the base that `also` names, through `change`; the days rewritten.

        Days that neither a batch nor `also` touches keep their version and files. Batches that are written while it
        runs wait for the next.
        """
        with self.only_one() as fence:
            return self._rewrite(fence, change, also, **state)

    def _rewrite(self, fence: int, change: Callable[[str, DataFrame], DataFrame], also: Callable[[str, str], bool], **state: str) -> list[str]:
        at, touched = self.snapshot(), set()
        version = f"{at.state['number'] + 1}-{fence}"
        versions = {name: dict(days) for name, days in at.state["versions"].items()}
        with _writers() as write:
            for name in ROLLUPS:
                days = {d for d in versions.get(name, {}) if also(name, d)} | self._days(name, at)
                if days:
                    rows = self.table(name, F.col("date").isin([F.lit(d).cast("date") for d in sorted(days)]), at)
                    write(change(name, rows), f"{self.root}/base/{name}/version={version}")
                    versions.setdefault(name, {}).update(dict.fromkeys(sorted(days), version))
                    touched |= days
        folded = at.state["folded"] | {s: max(own) for s, own in at.batches.items() if own}
        fresh = {x for s in at.batches if not s.startswith(IMPORTED) for name in ("pages", "sessions") for x in self._touched(name, s, at)}
        own = sorted({*map(tuple, at.state["own"]), *fresh})
        self._succeed(at.state | {"versions": versions, "folded": folded, "own": own} | state, fence)
        return sorted(touched)

    def _days(self, name: str, at: Snapshot) -> set[str]:
        """The days that the batches of a snapshot add to, from the names of their folders."""
        return {day for source in at.batches for _, day in self._touched(name, source, at)}

    def _touched(self, name: str, source: str, at: Snapshot) -> set[tuple[int, str]]:
        """Sites and days of a rollup that a source's batches add to."""
        return {
            (int(site.partition("=")[2]), day.partition("=")[2])
            for batch, attempt in at.batches.get(source, {}).items()
            for place in [f"delta/{name}/feed={source}/batch={batch}/attempt={attempt}"]
            for site in self._names(place) if "=" in site
            for day in self._names(f"{place}/{site}") if "=" in day
        }

    def own_days(self, site_id: int, at: Snapshot | None = None) -> list[str]:
        """The days of a site that its own hits have counted, folded and compacted ones included."""
        at = at or self.snapshot()
        fresh = {x for s in at.batches if not s.startswith(IMPORTED) for name in ("pages", "sessions") for x in self._touched(name, s, at)}
        return sorted(d for s, d in {*map(tuple, at.state["own"]), *fresh} if s == site_id)

    def stamp(self, tables: tuple[str, ...], site_id: int, start: str, end: str, at: Snapshot) -> list:
        """What the days of a site in these tables consist of at a snapshot: versions, and attempts that add to them.

        Two snapshots with the same stamp hold the same rows there, whatever else has come or was folded meanwhile.
        """
        versions = [[n, d, v] for n in tables for d, v in sorted(at.state["versions"].get(n, {}).items()) if start <= d <= end]
        fresh = []
        for source, own in sorted(at.batches.items()):
            for batch, attempt in sorted(own.items()):
                one = Snapshot(at.state, {source: {batch: attempt}})
                if any(s == site_id and start <= d <= end for n in tables for s, d in self._touched(n, source, one)):
                    fresh.append([source, batch, attempt])
        return [versions, fresh, max(at.state["since"], start)]

    def compact(self, today: dt.date, settings: Settings) -> list[str]:
        """Fold hours older than the window into days; running it again rewrites nothing."""
        cutoff = today - dt.timedelta(days=settings.hourly_window_days)
        with self.only_one() as fence:
            before = self.manifest()["compacted"]

            def due(name: str, day: str) -> bool:
                return name in HOURLY and before <= day < cutoff.isoformat()

            return self._rewrite(fence, lambda name, rows: compacted(rows, name, cutoff), due, compacted=max(before, cutoff.isoformat()))

    def retain(self, today: dt.date, settings: Settings) -> str:
        """Let go of days before the months kept: the manifest forgets them, `tidy` deletes their files."""
        cutoff = months_before(today, settings.retention_months).isoformat()
        with self.only_one() as fence:
            state = self.manifest()
            versions = {name: {d: v for d, v in days.items() if d >= cutoff} for name, days in state["versions"].items()}
            own = [x for x in state["own"] if x[1] >= cutoff]
            self._succeed(state | {"versions": versions, "since": max(state["since"], cutoff), "own": own}, fence)
        return cutoff

    def tidy(self, grace: float = GRACE) -> None:
        """Delete what no manifest of the last `grace` seconds and no marker names: deltas that are folded, attempts that
        do not count, versions of days that are not in force."""
        with self.only_one() as fence:
            numbers = sorted(int(n) for n in self._names("manifest") if n.isdigit())
            numbers = [0, *numbers] if numbers[:1] == [1] else numbers  # before the first nothing was folded
            # a manifest is in use until `grace` after the one that follows it
            live = [n for n, after in zip(numbers, [*numbers[1:], None], strict=True) if after is None or self._age(f"manifest/{after}") < grace]
            states = [self._read_text(f"manifest/{n}") if n else {"versions": {}, "folded": {}} for n in live]
            for name in ROLLUPS:
                for feed in self._names(f"delta/{name}"):
                    source = feed.partition("=")[2]
                    last = min((s["folded"].get(source, -1) for s in states), default=-1)
                    for n in [x for x in self._names(f"delta/{name}/{feed}") if "=" in x]:
                        batch, folder = int(n.partition("=")[2]), f"delta/{name}/{feed}/{n}"
                        if batch <= last:
                            self._delete(folder)
                        elif self._exists(f"batches/{source}/{batch}"):
                            counts = f"attempt={self.note(batch, source)['attempt']}"
                            for a in [x for x in self._names(folder) if x != counts and self._age(f"{folder}/{x}") >= grace]:
                                self._delete(f"{folder}/{a}")
                kept = {(v, d) for s in states for d, v in s["versions"].get(name, {}).items()}
                for v in [x for x in self._names(f"base/{name}") if self._age(f"base/{name}/{x}") >= grace]:
                    for site in self._names(f"base/{name}/{v}"):
                        for day in self._names(f"base/{name}/{v}/{site}"):
                            if "=" in day and (v.partition("=")[2], day.partition("=")[2]) not in kept:
                                self._delete(f"base/{name}/{v}/{site}/{day}")
            for n in set(numbers) - set(live):
                self._delete(f"manifest/{n}")
            for n in [x for x in self._names("locks") if int(x.partition(".")[0]) < fence]:
                self._delete(f"locks/{n}")

    # what went wrong

    def count_malformed(self, batch: int, lines: int) -> None:
        if lines:
            self._publish(f"malformed/{batch}", {"lines": lines})

    def malformed(self) -> int:
        """Lines of the stream that could not be read or had no valid site or visitor."""
        return sum(self._read_text(f"malformed/{n}")["lines"] for n in self._names("malformed"))

    def failed(self) -> list[str]:
        return [n for n in self._names("failed") if n.startswith("batch=")]

    # open sessions

    def open_sessions(self, batch: int, schema: str) -> DataFrame:
        """Summaries of the sessions that were open after a batch."""
        if batch < 0 or not self._exists(f"batches/hits/{batch}"):
            return self.spark.createDataFrame([], schema)
        place = f"open/{batch}/{self.note(batch)['attempt']}"
        return self.spark.read.schema(schema).parquet(f"{self.root}/{place}") if self._exists(place) else self.spark.createDataFrame([], schema)


def compacted(rows: DataFrame, table: str, cutoff: dt.date) -> DataFrame:
    """Hours of days before `cutoff` as one daily row (hour -1), an earlier daily row included."""
    if table not in HOURLY:
        return rows
    old = F.col("date") < F.lit(cutoff.isoformat()).cast("date")
    ready = rows
    if table == "pages":
        # the day's own element first, then the earliest hour's
        keys = ("site_id", "date", "path")
        first = rows.where(old & F.col("element_id").isNotNull()).groupBy(*keys).agg(F.min_by("element_id", "hour").alias("_element"))
        ready = rows.join(first, list(keys), "left").withColumn("element_id", F.when(old, F.col("_element")).otherwise(F.col("element_id"))).drop("_element")
    return added_up(ready.withColumn("hour", F.when(old, F.lit(-1)).otherwise(F.col("hour"))), table)


def orphans(dimension: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Dimension rows (type, value) that no rollup refers to any more."""
    every = None
    for rows in used:
        every = rows if every is None else every.union(rows)
    return dimension.join(every.distinct(), ["type", "value"], "left_anti")


def dimensions(cube: Cube) -> DataFrame:
    """(type, value) of every text value that the rollups hold."""
    places = {
        "path": [("pages", "path"), ("page_sources", "path"), ("events", "path"), ("scroll", "path"), ("outbound", "path")],
        "host": [("sources", "host"), ("page_sources", "host")], "browser": [("devices", "browser")], "os": [("devices", "os")],
        "event_name": [("events", "event_name")], "crawler": [("crawlers", "crawler")], "segment": [("segments", "segment")],
        "search_term": [("search", "term")], "outbound_host": [("outbound", "host")], "outbound_url": [("outbound", "target")],
        "campaign_source": [("campaigns", "source")], "campaign_medium": [("campaigns", "medium")], "campaign_name": [("campaigns", "campaign")],
        "campaign_term": [("campaigns", "term")], "campaign_content": [("campaigns", "content")], "region": [("geo", "region")],
    }
    every = None
    for kind, columns in places.items():
        for table, column in columns:
            if table in cube.tables:
                own = cube[table].select(F.lit(kind).alias("type"), F.left(F.col(column), F.lit(500)).alias("value")).where("coalesce(value, '') <> ''").distinct()
                every = own if every is None else every.union(own)
    return every.distinct()
