"""Hits from a folder of JSON lines into the rollup store, each micro-batch exactly once.

A micro-batch adds the rollups of its hits, and those of the sessions that it brings to a close. Sessions that may
still go on are kept in the store as summaries, one row each; a batch's own summaries are added to them, so what is
held follows open sessions and not hits, and every column of a session is there when it closes. A batch that is
replayed after a crash reads the same summaries and writes the same files; its marker is written last. Micro-batches of
many hits may be taken in by slices (`streaming.slices`), each of which counts like a batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.functions import traffic, urls
from footfall.operators import rollups
from footfall.operators import sessions as ses
from footfall.operators.goals import Definitions
from footfall.operators.rollups import ChannelRules, Cube
from footfall.operators.store import Snapshot, Store
from footfall.settings import Settings
from footfall.sources import hits as wire
from footfall.streaming import slices


@dataclass(frozen=True)
class Hooks:
    """What a site adds: a change or veto before hits count, and channel rules of its own."""

    before: Callable[[DataFrame], DataFrame] = lambda hits: hits
    channels: ChannelRules = ()


def with_search_term(hits: DataFrame, settings: Settings) -> DataFrame:
    """Search terms come from the page address, which the wire form keeps; hits that have one keep theirs."""
    plain = F.substring_index("path", "?", 1)
    query = F.when(F.col("path").contains("?"), F.substring_index("path", "?", -1)).otherwise("")
    found = urls.search_term(plain, query, settings.search_path, settings.search_param)
    return hits.withColumn("search_term", F.coalesce("search_term", found))


def apply(
    store: Store, hits: DataFrame, batch: int, settings: Settings, definitions: Definitions | None = None, hooks: Hooks | None = None,
    as_of: int | None = None, source: str = "hits", note: dict | None = None,
) -> bool:
    """Add one batch of usable hits; False if it has been added before.

    A session closes when nothing of it came for the window before `as_of` (epoch seconds); without one, before the
    newest hit so far. A view counts for the source by which its session arrived, as far as it is known by then.
    Within a batch `seq` orders hits of one second; batches order by their number. `note`: what its marker says besides.
    """
    if store.is_written(batch, source):
        return False
    hooks, tz = hooks or Hooks(), settings.timezone
    place = F.col("seq").bitwiseAND(F.lit((1 << 40) - 1)) + F.lit(batch << 40)
    rows = with_search_term(hooks.before(hits), settings).withColumn("seq", place).persist()
    window = settings.session_window
    held: list[DataFrame] = [rows]
    try:
        before = store.note(batch - 1, source).get("as_of") if batch - 1 in store.written(source) else None
        parts = ses.summaries(rows, window, definitions, settings.segments or None).unionByName(store.open_sessions(batch - 1, ses.SUMMARY))
        together = rollups.kept(ses.merged(parts, window))
        held.append(together)
        newest, first = rows.agg(F.max(F.unix_timestamp("ts")), F.min(F.unix_timestamp("ts"))).first()
        begun = together.agg(F.min(F.unix_timestamp("first_at.ts"))).first()[0]
        reached = max([x for x in (newest, before) if x is not None], default=None)
        now = reached if as_of is None else as_of
        over = F.lit(now is not None) & ses.closed_by(F.unix_timestamp("last_at.ts"), F.lit(now), window)
        still_open = together.where(~F.coalesce(over, F.lit(False)))
        closed = rollups.kept(ses.finished(together.where(over), definitions=definitions))  # every rollup of sessions reads it
        held.append(closed)
        at = store.snapshot()
        numbers, fresh, after = _numbers(store, rows, batch, source, settings, at, first)
        if fresh is not None:
            held.append(fresh)
        cube = rollups.fold_hits(rows, settings, numbers).merged(rollups.fold_sessions(closed, settings, definitions, hooks.channels))
        cube = cube.merged(Cube({"page_sources": rollups.page_arrivals(_arrived(rows, together), tz, hooks.channels)}))
        cube = Cube({name: rollups.kept(table) for name, table in cube.tables.items()})  # rollups of one batch
        held += cube.tables.values()
        oldest = min([x for x in (first, begun) if x is not None], default=0)
        recent = F.col("date") >= F.date_sub(F.to_date(F.timestamp_seconds(F.lit(oldest))), 1)
        capped = rollups.capped_cube(cube, settings.dimension_cap, lambda name: store.table(name, recent, at), _came(rows, closed, together, tz))
        if fresh is not None:
            capped.tables["visitors"] = fresh
        return store.write_delta(batch, capped, source, {**(note or {}), "as_of": reached, "visitors": after}, still_open)
    finally:
        for df in held:
            df.unpersist()


def _numbers(store: Store, rows: DataFrame, batch: int, source: str, settings: Settings, at: Snapshot, first: int | None) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Where visitors are counted in bitmaps: the numbers of the batch's visitors, those that are new, and the last.

    A hash lives as long as its salt, so only the visitors of so many days are looked up.
    """
    after = (store.note(batch - 1, source).get("visitors") or 0) if batch - 1 in store.written(source) else 0
    if settings.unique_counter != "bitmap":
        return None, None, after
    days = -(-settings.salt_rotation_interval // 86_400) + 1
    recent = F.col("date") >= F.date_sub(F.to_date(F.timestamp_seconds(F.lit(first or 0))), days)
    known = store.table("visitors", recent, at)
    fresh = rollups.new_visitors(rows, settings.timezone, known, after).persist()
    own = fresh.select("site_id", "visitor_hash", "number")
    return own if known is None else own.union(known.select("site_id", "visitor_hash", "number")), fresh, after + fresh.count()


def _came(rows: DataFrame, closed: DataFrame, together: DataFrame, tz: str) -> dict[str, DataFrame]:
    """When the batch's values came; a view's source came when its session started."""
    came = rollups.arrivals(rows, closed, tz)
    views = _arrived(rows, together)
    host = F.coalesce(traffic.referrer_host(F.col("arrived_from")), F.lit(""))
    of_views = views.select("site_id", traffic.local_date(F.col("ts"), tz).alias("date"), host.alias("value"), F.unix_timestamp("began").alias("seq"))
    return came | {"host": came["host"].union(of_views)}


def _arrived(hits: DataFrame, together: DataFrame) -> DataFrame:
    """Counted views with their session's referrer, met by session key and time."""
    own = together.select(*ses.KEYS, F.col("first_at").alias("_from"), F.col("last_at").alias("_to"), F.col("first.referrer").alias("arrived_from"), F.col("first_at.ts").alias("began"), (F.size("touches") > 0).alias("by_campaign"))
    views = hits.where(ses.is_view()).withColumn("_at", F.struct("ts", "seq"))
    return views.join(own, list(ses.KEYS)).where("_at >= _from and _at <= _to").drop("_at", "_from", "_to")


def hit_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000, bytes_per_trigger: int | None = None) -> DataFrame:
    """Decoded hits of all files that arrive in `folder`, those that are malformed marked.

    A batch takes so many files, or, where `bytes_per_trigger` is given, files of so many bytes in all, and one at least.
    """
    return wire.decode(_lines(spark, folder, files_per_trigger, bytes_per_trigger))


def _lines(spark: SparkSession, folder: str, files_per_trigger: int, bytes_per_trigger: int | None) -> DataFrame:
    name, most = ("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else ("maxBytesPerTrigger", bytes_per_trigger)
    return spark.readStream.option(name, most).text(folder)


def roll_up(
    spark: SparkSession, folder: str, store_root: str, checkpoint: str, settings: Settings, definitions: Definitions | None = None,
    hooks: Hooks | None = None, files_per_trigger: int = 1000, attempts: int = 3, bytes_per_trigger: int | None = None,
    hits_per_slice: int | None = None, budget: slices.Budget | None = None,
) -> StreamingQuery:
    """Take in what has arrived and stop; run it again for more. A batch takes up so many files, or files of so many bytes.

    Where `hits_per_slice` is given, a micro-batch is taken in by slices of at most so many hits, also inside of a file,
    and `budget` says how many slices a run may take in; when it is spent the stream fails with `slices.BudgetSpent`
    (`drain` ends without) and the next run goes on with the slice after. The sessions that a slice leaves open go on in
    the next. Slices are applied one after the other, so they should not be small beside what a batch has.

    A batch or slice that fails so many times by what is in it is set aside: its lines go to
    `store_root/failed/batch=<n>` for `retry_failed`, its marker keeps the error, and the stream goes on. Where the storage
    or the cluster is at fault, the stream stops instead and takes the batch up again when it is run again. Malformed
    lines are counted in `store_root/malformed`.
    """
    store, budget = Store(spark, store_root), budget or slices.Budget()

    def take(hits: DataFrame, number: int, note: dict) -> None:
        budget.take()
        work = lambda: apply(store, hits, number, settings, definitions, hooks, note=note)
        _tried(store, number, attempts, work, lambda e: set_aside(store, hits, number, e, note))

    def whole(batch: DataFrame, epoch: int, number: int) -> None:
        marked = batch.withColumn("_id", F.monotonically_increasing_id())
        # partition and row as 14 and 26 bits
        seq = F.shiftleft(F.shiftright("_id", 33), 26) + F.col("_id").bitwiseAND(F.lit((1 << 26) - 1))
        lines = marked.withColumn("seq", seq).drop("_id", "file").persist()
        try:
            take(wire.usable(lines), number, {"epoch": epoch})
            store.count_malformed(epoch, lines.where("malformed").count())
        finally:
            lines.unpersist()

    def each(batch: DataFrame, epoch: int) -> None:
        at = slices.progress(store, epoch)
        own = slices.Slices(store, epoch)
        plan = own.plan() if at.slice is not None else None
        if at.slice is not None and plan is None and hits_per_slice is not None:
            lines = batch.persist()
            try:
                store.count_malformed(epoch, lines.where("malformed").count())
                plan = own.cut(wire.usable(lines), hits_per_slice)
            finally:
                lines.unpersist()
        if at.slice is not None and plan is None:
            whole(batch, epoch, at.batch)
        elif plan is not None:
            for n, part in enumerate(range(at.slice, plan["slices"])):
                take(own.read(plan, part), at.batch + n, {"epoch": epoch, "slice": part, "slices": plan["slices"]})
        own.clear()

    lines = _lines(spark, folder, files_per_trigger, bytes_per_trigger)
    file = F.struct(*(F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_path", "file_block_start"))).alias("file")
    decoded = wire.decode(lines.select("value", file), "file")
    return decoded.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(spark: SparkSession, folder: str, store_root: str, checkpoint: str, settings: Settings, most: int | None = None, hits_per_slice: int = 20_000, **options) -> int:
    """`roll_up` by slices until all is taken in, or `most` slices are; how many were. `options` are those of `roll_up`."""
    budget = slices.Budget(most)
    query = roll_up(spark, folder, store_root, checkpoint, settings, hits_per_slice=hits_per_slice, budget=budget, **options)
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not budget.spent:
            raise
    return budget.taken


#: Java exceptions of the storage or the cluster, which pass, whatever a batch holds.
PASSING = ("java.io.IOException", "java.io.FileNotFoundException", "java.io.EOFException", "java.net.", "java.nio.file.FileSystemException", "java.lang.OutOfMemoryError", "org.apache.hadoop.", "org.apache.spark.shuffle.")
# End of fixed values.


def is_passing(error: BaseException) -> bool:
    """Whether a failure is one of storage, network or memory somewhere in its causes."""
    if isinstance(error, OSError | MemoryError):
        return True
    cause, seen = getattr(error, "java_exception", None) or getattr(error, "_origin", None), 0
    while cause is not None and seen < 50:
        if any(line.startswith(PASSING) for line in (cause.getClass().getName(), *(cause.getMessage() or "").split("Caused by: ")[1:])):
            return True
        cause, seen = cause.getCause(), seen + 1
    return False


def _tried(store: Store, number: int, attempts: int, work: Callable[[], object], give_up: Callable[[BaseException], None]) -> None:
    for left in reversed(range(attempts)):
        try:
            work()
            return
        except Exception as e:  # noqa: BLE001  whatever a batch fails by, the stream must outlive it
            if not left:
                if is_passing(e):
                    raise
                give_up(e)


def set_aside(store: Store, hits: DataFrame, number: int, error: BaseException | None = None, note: dict | None = None) -> None:
    """Keep a batch's hits for later and pass over its number; the sessions that were open stay open.

    Nothing that earlier attempts have written counts.
    """
    wire.encode(hits).write.mode("overwrite").text(f"{store.root}/failed/batch={number}")
    before = store.note(number - 1) if number - 1 in store.written() else {}
    carried = (note or {}) | {k: before.get(k) for k in ("as_of", "visitors")}
    store.write_delta(number, Cube(), "hits", {"failed": True, "error": str(error)[:2000], **carried}, store.open_sessions(number - 1, ses.SUMMARY))


def retry_failed(store: Store, landing: str) -> int:
    """Put the hits that were set aside back where new ones land; the number of batches."""
    folders = store.failed()
    for name in folders:
        store.spark.read.text(f"{store.root}/failed/{name}").select("value").write.mode("append").text(landing)
        store._delete(f"failed/{name}")
    return len(folders)
