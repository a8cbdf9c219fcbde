"""Journeys on disk. Erasing somebody rewrites those files only that may hold them.

Every file has Bloom filters of visitors and users for its row groups, as Parquet defines them. Asked for a few visitors
Spark's scan skips the row groups that cannot hold them, so finding a subject reads filters and little else.
`root/rows/<part>/` holds what one job wrote; the manifest names the parts and, for each, the files that are no longer in
force, because an erasure wrote their other rows to a part of its own, or small ones were joined there. Maintenance is fenced as in the store.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators import governance
from footfall.operators.store import Store

SCHEMA = "site_id int, visitor_id string, session_key string, sequence int, path string, user_id int, occurred_at timestamp"
#: Up to so many subjects are looked up by the filters; for more the two columns are read and joined.
LOOKED_UP = 500
#: Files are joined to about so many bytes.
TARGET = 128 << 20


class Journeys(Store):
    def _write(self, rows: DataFrame, part: str) -> None:
        out = rows.write.option("parquet.bloom.filter.adaptive.enabled", "true")
        for c in ("visitor_id", "user_id"):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(f"{self.root}/rows/{part}")

    def _files(self, state: dict) -> list[str]:
        """Paths in force, below the root."""
        parts = state.get("parts", {})
        return [f"rows/{p}/{f}" for p, gone in parts.items() for f in self._names(f"rows/{p}") if f.endswith(".parquet") and f not in set(gone)]

    def _sizes(self, state: dict) -> dict[str, int]:
        """Bytes of each file in force."""
        out = {}
        for p, gone in state.get("parts", {}).items():
            found = self._fs.listStatus(self._path(f"{self.root}/rows/{p}")) if self._exists(f"rows/{p}") else []
            sizes = {s.getPath().getName(): s.getLen() for s in found}
            out |= {f"rows/{p}/{f}": n for f, n in sizes.items() if f.endswith(".parquet") and f not in set(gone)}
        return out

    def _of(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.root}/{f}" for f in files))

    def rows(self) -> DataFrame:
        """All journeys in force."""
        return self._of(self._files(self.manifest()))

    def append(self, batch: int, rows: DataFrame) -> bool:
        """Add a batch's journeys; False for one that is there. Batches come in the order of their numbers, and fail while
        another job maintains the journeys."""
        with self.only_one() as fence:
            state = self.manifest()
            if batch <= state.get("last", -1):
                return False
            part = f"{fence}-{uuid.uuid4().hex}"
            self._write(rows.select(*self.spark.createDataFrame([], SCHEMA).columns), part)
            self._succeed(state | {"parts": {**state.get("parts", {}), part: []}, "last": batch}, fence)
        return True

    def _matching(self, files: list[str], condition: Callable[[DataFrame], DataFrame]) -> set[str]:
        """Those of the files of which some row passes; `condition` takes rows with their `file`."""
        if not files:
            return set()
        passing = condition(self._of(files).withColumn("file", F.col("_metadata.file_path"))).select("file").distinct()
        of = {"/".join(f.split("/")[-2:]): f for f in files}
        return {of["/".join(r[0].split("/")[-2:])] for r in passing.collect()}

    def _rewrite_files(self, state: dict, files: set[str], kept: Callable[[DataFrame], DataFrame], fence: int) -> int:
        """Put what `kept` leaves of the files in a part of its own, and them out of force."""
        if files:
            part, parts = f"{fence}-{uuid.uuid4().hex}", {p: list(gone) for p, gone in state["parts"].items()}
            self._write(kept(self._of(sorted(files))), part)
            for f in sorted(files):
                parts[f.split("/")[1]].append(f.split("/")[2])
            self._succeed(state | {"parts": {**parts, part: []}}, fence)
        return len(files)

    def holding(self, visitors: DataFrame | None = None, users: DataFrame | None = None, state: dict | None = None) -> set[str]:
        """The files in force that hold one of the visitors (visitor_id) or users (user_id)."""
        files, found = self._files(state or self.manifest()), set()
        for column, subjects in (("visitor_id", visitors), ("user_id", users)):
            if subjects is not None:
                wanted = subjects.select(column).where(F.col(column).isNotNull()).distinct()
                few = [r[0] for r in wanted.limit(LOOKED_UP + 1).collect()]
                if len(few) <= LOOKED_UP:
                    found |= self._matching(files, lambda rows, c=column, few=few: rows.where(F.col(c).isin(few)))
                else:
                    found |= self._matching(files, lambda rows, c=column, w=wanted: rows.join(w, c, "left_semi"))
        return found

    def erase(self, visitors: DataFrame | None = None, users: DataFrame | None = None) -> int:
        """Let go of the journeys of visitors and users; the number of files that were rewritten.

        The rows go with the next `purge`, until when readers that began before may finish.
        """
        with self.only_one() as fence:
            state = self.manifest()
            return self._rewrite_files(state, self.holding(visitors, users, state), lambda rows: governance.erased(rows, visitors, users), fence)

    def retain(self, where: Column) -> int:
        """Let go of rows for which `where` is not true; files in which all stay are left alone."""
        with self.only_one() as fence:
            state = self.manifest()
            files = self._matching(self._files(state), lambda rows: rows.where(~F.coalesce(where, F.lit(False))))
            return self._rewrite_files(state, files, lambda rows: rows.where(where), fence)

    def join_small(self, size: int = TARGET) -> int:
        """Join files of less than half of `size` bytes to files of about `size`; the number of files that were joined.

        Rows are dealt out by visitor and time, so that a visitor is in few of the new files, with names of their own
        between their least and greatest, and one of any number of rows is still cut. Larger files are left alone, and so
        is a small one by itself. The old files stay until `purge`, as after an erasure.
        """
        with self.only_one() as fence:
            state = self.manifest()
            small = {f: n for f, n in self._sizes(state).items() if 2 * n < size}
            if len(small) < 2:
                return 0
            count = -(-sum(small.values()) // size)
            return self._rewrite_files(state, set(small), lambda rows: rows.repartitionByRange(count, "visitor_id", "occurred_at"), fence)

    def purge(self) -> int:
        """Delete files that are no longer in force and parts that no manifest names; the number of files."""
        with self.only_one() as fence:
            state, count = self.manifest(), 0
            parts = state.get("parts", {})
            for p, gone in parts.items():
                for f in gone:
                    self._delete(f"rows/{p}/{f}")
                    count += 1
            for p in set(self._names("rows")) - set(parts):
                self._delete(f"rows/{p}")
            self._succeed(state | {"parts": {p: [] for p in parts if any(f.endswith(".parquet") for f in self._names(f"rows/{p}"))}}, fence)
        return count
