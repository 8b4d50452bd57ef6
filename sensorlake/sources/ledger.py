"""Keyed tables that lose no row: append-only deltas, a committed list of them, last-row reads.

    <path>/data/delta=<name>/day=<day>/*.parquet    rows, written once and never changed
    <path>/log/<version>.json                       the deltas that make up the table, in order

An upsert writes its rows as a new delta and then commits the next version of the list, which names
it last. Nothing that a reader sees changes before the commit, and no old row is rewritten, so a
writer that dies anywhere leaves the table as it was; the files of a write without commit are never
read. A commit creates a file that must not exist: of two writers one takes the version, the other
reads the new list and appends itself there. A list also holds the last batch of every stream, so
that a replayed batch is recognised. Reading takes the last row of every key over all deltas;
``compact`` merges neighbouring deltas so that there are few.

A list is complete in itself and has one entry per delta, a number that compaction bounds. The folder
must offer exclusive creation or rename without replacing, as streaming checkpoints need too.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Neighbouring deltas of one size class that are merged together.
FAN_IN = 16
DELTA, DAY = "delta", "day"
_SEEN = "_place"


class Conflict(RuntimeError):
    """Another writer took the version."""


class Ledger:
    """A table of rows with a timestamp, one per ``keys``, at ``path``.

    Of rows with equal keys the one of the later delta stays, inside a delta the one with the
    greatest ``order`` (names compared one after the other, nulls first); it is taken whole. Columns
    named ``day``, ``delta``, ``_place`` or ``_row`` are refused.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: Iterable[str] = (), ts: str = "ts"):
        self.spark, self.path, self.keys, self.order, self.ts = spark, path.rstrip("/"), keys, list(order), ts
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(self._conf)

    # --- the list of deltas

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/log")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> dict:
        """The committed list: ``version, deltas [{name, size_class}], streams, from_day, schema``."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": -1, "deltas": [], "streams": {}, "from_day": None, "schema": None}
            version = known[-1]
        stream = self._fs.open(self._path(self._file(version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _file(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def _commit(self, snapshot: dict) -> None:
        """Creates the file of the snapshot's version, whole, or raises ``Conflict``."""
        target, text = self._file(snapshot["version"]), json.dumps(snapshot)
        staged = f"{self.path}/log/.{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(f"{self.path}/log"))
        out = self._fs.create(self._path(staged), False)
        out.write(text.encode())
        out.close()
        try:
            if self._fs.getScheme() == "file":
                # Renaming replaces here; a link does not.
                os.link(urlparse(staged).path, urlparse(target).path)
            else:
                jvm = self.spark._jvm
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(target).toUri(), self._conf)
                context.rename(self._path(staged), self._path(target), none)
        except FileExistsError as taken:
            raise Conflict(target) from taken
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            raise Conflict(target) from error
        finally:
            self._fs.delete(self._path(staged), False)

    def _change(self, change) -> dict:
        """Commits ``change(snapshot)`` on the newest list, again where another writer was faster.

        ``change`` returns the fields that are new, or ``None`` to leave the table as it is.
        """
        while True:
            old = self.snapshot()
            fields = change(old)
            if fields is None:
                return old
            new = {**old, **fields, "version": old["version"] + 1}
            try:
                self._commit(new)
            except Conflict:
                continue
            return new

    # --- writing

    def _write(self, rows: DataFrame) -> str:
        """Writes a delta by days; days are dealt by size, so a large one is several files."""
        taken = {DAY, DELTA, _SEEN, "_row"}.intersection(rows.columns)
        if taken:
            raise ValueError(f"rename the columns {sorted(taken)} first")
        name = uuid.uuid4().hex
        dated = rows.withColumn(DAY, F.to_date(self.ts)).hint("rebalance", DAY)
        dated.write.partitionBy(DAY).parquet(f"{self.path}/data/{DELTA}={name}")
        return name

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> dict:
        """Adds ``rows`` as one delta. Costs what the rows cost, whatever the table holds.

        With ``stream`` and ``batch`` (rising numbers) a batch that was committed before is left out.
        """

        def done(snapshot: dict) -> bool:
            return stream is not None and snapshot["streams"].get(stream, -1) >= batch

        snapshot = self.snapshot()
        if done(snapshot):
            return snapshot
        name = self._write(self._last(rows, self.order))

        def change(old: dict) -> dict | None:
            if done(old):
                return None
            return {
                "deltas": [*old["deltas"], {"name": name, "size_class": 0}],
                "streams": old["streams"] if stream is None else {**old["streams"], stream: batch},
                "schema": _widened(old["schema"], rows.schema),
            }

        return self._change(change)

    def replace(self, rows: DataFrame) -> dict:
        """Makes ``rows``, which may be read from this table, its whole content, in one commit."""
        name = self._write(self._last(rows, self.order))
        return self._change(
            lambda old: {"deltas": [{"name": name, "size_class": 0}], "schema": rows.schema.jsonValue()}
        )

    def drop_before(self, day: str) -> dict:
        """Rows of earlier days are no longer read; compaction leaves them out."""
        return self._change(
            lambda old: None if old["from_day"] and old["from_day"] >= day else {"from_day": day}
        )

    # --- reading

    def _deltas(self, snapshot: dict, names: list[str]) -> DataFrame:
        schema = StructType.fromJson(snapshot["schema"])
        full = StructType([*schema.fields]).add(DAY, "date").add(DELTA, "string")
        folders = [f"{self.path}/data/{DELTA}={n}" for n in names]
        rows = self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*folders)
        if snapshot["from_day"]:
            rows = rows.filter(F.col(DAY) >= F.lit(snapshot["from_day"]).cast("date"))
        places = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
        return rows.withColumn(_SEEN, F.element_at(places, F.col(DELTA)))

    def _last(self, rows: DataFrame, order: list[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        by = F.struct(*order) if order else F.struct(*rest)
        best = F.max_by(F.struct(*rest), by).alias("_row")
        return rows.groupBy(*self.keys).agg(best).select(
            *[F.col(c) if c in self.keys else F.col(f"_row.{c}").alias(c) for c in rows.columns]
        )

    def read(self, version: int | None = None, days: tuple[str, str] | None = None) -> DataFrame:
        """The last row of every key, now or as of ``version``. With ``days`` only these days (both
        included) are scanned. All rows of a key have one time if ``ts`` is among the keys."""
        snapshot = self.snapshot(version)
        if snapshot["schema"] is None:
            raise FileNotFoundError(f"no committed version at {self.path}")
        columns = [f["name"] for f in snapshot["schema"]["fields"]]
        names = [d["name"] for d in snapshot["deltas"]]
        rows = self._deltas(snapshot, names)
        if days:
            rows = rows.filter(F.col(DAY).between(*[F.lit(d).cast("date") for d in days]))
        if len(names) == 1:
            return rows.select(*columns)
        return self._last(rows.drop(DELTA, DAY), [_SEEN, *self.order]).select(*columns)

    # --- upkeep

    def compact(self, fan_in: int = FAN_IN) -> int:
        """Merges runs of ``fan_in`` neighbouring deltas of one size class into one of the next, until
        there is none. A row is so rewritten once per class. Returns the merges done.

        Safe beside writers: they only add at the end, and a merge commits only while its own deltas
        are still listed.
        """
        merges = 0
        while True:
            snapshot = self.snapshot()
            run = _run(snapshot["deltas"], fan_in)
            if run is None:
                return merges
            names = [d["name"] for d in snapshot["deltas"][run : run + fan_in]]
            size_class = snapshot["deltas"][run]["size_class"] + 1
            rows = self._deltas(snapshot, names)
            merged = self._write(self._last(rows.drop(DELTA, DAY), [_SEEN, *self.order]).drop(_SEEN))

            def change(old: dict) -> dict | None:
                listed = [d["name"] for d in old["deltas"]]
                if names[0] not in listed:
                    return None
                at = listed.index(names[0])
                if listed[at : at + len(names)] != names:
                    return None
                kept = old["deltas"]
                return {"deltas": [*kept[:at], {"name": merged, "size_class": size_class}, *kept[at + len(names) :]]}

            self._change(change)
            merges += 1

    def vacuum(self, keep_versions: int = 10, older_than_s: float = 86_400) -> int:
        """Deletes lists but the newest ``keep_versions``, and the data that no kept list names. Data
        younger than ``older_than_s`` stays: a writer may not have committed it yet."""
        known = self.versions()
        kept = {d["name"] for v in known[-keep_versions:] for d in self.snapshot(v)["deltas"]}
        folder, deleted = self._path(f"{self.path}/data"), 0
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            name = status.getPath().getName().partition("=")[2]
            if name not in kept and status.getModificationTime() / 1000 < time.time() - older_than_s:
                self._fs.delete(status.getPath(), True)
                deleted += 1
        for version in known[:-keep_versions]:
            self._fs.delete(self._path(self._file(version)), False)
        return deleted


def _run(deltas: list[dict], fan_in: int) -> int | None:
    """Start of the first ``fan_in`` neighbours of one size class."""
    for at in range(len(deltas) - fan_in + 1):
        if len({d["size_class"] for d in deltas[at : at + fan_in]}) == 1:
            return at
    return None


def _widened(old: dict | None, new: StructType) -> dict:
    """The old fields, then those that are new; old rows have nulls there."""
    if old is None:
        return new.jsonValue()
    known = {f["name"] for f in old["fields"]}
    return {**old, "fields": [*old["fields"], *(f for f in new.jsonValue()["fields"] if f["name"] not in known)]}
