"""Processing only new or changed records: the target table is the state.

Every target row carries its source key and version. A run anti-joins its source against the latest
target version of each key, writes what is new into a staging folder and publishes it by creating one commit
file. The file's name is its place in the log, the one after the commit that the run compared with, and it is
created only if it isn't there, in one atomic step: of several runs that looked at the same state exactly one
wins, whether they publish the same version or different ones. A run that dies before leaves nothing visible;
a run that is started again afterwards finds its version published and does nothing.

A commit names its rows, the latest compacted state before them and the rows since that state. Every
COMPACT_AFTER versions a run writes a new compacted state, so a run reads the keys and at most COMPACT_AFTER
deltas, however long the history is.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deltas that a state may consist of before it is compacted.
COMPACT_AFTER = 8
# File systems whose rename is no single step, but whose files appear as a whole when they are closed.
OBJECT_STORES = ("s3", "s3a", "gs", "oss", "cosn")
#: What stands before the first commit.
NOTHING = {"version": -1, "place": -1}


class VersionedTarget:
    """A table in ``path`` (a folder that all executors share) made of atomically published versions.

    Versions are non-negative integers and must be published in rising order.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], version_cols: Sequence[str]):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.version_cols = list(key), list(version_cols)
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._Path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(self._conf)

    # -- commits
    def _log(self) -> list[int]:
        """Places of the commits in order."""
        at = self._Path(f"{self.path}/_commits")
        if not self._fs.exists(at):
            return []
        return sorted(int(n) for n in (s.getPath().getName() for s in self._fs.listStatus(at)) if n.isdigit())

    def _commit(self, place: int) -> dict:
        """A commit: ``version``, ``rows`` (its data folder), ``base`` (a compacted state or None), ``since`` (deltas after it)."""
        stream = self._fs.open(self._Path(f"{self.path}/_commits/{place:020d}"))
        try:
            return {**json.loads(bytes(stream.readAllBytes()).decode()), "place": place}
        finally:
            stream.close()

    def head(self) -> dict | None:
        """The last commit."""
        log = self._log()
        return self._commit(log[-1]) if log else None

    def commits(self) -> dict[int, str]:
        """Published versions and their data folders; one small file per version."""
        return {c["version"]: f"{self.path}/data/{c['rows']}" for c in map(self._commit, self._log())}

    def published(self, version: int) -> bool:
        head = self.head()
        return head is not None and (version == head["version"] or version < head["version"] and version in self.commits())

    def _create_once(self, name: str, content: bytes) -> bool:
        """Creates a file with its whole content unless it exists, in one step; whether it was this call that did."""
        target = f"{self.path}/_commits/{name}"
        scheme = self._fs.getUri().getScheme()
        self._fs.mkdirs(self._Path(f"{self.path}/_commits"))
        if scheme in OBJECT_STORES:  # put-if-absent when the file is closed
            try:
                out = self._fs.create(self._Path(target), False)
                out.write(content)
                out.close()
                return True
            except Exception as e:  # noqa: BLE001 - py4j wraps the store's own classes
                if self._fs.exists(self._Path(target)):
                    return False
                raise e
        pending = self._Path(f"{self.path}/_pending/{name}-{uuid.uuid4().hex}")
        out = self._fs.create(pending, False)
        out.write(content)
        out.close()
        try:
            if scheme == "file":  # a hard link fails if its name is taken
                plain = lambda p: p.toUri().getPath()
                try:
                    os.link(plain(pending), plain(self._Path(target)))
                    return True
                except FileExistsError:
                    return False
            return self._renamed(pending, self._Path(target))
        finally:
            self._fs.delete(pending, False)

    def _renamed(self, source, target) -> bool:
        """A rename that never overwrites."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(source, target, options)
            return True
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    # -- reading
    def _read(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in folders])

    def _latest(self, commit: dict, columns: Sequence[str] | None = None) -> DataFrame:
        parts = [*([commit["base"]] if commit["base"] else []), *commit["since"], commit["rows"]]
        df = self._read(parts)
        rest = [c for c in columns or df.columns if c not in self.key and c != "_version"]
        newest = F.max_by(F.struct(*rest, "_version"), F.col("_version"))
        return df.groupBy(*self.key).agg(newest.alias("s")).select(*self.key, "s.*")

    def state(self) -> DataFrame | None:
        """Latest published row of every key, or None before the first version."""
        head = self.head()
        return self._latest(head) if head else None

    def rows(self) -> DataFrame | None:
        """All published rows of all versions, with ``_version``."""
        parts = self.commits()
        return self.spark.read.parquet(*parts.values()) if parts else None

    def changes(self, source: DataFrame, head: dict | None = None) -> DataFrame:
        """Rows of ``source`` whose version differs from the key's latest in the target (as of ``head``), or whose key is new.

        ``source`` must hold one row per key. Null versions compare as equal to null.
        """
        head = head or self.head() or NOTHING
        if head is NOTHING:
            return source
        now = self._latest(head, self.version_cols)
        old = now.select(*[F.col(c).alias(f"_t_{c}") for c in [*self.key, *self.version_cols]])
        same = F.lit(True)
        for c in self.key:
            same = same & (F.col(c) == F.col(f"_t_{c}"))
        for c in self.version_cols:
            same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
        return source.join(old, same, "left_anti")

    # -- writing
    def stage(self, df: DataFrame, version: int) -> str:
        """Write the rows of one version where no reader looks yet; returns the folder's name."""
        name = f"v{version}-{uuid.uuid4().hex}"
        df.withColumn("_version", F.lit(version).cast("bigint")).write.parquet(f"{self.path}/data/{name}")
        return name

    def publish(self, name: str, version: int, head: dict | None = None) -> bool:
        """Make a staged version visible right after ``head`` (the last commit by default).

        False (and no effect) if the version is already published or another one came after ``head``.
        """
        if self.published(version):
            return False
        head = head or self.head() or NOTHING
        base, since = None, []
        if head is not NOTHING:
            if version < head["version"]:
                raise ValueError(f"version {version} after version {head['version']}")
            base, since = head["base"], [*head["since"], head["rows"]]
            if len(since) >= COMPACT_AFTER:
                base, since = f"base{head['version']}-{uuid.uuid4().hex}", []
                self._latest(head).write.parquet(f"{self.path}/data/{base}")
        content = json.dumps({"version": version, "rows": name, "base": base, "since": since}).encode()
        return self._create_once(f"{head['place'] + 1:020d}", content)

    def process(self, source: DataFrame, version: int) -> bool:
        """One whole run; it looks again if another version was published meanwhile. False if the version is there already."""
        while not self.published(version):
            head = self.head() or NOTHING
            if self.publish(self.stage(self.changes(source, head), version), version, head):
                return True
        return False

    def vacuum(self, older_than_hours: float = 24.0) -> int:
        """Removes folders that no commit names, left by runs that died or lost, once they are ``older_than_hours``; returns their number."""
        at = self._Path(f"{self.path}/data")
        if not self._fs.exists(at):
            return 0
        named = {f for c in map(self._commit, self._log()) for f in (c["rows"], c["base"], *c["since"])}
        now = self._jvm.java.lang.System.currentTimeMillis()
        dead = [s.getPath() for s in self._fs.listStatus(at) if s.getPath().getName() not in named and now - s.getModificationTime() >= older_than_hours * 3_600_000]
        for p in dead:
            self._fs.delete(p, True)
        return len(dead)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by ``order``; ties are settled by all other columns, nulls first."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("s")).select(*keys, "s.*")


def replay_runs(scans: DataFrame, runs: DataFrame, path: str) -> DataFrame:
    """What each successful run took up, run after run, through one :class:`VersionedTarget`.

    ``scans``: run_id, file_id, content_hash, parser_version, seen_at, scan_id; rows with a null hash,
    run or file count as not read; of several rows of a file in a run the latest ``seen_at`` counts (then
    the highest scan_id). ``runs``: run_id, status; a run counts once, and only with status ok (any
    letter case). Returns run_id, file_id. No runs or no scans give no rows.
    """
    spark = scans.sparkSession
    ok = sorted(r[0] for r in runs.where(F.lower(F.trim("status")) == "ok").where(F.col("run_id").isNotNull()).select("run_id").distinct().collect())
    empty = spark.createDataFrame([], T.StructType([T.StructField("run_id", T.LongType()), T.StructField("file_id", T.LongType())]))
    if not ok:
        return empty
    cols = ["run_id", "file_id", "content_hash", "parser_version", "seen_at", "scan_id"]
    read = scans.select(*cols).where(F.col("content_hash").isNotNull() & F.col("file_id").isNotNull() & F.col("run_id").isin(ok))
    # one exchange; each run then reads its own folder only
    latest_per(read, ["run_id", "file_id"], ["seen_at", "scan_id"]).drop("seen_at", "scan_id").write.partitionBy("run_id").parquet(f"{path}/source")
    source = spark.read.schema("file_id bigint, content_hash binary, parser_version int, run_id bigint").parquet(f"{path}/source")
    target = VersionedTarget(spark, f"{path}/target", ["file_id"], ["content_hash", "parser_version"])
    for run in ok:
        target.process(source.where(F.col("run_id") == run).drop("run_id"), run)
    out = target.rows()
    return empty if out is None else out.select(F.col("_version").alias("run_id"), "file_id")
