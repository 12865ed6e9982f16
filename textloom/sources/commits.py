"""Outputs that become visible once, all together.

A job first writes all its tables to a folder of its own.  One rename of the table of
its units (what was done, and from which inputs) to ``commits`` is the moment the job
counts; until then nothing it wrote is looked at.  Then the written folders are moved to where
readers find them.  A job that stops before that moment leaves nothing visible, one that
stops after it is completed by the next call, so repeating a call never writes twice.
Renames must be atomic, as on HDFS and local disks, and one job at a time writes to a folder.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the inputs of a unit looked like, and when its job began.
SIGNATURE, BEGUN = "signature", "begun_ms"


class Files:
    """The few file operations needed, through the file system Spark itself uses."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def rename(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._path(target).getParent())
        if self.exists(target) or not self._fs.rename(self._path(source), self._path(target)):
            raise FileExistsError(f"{target} is there already, or {source} is gone")

    def replace(self, source: str, target: str) -> None:
        """Put a folder in the place of another one; if it stops between, ``source`` is still there."""
        self.delete(target)
        self.rename(source, target)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def folders(self, path: str, depth: int = 1) -> list[str]:
        """Folders ``depth`` levels below, as paths relative to ``path``; names only."""
        if not depth:
            return [""]
        if not self.exists(path):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
        return [f"{n}/{rest}".rstrip("/") for n in names for rest in self.folders(f"{path}/{n}", depth - 1)]


class Outputs:
    """The tables below one folder, written by jobs that each do some units.

    ``tables`` names them; those in ``by_unit`` are partitioned by the columns ``keys``
    of a unit, and a later job replaces the parts of its units.  The others are replaced
    whole by each job.
    """

    def __init__(self, spark: SparkSession, out: str, keys: Sequence[str], tables: Sequence[str], by_unit: Sequence[str]):
        self.spark, self.out, self.keys = spark, out.rstrip("/"), list(keys)
        self.tables, self.by_unit = list(tables), set(by_unit)
        self.files = Files(spark, self.out)
        self.schema = ", ".join(f"{k} string" for k in self.keys) + f", {SIGNATURE} string, {BEGUN} bigint"

    def committed(self) -> DataFrame:
        """The newest commit of each unit: ``keys, signature, begun_ms``."""
        path = f"{self.out}/commits"
        if not self.files.exists(path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema + ", job string").parquet(path)
        newest = F.max_by(F.struct(SIGNATURE, BEGUN), F.struct(BEGUN, "job")).alias("_last")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, f"_last.{SIGNATURE}", f"_last.{BEGUN}")

    def begin(self) -> str:
        """Complete what committed jobs left, in their order, and name a new job."""
        jobs = [j for j in self.files.folders(f"{self.out}/staged") if self.files.exists(f"{self.out}/commits/job={j}")]
        for job in sorted(jobs):
            self.publish(job)
        return f"{time.time_ns() // 1_000_000:015d}-{uuid.uuid4().hex[:12]}"

    def staged(self, job: str, table: str) -> str:
        """Where the job writes a table."""
        return f"{self.out}/staged/{job}/{table}"

    def commit(self, job: str, units: DataFrame) -> None:
        """Make the job count: from here on its units (``keys, signature``) are done."""
        begun = F.lit(int(job.split("-")[0])).cast("bigint").alias(BEGUN)
        units.select(*self.keys, SIGNATURE, begun).write.parquet(self.staged(job, "units"))
        self.files.rename(self.staged(job, "units"), f"{self.out}/commits/job={job}")

    def publish(self, job: str) -> None:
        """Move what a committed job wrote to its place; may be repeated until it is done."""
        staged, cleared = f"{self.out}/staged/{job}", f"{self.out}/staged/{job}/cleared"
        if not self.files.exists(cleared):
            # Units that have nothing to show any more; before anything is moved, so that what is there is old.
            done = self.spark.read.parquet(f"{self.out}/commits/job={job}").select(*self.keys)
            units = {tuple(row) for row in done.collect()}  # a name per unit, fewer than the files the driver lists
            for table in self.by_unit:
                new = set(self.files.folders(f"{staged}/{table}", len(self.keys)))
                for part in self.files.folders(f"{self.out}/{table}", len(self.keys)):
                    unit = tuple(unquote(level.split("=", 1)[1]) for level in part.split("/"))
                    if unit in units and part not in new:
                        self.files.delete(f"{self.out}/{table}/{part}")
            self.files.make(cleared)
        for table in self.tables:
            if table in self.by_unit:
                for part in self.files.folders(f"{staged}/{table}", len(self.keys)):
                    self.files.replace(f"{staged}/{table}/{part}", f"{self.out}/{table}/{part}")
            elif self.files.exists(f"{staged}/{table}"):
                self.files.replace(f"{staged}/{table}", f"{self.out}/{table}")
        self.files.delete(staged)

    def clean(self) -> list[str]:
        """Delete what jobs wrote that never counted; only while no job of this folder runs."""
        left = [j for j in self.files.folders(f"{self.out}/staged") if not self.files.exists(f"{self.out}/commits/job={j}")]
        for job in left:
            self.files.delete(f"{self.out}/staged/{job}")
        return left
