"""Labelling that survives its driver: a result table of committed batches, and runs that go on where the last one stopped.

A commit is one folder that appears by a rename, so a run that dies leaves whole commits and, at most, a hidden folder that nothing reads. Every
commit has a number; of several results of a batch the one of the latest commit counts. What is still to do is decided by the prompt itself: a request whose
prompt has no result yet, or another one than the table's, is asked again; nothing else is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sequence import label, pending


class ResultTable:
    """Rows of any shape with media_id and batch_id, in commits below a path."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("media_id", "batch_id")):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self._at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))

    def commits(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n[7:]) for n in names if n.startswith("commit="))

    def append(self, rows: DataFrame) -> int:
        """Writes rows as the next commit; all of them or none."""
        stage, number = f"{self.path}/_stage-{uuid.uuid4().hex}", max(self.commits(), default=0) + 1
        try:
            rows.write.parquet(stage)
            # rename fails where the target exists: of two runs at once one commits
            if self._fs.exists(self._at(f"{self.path}/commit={number}")) or not self._fs.rename(self._at(stage), self._at(f"{self.path}/commit={number}")):
                raise OSError(f"commit {number} is there already")
        except BaseException:
            self._fs.delete(self._at(stage), True)
            raise
        return number

    def read(self) -> DataFrame:
        """The latest row of each key."""
        every = self.spark.read.schema(f"{self.schema}, commit int").parquet(self.path)
        latest = Window.partitionBy(*self.keys).orderBy(F.desc("commit"))
        return every.withColumn("__rn", F.row_number().over(latest)).where("__rn = 1").drop("__rn", "commit")

    def compact(self) -> None:
        """What read() gives as one commit; the older ones go after it is there."""
        before = self.commits()
        if len(before) > 1:
            self.append(self.read())
            for number in before:
                self._fs.delete(self._at(f"{self.path}/commit={number}"), True)


def label_resumed(requests: DataFrame, fn: Callable[[list[str]], list[str]], path: str, commits: int = 16) -> DataFrame:
    """(media_id, batch_id, prompt_hash, reply) of all requests(media_id, batch_id, prompt), through a table at `path` that is filled in about `commits` commits.

    A run that was stopped, or a later one with some prompts changed, asks only for what the table lacks."""
    kind = lambda c: requests.schema[c].dataType.simpleString()
    table = ResultTable(requests.sparkSession, path, f"media_id {kind('media_id')}, batch_id {kind('batch_id')}, prompt_hash string, reply string")
    part = F.pmod(F.xxhash64("media_id", "batch_id"), F.lit(commits))
    for k in range(commits):
        todo = pending(requests.where(part == k), table.read()).select("media_id", "batch_id", "prompt", "prompt_hash")
        if not todo.isEmpty():
            table.append(label(todo, fn).join(todo.select("media_id", "batch_id", "prompt_hash"), ["media_id", "batch_id"]).select("media_id", "batch_id", "prompt_hash", "reply"))
    return table.read().join(requests.select("media_id", "batch_id", F.sha2("prompt", 256).alias("prompt_hash")), ["media_id", "batch_id", "prompt_hash"], "left_semi")
