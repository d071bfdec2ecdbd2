"""Fresh runs as a stream: the run of a tool in a project with the largest sequence counts, in whatever order runs arrive."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FINDING = "filename:string,line:int,cwe:string,rule:string,message:string"
RUN = f"class_name string, project string, tool string, sequence bigint, findings array<struct<{FINDING}>>"
KEY = ["class_name", "project", "tool"]
VERSION = "sequence bigint, v bigint"
RUNS = f"class_name string, project string, tool string, {VERSION}"
FINDINGS = f"{RUNS}, {FINDING.replace(':', ' ')}"


class Store:
    """Runs and findings in Parquet folders under one path.

    Batch k adds store/runs/batch-k and store/findings/batch-k. A compacted base of all batches up to m is a pair of folders
    base-m, which counts once both are whole, in place of those batches and of earlier bases. So a reader, or a writer that
    starts anew after it was stopped anywhere, finds each run once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.Path, self.conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self.files = self.Path(path).getFileSystem(self.conf)

    def _versions(self, part: str, kind: str) -> set[int]:
        """The whole folders of a kind, by their marks of success."""
        here = self.Path(f"{self.path}/{part}")
        names = [f.getPath().getName() for f in self.files.listStatus(here)] if self.files.exists(here) else []
        found = {int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}-(\d+)", n))}
        return {v for v in found if self.files.exists(self.Path(f"{self.path}/{part}/{kind}-{v}/_SUCCESS"))}

    def layout(self) -> tuple[int, list[int]]:
        """(last base or -1, the batches after it), of folders that both parts have."""
        bases = self._versions("runs", "base") & self._versions("findings", "base")
        base = max(bases, default=-1)
        return base, sorted(v for v in self._versions("runs", "batch") & self._versions("findings", "batch") if v > base)

    def add(self, batch: DataFrame, number: int) -> None:
        """Write a batch of runs (RUN) as number; a repeated batch writes the same folders again, one that a base holds none.

        The store is not read, so the work does not grow with it. Of several runs of a tool and project in the batch the
        one with the largest sequence is kept, of the same sequence any one.
        """
        if number <= self.layout()[0]:
            return
        last = batch.groupBy(*KEY).agg(F.max_by(F.struct("sequence", "findings"), F.coalesce("sequence", F.lit(0).cast("long"))).alias("x"))
        last = last.select(*KEY, F.coalesce("x.sequence", F.lit(0).cast("long")).alias("sequence"), F.lit(number).cast("long").alias("v"), F.col("x.findings").alias("findings")).persist()
        try:
            self._write(last.select(*KEY, "sequence", "v", F.explode("findings").alias("x")).select(*KEY, "sequence", "v", "x.*"), "findings", "batch", number)
            self._write(last.drop("findings"), "runs", "batch", number)
        finally:
            last.unpersist()

    def _write(self, rows: DataFrame, part: str, kind: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{part}/{kind}-{number}")

    def _read(self, part: str, schema: str, base: int, batches: list[int]) -> DataFrame:
        folders = [f"{self.path}/{part}/base-{base}"] * (base >= 0) + [f"{self.path}/{part}/batch-{v}" for v in batches]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def latest(self, layout: tuple[int, list[int]] | None = None) -> tuple[DataFrame, DataFrame]:
        """(runs, findings) that count: of each tool and project the run with the largest sequence, of the same sequence the
        one that came last. A run without findings has cleared the earlier ones."""
        base, batches = layout or self.layout()
        runs = self._read("runs", RUNS, base, batches).groupBy(*KEY).agg(F.max(F.struct("sequence", "v")).alias("x")).select(*KEY, "x.*")
        return runs, self._read("findings", FINDINGS, base, batches).join(runs, [*KEY, "sequence", "v"], "left_semi")

    def compact(self) -> None:
        """Put the base and all whole batches into one new base, then delete them.

        The runs are written last, so a base counts only when its findings are whole; older folders go only then. Stopped
        before that, the next call does it all again; after it, it deletes what is left.
        """
        base, batches = self.layout()
        if batches:
            runs, findings = self.latest((base, batches))
            self._write(findings, "findings", "base", batches[-1])
            self._write(runs, "runs", "base", batches[-1])
        base, _ = self.layout()
        for part in ("runs", "findings"):
            here = self.Path(f"{self.path}/{part}")
            for f in self.files.listStatus(here) if self.files.exists(here) else []:
                m = re.fullmatch(r"(base|batch)-(\d+)", f.getPath().getName())
                if m and (int(m[2]) < base or int(m[2]) == base and m[1] == "batch"):
                    self.files.delete(f.getPath(), True)


def merge_stream(spark: SparkSession, incoming: str, store: str, checkpoint: str, every: int = 50) -> StreamingQuery:
    """Follow a folder of run files (JSON lines, a completed run on each) and add them to a Store.

    The store is compacted when `every` batches have come since its last base.
    """
    held = Store(spark, store)

    def merge(batch: DataFrame, number: int) -> None:
        held.add(batch, number)
        if len(held.layout()[1]) >= every:
            held.compact()

    stream = spark.readStream.schema(RUN).json(incoming)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_findings(spark: SparkSession, store: str) -> DataFrame:
    """The findings of each tool's newest run in each project, by sequence, whenever it arrived."""
    return Store(spark, store).latest()[1].drop("sequence", "v")
