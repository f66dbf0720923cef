"""An audit log as a streaming sink: chains carried on over micro-batches, files rotated, exactly once over restarts.

A micro-batch is written to ``entries/batch=<id>`` and then, as its commit, the state of every log to ``heads/batch=<id>``:
the last hash, the number of entries and the bytes so far. A batch whose heads are there is done and is not written again; one
that was cut off before is written over when the stream runs it again, as Spark does under the same id and with the same
rows. What is not committed is never read. Heads are a table and meet a batch by a join on the log; nothing of them goes
through the driver.

Defined cases: an empty batch commits the heads as they are; logs that come first begin with an empty hash; entries of one
log are chained by ``order`` inside a batch and by batch after that, ties in order by their text; a null log is a log of its
own. Fields that an entry lacks are left out of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audit import body

HEADS = "log string, head string, entries long, bytes long"
#: A new file of a log begins when the bytes before fill this.
FILE_BYTES = 100 << 20


class Ledger:
    """The entries and heads below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, log: str, order: str, fields: list[str] | None = None, file_bytes: int = FILE_BYTES) -> None:
        self.spark, self.root, self.log, self.order, self.fields, self.file_bytes = spark, root.rstrip("/"), log, order, fields, file_bytes

    def _batches(self) -> list[int]:
        """Ids of committed batches, ascending."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/heads")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        found = [x.getPath() for x in system.listStatus(path)]
        done = [p for p in found if system.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in done)

    def heads(self) -> DataFrame:
        """(log, head, entries, bytes) after the last committed batch."""
        done = self._batches()
        if not done:
            return self.spark.createDataFrame([], HEADS)
        return self.spark.read.schema(HEADS).parquet(f"{self.root}/heads/batch={done[-1]}")

    def append(self, rows: DataFrame, batch: int) -> None:
        """Chains a batch on and commits it; does nothing for a batch that is committed."""
        done = self._batches()
        if done and batch <= done[-1]:
            return
        before = self.heads()
        made = rows.withColumn("log", F.col(self.log).cast("string")).withColumn("body", body(self.fields))
        joined = made.join(before.withColumnRenamed("log", "__log"), F.col("log").eqNullSafe(F.col("__log")), "left").drop("__log")
        path = f"{self.root}/entries/batch={batch}"
        chained(joined, self.order, self.file_bytes).write.mode("overwrite").parquet(path)
        new = self.spark.read.parquet(path).groupBy("log").agg(F.max_by("entry_hash", "number").alias("head"), (F.max("number") + 1).alias("entries"), F.max(F.col("bytes_before") + F.octet_length("body")).alias("bytes"))
        old = before.join(new.select(F.col("log").alias("__log")), F.col("log").eqNullSafe(F.col("__log")), "left_anti")
        old.unionByName(new.select(*before.columns)).write.mode("overwrite").parquet(f"{self.root}/heads/batch={batch}")

    def entries(self) -> DataFrame:
        """All committed entries, with their log, ``number`` in it, ``file``, ``prev_hash`` and ``entry_hash``."""
        return self.spark.read.parquet(*(f"{self.root}/entries/batch={b}" for b in self._batches()))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """What a stream has now, appended to the end."""
        q = stream.writeStream.foreachBatch(lambda rows, batch: self.append(rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()


def chained(rows: DataFrame, order: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Entries with number, bytes_before, file, prev_hash and entry_hash; each log carries on from the head that its rows name.

    A log's rows of a batch pass through one task as a stream: a chain is a sequence.
    """
    added = [T.StructField("number", T.LongType()), T.StructField("bytes_before", T.LongType()), T.StructField("file", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())]
    names = [c for c in rows.columns if c not in ("head", "entries", "bytes")]
    schema = T.StructType([*(rows.schema[c] for c in names), *added])

    def chain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = chain
        head, number, size = "", 0, 0
        for part in parts:
            out = []
            for log, text, h, n, b in zip(part["log"], part["body"], part["head"], part["entries"], part["bytes"], strict=True):
                log = None if pd.isna(log) else log
                if now is chain or log != now:
                    now = log
                    head, number, size = ("", 0, 0) if pd.isna(h) else (h, int(n), int(b))
                new = hashlib.sha256(f"{head}|{text}".encode()).hexdigest()
                out.append((number, size, size // file_bytes, head, new))
                head, number, size = new, number + 1, size + len(text.encode())
            yield part[names].assign(**dict(zip([f.name for f in added], zip(*out, strict=True), strict=True))) if out else part[names].assign(**{f.name: [] for f in added})

    return rows.repartition("log").sortWithinPartitions("log", order, "body").mapInPandas(chain, schema)
