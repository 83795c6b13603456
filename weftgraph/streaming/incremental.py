"""Document changes as a stream: idempotent micro-batches that publish one generation after another."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark: SparkSession, folder: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once_per_delivery(stream: DataFrame, delivery: str, time: str, late: str = "1 day") -> DataFrame:
    """Each delivery id once; ids are forgotten when the watermark has passed them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([delivery])


def windowed(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of a key by event time; rows later than the watermark are left out."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "n", "total")


class Generations:
    """A folder of immutable generations ``gen=<n>`` and one pointer file ``CURRENT-<n>`` for each that is complete.

    A pointer appears by one rename, after its generation is written; the greatest one is current. Nothing is deleted
    before something else is published, so whatever step a run breaks off at, the last complete generation stays current.
    """

    def __init__(self, spark: SparkSession, folder: str, check: Callable[[DataFrame], None] | None = None) -> None:
        """`check` may raise on a new generation: it is then not published."""
        self.spark, self.folder, self.check = spark, folder.rstrip("/"), check
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return bytes(b & 255 for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _published(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(x.removeprefix("CURRENT-")) for x in names if re.fullmatch(r"CURRENT-\d+", x))

    def current(self) -> dict | None:
        """What is published: generation, the batch that made it and the fingerprint of its input."""
        found = self._published()
        return json.loads(self._text(f"CURRENT-{found[-1]}")) if found else None

    def read(self) -> DataFrame | None:
        now = self.current()
        return None if now is None else self.spark.read.parquet(f"{self.folder}/gen={now['generation']}")

    def publish(self, df: DataFrame, batch: int, fingerprint: str | None = None) -> int:
        """`df` as the next generation; a batch that was published before changes nothing, and is an error if it comes with another fingerprint."""
        for n in reversed(self._published()):
            seen = json.loads(self._text(f"CURRENT-{n}"))
            if seen["batch"] == batch and fingerprint is not None and seen.get("fingerprint") not in (None, fingerprint):
                raise ValueError(f"batch {batch} was published with other input")
            if batch >= seen["batch"]:
                break
        now = self.current()
        if now is not None and batch <= now["batch"]:
            return now["generation"]
        n = 0 if now is None else now["generation"] + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/gen={n}")  # what a run that broke off left is replaced
        if self.check is not None:
            self.check(self.spark.read.parquet(f"{self.folder}/gen={n}"))
        staged = self._path(f"{self.folder}/.CURRENT-{n}.{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps({"generation": n, "batch": batch, "fingerprint": fingerprint}).encode()))
        out.close()
        if not self._fs.rename(staged, self._path(f"{self.folder}/CURRENT-{n}")):
            raise RuntimeError(f"generation {n} was published by another writer")
        return n


def run(stream: DataFrame, generations: Generations, step: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Each micro-batch turned into the next generation by `step(previous, batch)`; all that is there, then it ends."""

    def batch(df: DataFrame, n: int) -> None:
        generations.publish(step(generations.read(), df), n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LEASE = "resource string, holder string, action string, granted boolean, expires long"


def lease(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A lease with a lifetime for each resource: taken if free, expired or one's own; renewed only while it lasts.

    Rows: resource, holder, action (``acquire``, ``renew``, ``release``), at and ttl in milliseconds.
    """
    holder, expires = state.get if state.exists else ("", 0)
    rows = []
    for r in pd.concat(list(frames)).sort_values(["at", "holder"]).itertuples():
        live = expires > r.at
        if r.action == "acquire":
            ok = not live or holder == r.holder
        else:
            ok = live and holder == r.holder
        if ok:
            holder, expires = (r.holder, r.at + r.ttl) if r.action != "release" else ("", 0)
        rows.append((r.resource, r.holder, r.action, bool(ok), int(expires)))
    state.update((holder, int(expires)))
    yield pd.DataFrame(rows, columns=["resource", "holder", "action", "granted", "expires"])


def leases(stream: DataFrame) -> DataFrame:
    """The outcome of each lease request, in order of time within a batch."""
    return stream.groupBy("resource").applyInPandasWithState(lease, LEASE, "holder string, expires long", "append", GroupStateTimeout.NoTimeout)


# The states of a run and where each may go; a state may always be entered again, and one that is not listed on the left is final.
TRANSITIONS = {
    "Idle": "FetchSource Stale",
    "FetchSource": "RestoreBase FullBuild Plan Stable Stale FailedRetryable",
    "RestoreBase": "Plan FullBuild FailedRetryable Stale",
    "Plan": "FullBuild IncrementalBuild Stable FailedRetryable Stale",
    "FullBuild": "ValidateCandidate FailedRetryable Stale",
    "IncrementalBuild": "RebalanceCheck ValidateCandidate FailedRetryable Stale",
    "RebalanceCheck": "Rebalance ValidateCandidate FailedRetryable Stale",
    "Rebalance": "ValidateCandidate FailedRetryable Stale",
    "ValidateCandidate": "CreateSourcePR UploadCandidate FailedRetryable FailedPermanent Stale",
    "CreateSourcePR": "AwaitSourcePR ReconcileMergedSource FailedRetryable Stale",
    "AwaitSourcePR": "ReconcileMergedSource Blocked Stale AwaitSourcePR FailedRetryable",
    "ReconcileMergedSource": "UploadCandidate IncrementalBuild CreateSourcePR ValidateCandidate Blocked FailedRetryable Stale",
    "UploadCandidate": "CreateCatalogPR FailedRetryable Stale",
    "CreateCatalogPR": "AwaitCatalogPR FailedRetryable Stale",
    "AwaitCatalogPR": "Stable Blocked AwaitCatalogPR FailedRetryable Stale",
    "FailedRetryable": "Idle FetchSource RestoreBase Plan FullBuild IncrementalBuild RebalanceCheck Rebalance ValidateCandidate CreateSourcePR AwaitSourcePR ReconcileMergedSource UploadCandidate CreateCatalogPR AwaitCatalogPR FailedPermanent Stale",
    "Blocked": "Idle",
}
STATES = (*[s for s in TRANSITIONS if s not in ("FailedRetryable", "Blocked")], "Stable", "Blocked", "FailedRetryable", "FailedPermanent", "Stale")


def illegal_transitions(log: DataFrame, run_id: str, state: str, order: str) -> DataFrame:
    """Steps of a run that its table of transitions does not have."""
    from pyspark.sql import Window

    known = log.sparkSession.createDataFrame([(a, b) for a, many in TRANSITIONS.items() for b in many.split()] + [(x, x) for x in STATES], "before string, after string")
    steps = log.withColumn("before", F.lag(state).over(Window.partitionBy(run_id).orderBy(order))).withColumnRenamed(state, "after").where("before is not null")
    return steps.join(F.broadcast(known), ["before", "after"], "left_anti")
