"""Graphs that grow with a stream of mentions.

Node merging is associative (first name by ord, last value by ord), so each
micro-batch merges into what was merged before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

_KEYS = ["graph_id", "node_id"]


def merge_states(states: DataFrame) -> DataFrame:
    """Partial nodes as one for each key. A state: graph_id, node_id, label,
    name, ord (of the first mention) and entries (key, ord, value of the last
    mention of each property)."""
    first = states.groupBy(*_KEYS).agg(F.min(F.struct("ord", "label", "name")).alias("_f"))
    entries = states.select(*_KEYS, F.explode("entries").alias("_e")).groupBy(*_KEYS, "_e.k").agg(F.max(F.struct("_e.ord", "_e.v")).alias("_l"))
    entries = entries.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("k", F.col("_l.ord").alias("ord"), F.col("_l.v").alias("v")))).alias("entries"))
    joined = first.join(entries, _KEYS, "left")
    return joined.select(*_KEYS, "_f.label", "_f.name", "_f.ord", F.coalesce("entries", F.array().cast("array<struct<k:string,ord:bigint,v:string>>")).alias("entries"))


def as_states(mentions: DataFrame) -> DataFrame:
    """Mentions (graph_id, label, name, properties, ord) as states."""
    from ..operators.graph import node_id

    kept = F.filter(F.map_entries("properties"), lambda e: e["value"].isNotNull())
    entries = F.coalesce(F.transform(kept, lambda e: F.struct(e["key"].alias("k"), F.col("ord").alias("ord"), e["value"].alias("v"))), F.array().cast("array<struct<k:string,ord:bigint,v:string>>"))
    return mentions.where("name is not null and label is not null").select("graph_id", node_id(F.col("label"), F.col("name")).alias("node_id"), "label", "name", "ord", entries.alias("entries"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*_KEYS), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The batches that wrote each bucket, ascending, of those that are complete."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for done in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "batch=*/_SUCCESS")) or []:
        folder = done.getPath().getParent()
        for bucket in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "bucket=*")) or []:
            found.setdefault(int(bucket.getPath().getName().split("=")[1]), []).append(int(folder.getName().split("=")[1]))
    return {b: sorted(v) for b, v in found.items()}


def _state_schema(mentions: DataFrame) -> T.StructType:
    return as_states(mentions).schema


def merge_stream(mentions: DataFrame, path: str, checkpoint: str, *, buckets: int = 64, **trigger) -> StreamingQuery:
    """Keep the merged nodes of a stream of mentions under path. Nodes lie in
    buckets by a hash of their key; a micro-batch reads and writes anew only the
    buckets that its mentions fall into (path/batch=<id>/bucket=<n>), so that the
    work goes with the batch and not with all that was ever merged (but for the
    other nodes of these buckets: more buckets, less of it).

    A batch that is run again after a failure reads the same earlier versions
    and overwrites its own, so each mention counts once; versions before these
    are removed. Read the result with merged_states().
    """
    shape = _state_schema(mentions)

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        states = as_states(batch)
        touched = [r[0] for r in states.select(_bucket(buckets).alias("b")).distinct().collect()]  # at most one row a bucket
        before = {b: [v for v in own if v < batch_id] for b, own in _versions(spark, path).items() if b in touched}
        last = [f"{path}/batch={own[-1]}/bucket={b}" for b, own in before.items() if own]
        if last:
            states = states.unionByName(spark.read.schema(shape).parquet(*last))
        merge_states(states).withColumn("bucket", _bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for b, own in before.items():
            for v in own[:-1]:
                system.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"batch={v}/bucket={b}"), True)

    return mentions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def merged_states(spark: SparkSession, path: str, shape: T.StructType) -> DataFrame:
    """The latest version of every bucket that merge_stream() wrote; shape is
    that of as_states()."""
    last = [f"{path}/batch={own[-1]}/bucket={b}" for b, own in _versions(spark, path).items()]
    return spark.read.schema(shape).parquet(*last) if last else spark.createDataFrame([], shape)


def nodes_of(states: DataFrame) -> DataFrame:
    """States as nodes with a map of properties."""
    return states.select(*_KEYS, "label", "name", F.map_from_entries(F.transform("entries", lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))).alias("properties"), "ord")
