"""Sinks: object lake, catalog documents, exactly-once stream append."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from medialake.functions.timing import idiv
from medialake.operators.ordered import HotKeys, find_hot, seq_span, stage

OBJECT_KEY = ["broadcast_id", "track_name", "group_id", "object_id"]


def object_filename() -> Column:
    """File name of an object row (kind, track_name, group_id, object_id)."""
    place = F.concat("track_name", F.lit("_g"), F.col("group_id").cast("string"), F.lit("_o"), F.col("object_id").cast("string"))
    return (
        F.when((F.col("kind") == "initialization") & (F.col("track_name") == "catalog"), "catalog.json")
        .when(F.col("kind") == "metadata", F.concat(place, F.lit(".json")))
        .otherwise(F.concat(place, F.lit("_media.mp4")))
    )


def init_filename() -> Column:
    return F.concat("track_name", F.lit("_init.mp4"))


def lake_rows(objects: DataFrame, inits: DataFrame | None = None) -> DataFrame:
    """Objects and init segments as one table with their file names."""
    rows = objects.withColumn("object_filename", object_filename())
    if inits is None:
        return rows
    init = inits.select(*[c for c in ("broadcast_id", "asset_id") if c in inits.columns], "track_name",
                        F.lit("init").alias("kind"), F.col("init_segment").alias("payload"), init_filename().alias("object_filename"))
    return rows.unionByName(init, allowMissingColumns=True)


TRACK_BYTES = 1 << 30


def _large_tracks(objects: DataFrame) -> HotKeys:
    """Tracks with more rows than one task should hold, or more than ``TRACK_BYTES`` of payload."""
    if "payload_bytes" not in objects.columns:
        return find_hot(objects, ["track_name"])
    rows = objects.groupBy("track_name").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("bytes"))
    rows = rows.where((F.col("n") > seq_span(objects.sparkSession)) | (F.col("bytes") > TRACK_BYTES)).select("track_name")
    return HotKeys(("track_name",), None if rows.isEmpty() else stage(rows))


def write_object_lake(objects: DataFrame, inits: DataFrame | None, path: str, mode: str = "overwrite", hot: HotKeys | None = None) -> None:
    """Write the lake partitioned by track.

    Each track goes to one task and file set; a hot track, by rows or by
    ``payload_bytes``, is spread over all shuffle partitions by (group, object).
    """
    rows = lake_rows(objects, inits)
    hot = hot or _large_tracks(objects)
    spread = F.lit(0)
    if hot.rows is not None:
        width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.join(hot.rows.withColumn("__hot", F.lit(True)), list(hot.keys), "left")
        spread = F.when(F.col("__hot"), F.pmod(F.hash("group_id", "object_id"), F.lit(width))).otherwise(0)
    rows = rows.withColumn("__spread", spread).repartition("track_name", "__spread").drop("__spread", "__hot")
    rows.write.mode(mode).partitionBy("track_name").parquet(path)


def write_catalog_json(documents: DataFrame, path: str, broadcast: str = "broadcast_id", mode: str = "overwrite") -> None:
    """One line per catalog document, in folders by broadcast, in part order."""
    (documents.select(broadcast, "part_index", F.col("document").alias("value"))
     .repartition(broadcast).sortWithinPartitions(broadcast, "part_index")
     .select(broadcast, "value").write.mode(mode).partitionBy(broadcast).text(path))


def write_object_stream(df: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None,
                        key: list[str] | None = None, once: bool = True, bucket: int = 64, owners: int = 64) -> StreamingQuery:
    """Append served objects exactly once per key; several queries may share a lake.

    Rows lie in ``owner=<hash of the broadcast>/group_bucket=<groups>/batch=<query>-<batch>``.
    The query's id lives in its checkpoint, so a replayed batch replaces its own
    folders and a new checkpoint never touches those of an older one. Rows stored
    before are left out by an anti-join on the key columns that lists and reads
    only the owner and group folders of the batch's own rows. ``on_batch`` gets
    the new rows.
    """
    key = key or OBJECT_KEY

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = f"{_query_id(spark)}-{batch_id}"
        placed = batch.withColumns({"owner": F.pmod(F.xxhash64(key[0]), F.lit(owners)).cast("int"), "group_bucket": idiv("group_id", bucket), "batch": F.lit(name)})
        new = placed.dropDuplicates(key)
        folders = [(r.owner, r.group_bucket) for r in placed.select("owner", "group_bucket").distinct().limit(FOLDERS + 1).collect()]
        if not folders:
            return
        seen = _stored(spark, path, folders, new.schema)
        if seen is not None:
            new = new.join(seen.where(F.col("batch") != name).select(*key), key, "left_anti")
        new.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("owner", "group_bucket", "batch").parquet(path)
        if on_batch is not None:
            stored = _stored(spark, path, folders, placed.schema)
            on_batch(stored.where(F.col("batch") == name).drop("owner", "group_bucket", "batch"), batch_id)

    writer = df.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


#: Up to so many folders of a micro-batch are listed one by one; beyond it the lake's partitions are listed once and pruned.
FOLDERS = 1000


def _query_id(spark: SparkSession) -> str:
    """Id of the streaming query that runs this micro-batch, as kept in its checkpoint."""
    found = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not found:
        raise RuntimeError("not inside a streaming micro-batch")
    return found


def _stored(spark: SparkSession, path: str, folders: list[tuple[int, int]], schema: StructType) -> DataFrame | None:
    """Rows in the given (owner, group bucket) folders of the lake; None where none exists."""
    lake = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = lake.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(lake):
        return None
    reader = spark.read.schema(schema).option("basePath", path)
    if len(folders) > FOLDERS:
        return reader.parquet(path)
    names = [f"{path}/owner={o}/group_bucket={'__HIVE_DEFAULT_PARTITION__' if g is None else g}" for o, g in folders]
    there = [n for n in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n))]
    return reader.parquet(*there) if there else None
