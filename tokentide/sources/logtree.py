"""A folder of session logs written from an `events` table, in the layout that the scans read.

Each day has a file of its own (`a`) and one in the archive (`z`); files `b` hold two days. A file opens with its session's metadata; some events
change the model first, and some leave a line without a marker instead of a token count.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.session import staging_folder


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def lines(ev: DataFrame) -> DataFrame:
    """(file, ts, event_id, value): what each event adds to its file, one line or two."""
    group = F.when(F.col("event_id") % 5 == 4, "z").when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    day = F.to_date("ts")
    day = F.when(group == "b", F.date_sub(day, F.dayofyear(day) % 2)).otherwise(day)
    rows = ev.withColumn("file", F.concat(group, F.date_format(day, "yyyyMMdd")))
    cents = F.floor(F.col("value") * 100).cast("long")
    turn = F.to_json(
        F.struct(
            _stamp(F.col("ts")).alias("timestamp"), F.lit("turn_context").alias("type"), F.struct(F.concat(F.lit("m"), F.col("k") % 3).alias("model")).alias("payload")
        )
    )
    used = F.struct(cents.alias("input_tokens"), (cents + F.col("k") * 10).alias("total_tokens"))
    token = F.to_json(
        F.struct(
            _stamp(F.col("ts")).alias("timestamp"),
            F.lit("event_msg").alias("type"),
            F.struct(F.lit("token_count").alias("type"), F.struct(used.alias("last_token_usage")).alias("info")).alias("payload"),
        )
    )
    own = F.when(F.col("k") % 11 == 0, "a line without a marker").otherwise(token)
    return rows.select("file", "ts", "event_id", F.concat_ws("\n", F.when(F.col("k") % 7 == 0, turn), own).alias("value"))


def _head(file: Column) -> Column:
    meta = F.struct(file.alias("id"), F.lit("m9").alias("model"), F.lit("/w").alias("cwd"))
    return F.to_json(F.struct(F.lit("session_meta").alias("type"), meta.alias("payload")))


def write(ev: DataFrame) -> str:
    """Writes the tree beside the staged tables; returns its session root."""
    spark = ev.sparkSession
    body = lines(ev)
    heads = body.select("file").distinct().select("file", F.lit(None).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("event_id"), _head(F.col("file")).alias("value"))
    top = f"{staging_folder(spark)}/logs-{uuid.uuid4().hex}"
    # A file's lines are written in order by the one task that has the file.
    rows = body.unionByName(heads).repartition("file").sortWithinPartitions("file", F.asc_nulls_first("ts"), "event_id")
    rows.select("file", "value").write.partitionBy("file").text(f"{top}/parts")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(top).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(hadoop.Path(f"{top}/parts")):
        name = folder.getPath().getName()
        if not name.startswith("file="):
            continue
        key = name.removeprefix("file=")
        day = datetime.strptime(key[1:], "%Y%m%d")
        target = f"{top}/archived_sessions" if key[0] == "z" else f"{top}/sessions/{day:%Y/%m/%d}"
        fs.mkdirs(hadoop.Path(target))
        (part,) = [x.getPath() for x in fs.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-")]
        fs.rename(part, hadoop.Path(f"{target}/rollout-{day:%Y-%m-%dT00-00-00}-{key}.jsonl"))
    return f"{top}/sessions"
