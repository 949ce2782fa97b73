"""Grouping activity into sessions.

Secondary sort by stream and time, then one linear scan per partition with constant memory. Time is cut into stretches of
fixed length, and rows are spread by stream and stretch, so a stream that holds a large part of all rows is scanned by many
tasks. A session that comes within the gap of an end of its stretch may go on in the next one; only these parts (at most two
a stretch) are joined up afterwards. Where a session is cut depends on the instants alone, never on how many partitions the
planner makes of them, so the result is the same in any plan, and when a part of it is computed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = T.StructType(
    [T.StructField("user_id", T.StringType()), T.StructField("stream", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("start_us", "end_us", "n")]
    + [T.StructField("first_id", T.StringType()), T.StructField("last_id", T.StringType()), T.StructField("edge", T.BooleanType())]
)
#: Length of a stretch of time in gaps: about 2 of so many sessions lie at its ends.
STRETCH = 32


def _scanner(gap_us: int, stretch_us: int):
    """Scan of a sorted partition. Only the open session is kept from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = PARTS.fieldNames()
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        held = None  # the open session: user, stream, start, end, events, first id, last id

        def out(columns: list) -> pa.RecordBatch:
            start, end = (np.array(columns[k], np.int64) for k in (2, 3))
            edge = (start % stretch_us <= gap_us) | (stretch_us - end % stretch_us <= gap_us)
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), pa.array(edge, pa.bool_())], names=names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            user, stream, at, unit = (batch.column(i) for i in range(4))
            us = at.to_numpy(zero_copy_only=False)
            # the batch is sorted by stream, so streams are compared as codes
            u, s = (c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in (user, stream))
            stretch = us // stretch_us
            new = np.ones(n, bool)
            new[1:] = (u[1:] != u[:-1]) | (s[1:] != s[:-1]) | (stretch[1:] != stretch[:-1]) | (us[1:] - us[:-1] > gap_us)
            begin = np.flatnonzero(new)
            stop = np.append(begin[1:], n) - 1
            b, e = pa.array(begin), pa.array(stop)
            cols = [user.take(b).to_pylist(), stream.take(b).to_pylist(), us[begin].tolist(), us[stop].tolist(), (stop - begin + 1).tolist(), unit.take(b).to_pylist(), unit.take(e).to_pylist()]
            if held is not None:
                if held[0] == cols[0][0] and held[1] == cols[1][0] and held[3] // stretch_us == cols[2][0] // stretch_us and cols[2][0] - held[3] <= gap_us:
                    cols[2][0], cols[4][0], cols[5][0] = held[2], held[4] + cols[4][0], held[5]
                else:
                    cols = [[h, *c] for h, c in zip(held, cols)]
            held = [c[-1] for c in cols]
            if len(cols[0]) > 1:
                yield out([c[:-1] for c in cols])
        if held is not None:
            yield out([[h] for h in held])

    return run


def sessions(events: DataFrame, user: str, at: str, unit: str, gap_seconds: float, stream: str | None = None, partitions: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """user_id, stream, start, end, duration_s, n_events, first_id, last_id of every session of every stream.

    events: one row per event and stream; ``at`` an instant with microseconds, ``unit`` an id that orders events of the same
    instant (as a string). A session ends where the next event comes more than ``gap_seconds`` later; exactly so long does not
    end it. Rows with a null instant are left out; null users and streams are streams of their own; a null id sorts first.
    Repeated rows count each: take out repeats before. An empty table gives no session. ``stretch`` is the length, in gaps, of
    the stretches of time that one task scans in a row: shorter ones split a hot stream finer, longer ones leave fewer parts
    to join (about 2 of ``stretch`` sessions; of one stream at most two for each stretch of its life).
    """
    gap_us = max(round(gap_seconds * 1e6), 0)
    stretch_us = max(gap_us, 1_000_000) * stretch
    rows = events.select(
        F.col(user).cast("string").alias("user_id"), (F.col(stream).cast("string") if stream else F.lit("")).alias("stream"), F.unix_micros(F.col(at)).alias("us"), F.col(unit).cast("string").alias("unit")
    ).where("us is not null")
    where = ["user_id", "stream", F.col("us") - F.pmod("us", F.lit(stretch_us))]
    spread = rows.repartition(partitions, *where) if partitions else rows.repartition(*where)
    parts = spread.sortWithinPartitions("user_id", "stream", "us", "unit").mapInArrow(_scanner(gap_us, stretch_us), PARTS)
    whole = parts.where("not edge").drop("edge")
    # parts at the ends of stretches, joined where the next part of the stream begins within the gap
    w = W.partitionBy("user_id", "stream").orderBy("start_us")
    fresh = F.coalesce((F.col("start_us") - F.lag("end_us").over(w) > gap_us).cast("int"), F.lit(1))
    joined = (
        parts.where("edge").withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(w)).groupBy("user_id", "stream", "g")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"), F.min_by("first_id", "start_us").alias("first_id"), F.max_by("last_id", "start_us").alias("last_id"))
        .drop("g")
    )
    both = whole.unionByName(joined)
    return both.select(
        "user_id", "stream", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), F.col("n").alias("n_events"), "first_id", "last_id"
    )
