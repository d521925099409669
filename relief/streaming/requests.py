"""Point-value requests as a stream.

The reference answers value requests one HTTP call at a time.  Here the same
logic (S5 validation + G1 reprojection + K4 lookup) runs over an unbounded
request table: ``readStream`` of JSON request files, a stateless stream-static
join with the stored tile layer on the tile key, and any streaming sink.  No
state, so no watermark is needed; the checkpoint location makes the query
restartable after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relief.operators.zonal import point_values_tiles
from relief.schema import POINTS, Grid
from relief.sources.requests import point_requests


def start_point_value_stream(
    spark: SparkSession, request_dir: str, tiles: DataFrame, grid: Grid, out_dir: str, reject_dir: str, checkpoint_dir: str, available_now: bool = True
):
    """Start the stream: answers to ``out_dir`` and rejects to ``reject_dir``, as parquet by batch; ``available_now``
    processes what is there and stops."""
    requests = spark.readStream.schema(POINTS).json(request_dir)

    def answer(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure overwrites its own folders
        valid, rejected = point_requests(batch)
        point_values_tiles(valid, tiles, grid).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")
        rejected.select("id", F.lit("bad_request").alias("reason")).write.mode("overwrite").parquet(f"{reject_dir}/batch={number}")

    w = requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
