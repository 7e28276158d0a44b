"""Rasters as a stream: new GeoTIFF files in a folder, each batch through a plan, then stop when none is left."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.geotiff import CELLS, decode


def stream_cells(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """A streaming table of the cells of all files that come into ``folder``."""
    files = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("pathGlobFilter", "*.tif").option("maxFilesPerTrigger", files_a_batch).load(folder))

    def run(batches):
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                z = decode(data).values.astype(float)
                y, x = np.indices(z.shape, dtype=np.int32)
                yield pd.DataFrame({"raster_id": p.rsplit("/", 1)[-1].rsplit(".", 1)[0], "y": y.ravel(), "x": x.ravel(), "z": z.ravel(), "ny": np.int32(z.shape[0]), "nx": np.int32(z.shape[1])})

    return files.select("path", "content").mapInPandas(run, CELLS).withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def run_available(cells: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Run a batch plan on each batch of new rasters and append its rows to ``out``. A batch run again replaces its rows."""
    def each(batch: DataFrame, epoch: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    cells.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
