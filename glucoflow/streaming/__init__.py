"""Incremental runs over a folder where export files keep arriving.

The reference processes one file per run and has no streaming operators;
this module adds none.  A file stream lists new export files per
micro-batch, and ``foreachBatch`` runs the ordinary batch pipeline on
exactly those files, writing one run folder per batch.  Progress (which
files were processed) lives in the stream's checkpoint, so a restarted job
continues where it stopped and a failed batch is retried as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glucoflow.session import checkpoint_dir

_BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch_exports(
    spark: SparkSession,
    input_dir: str,
    out_dir: str,
    layout=None,
    checkpoint: str | None = None,
    glob: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int = 1000,
    **params,
):
    """Start a stream that runs ``workflow.run`` on every batch of new files.

    Returns the ``StreamingQuery``.  With ``available_now`` the stream
    processes what is there and stops (a scheduled incremental job).
    """
    from glucoflow.plans import workflow

    reader = spark.readStream.format("binaryFile").schema(_BINARY_SCHEMA)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.load(input_dir).select("path")  # content is never read here

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        # at most max_files_per_trigger names; the data itself is read by the
        # batch pipeline on the executors
        paths = [r["path"] for r in batch.collect()]
        if paths:
            workflow.run(spark, paths, f"{out_dir.rstrip('/')}/batch={batch_id}", layout=layout, **params)

    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/glucoflow-stream"
    writer = files.writeStream.foreachBatch(run_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
