"""Incremental VCF ingestion: new text files in a folder -> long genotype Parquet.

The sample header is read once (batch) from a header file, because a stream
of body shards carries no ``#CHROM`` line per micro-batch; every micro-batch
is then parsed with the batch operators and appended idempotently through
``foreachBatch`` (the batch id is part of the output path, so a replayed batch
overwrites its own output instead of duplicating it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelo.sources import vcf


def vcf_stream(spark: SparkSession, body_dir: str, header_path: str, out_dir: str, checkpoint: str,
               max_files_per_trigger: int = 64):
    """Start a stream that turns VCF body files under ``body_dir`` into long rows under ``out_dir``.

    Returns the ``StreamingQuery``; use ``trigger(availableNow=True)``-style
    draining via ``processAllAvailable()`` in tests.
    """
    samples, n = vcf.read_samples(spark, header_path)
    s = F.broadcast(samples) if n <= vcf.SAMPLE_BROADCAST_ROWS else samples
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(body_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        cells = vcf.parse_cells(batch).join(s, "sample_pos").select(
            "subject_id", "contig", "pos", "ref", "alt", "allele")
        cells.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return (lines.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint).start())
