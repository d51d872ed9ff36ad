"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

The tables are first copied into as many files as there are cores: each comes
as one file of one row group, which Spark cannot split, while a corpus comes in
many. Every query then runs in full into a sink that keeps nothing. The time
given is the median of three runs after a first one.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from cuesheet.plans.catalog import queries
from cuesheet.session import local_session

HEADLINE = [
    "clean_text",
    "sentences",
    "cue_wrap",
    "caption_wrap",
    "cue_chunks",
    "tts_chunks",
    "text_cues",
    "cue_stats",
    "srt_documents",
    "vtt_documents",
    "text_stats",
    "doc_assembly",
    "page_cues",
    "document_cues",
    "page_srt",
    "synthesis_requests",
    "unique_names",
    "job_validation",
    "project_manifest",
    "output_layout",
    "voice_match",
    "concat_plan",
]
TABLES = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def split_copy(spark: SparkSession, folder: str, parts: int) -> str:
    """A folder with the tables in `parts` files each."""
    target = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, key in TABLES.items():
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        table.repartition(parts, key).write.mode("overwrite").parquet(f"{target}/{name}.parquet")
    return target


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "cuesheet-bench")
    spark.sparkContext.setLogLevel("ERROR")
    sf, folder = folder, split_copy(spark, folder, spark.sparkContext.defaultParallelism)
    available = queries()

    def run(name: str) -> float:
        began = time.perf_counter()
        available[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(3)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf)),
            }
        )
    )


if __name__ == "__main__":
    main()
