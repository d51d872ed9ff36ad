from pyspark.sql import functions as F

from cuesheet.plans import catalog
from cuesheet.streaming.scripts import arriving_subtitles, write_arriving
from tests.conftest import SMALL


def test_a_stream_gives_the_files_of_the_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    inbox, out, state = (str(tmp_path / name) for name in ("inbox", "out", "state"))
    for half in (0, 1):
        docs.where(F.col("doc_id") % 2 == half).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(docs.schema).parquet(inbox)
        write_arriving(arriving_subtitles(stream, "doc_id"), out, state).awaitTermination()
    got = spark.read.parquet(out).select("doc_id", "srt")
    want = catalog.srt_documents(spark, SMALL)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
