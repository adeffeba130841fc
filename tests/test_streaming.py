import os
import tempfile

from pyspark.sql import functions as F

from ledgerline.operators import clean
from ledgerline.streaming import incremental_append
from tests.conftest import rows


def test_incremental_append_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="ledgerline-stream-")
    src, sink = os.path.join(base, "raw"), os.path.join(base, "staging")
    schema = "id long, name string, w int"
    first = spark.createDataFrame([(1, " A ", 0), (2, "b", 5)], schema)
    first.write.parquet(os.path.join(src, "batch=1"))

    def step(df):
        return clean.value_to_null(clean.normalize_strings(df, trim=["name"]), ["w"], 0)

    q = incremental_append(spark, src + "/*", first.schema, step, sink,
                           checkpoint_path=os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    second = spark.createDataFrame([(3, "c ", 0)], schema)
    second.write.parquet(os.path.join(src, "batch=2"))
    q = incremental_append(spark, src + "/*", first.schema, step, sink,
                           checkpoint_path=os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(sink)
    assert rows(got, "id", "name", "w") == [(1, "A", None), (2, "b", 5), (3, "c", None)]
