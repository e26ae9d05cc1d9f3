"""Kept columns that bear a result's name."""

import pyarrow as pa
from pyspark.sql import types as T

from talus.llm.common import map_texts


def test_kept_columns_give_way(spark):
    docs = spark.createDataFrame([(1, "ab", 0.5, "x"), (2, None, None, None)], "doc_id long, text string, score double, SIZE string")
    fields = {"score": (T.DoubleType(), pa.float64()), "size": (T.LongType(), pa.int64())}
    found = map_texts(docs, ["doc_id", "score", "SIZE", "doc_id"], lambda texts: [[1.0] * len(texts), [len(t or "") for t in texts]], fields)
    assert found.columns == ["doc_id", "_score", "_SIZE", "score", "size"]
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 0.5, "x", 1.0, 2), (2, None, None, 1.0, 0)]
