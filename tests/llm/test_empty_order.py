"""Training order of an empty table."""

import public_tokenizers
import pytest
from pyspark.errors import AnalysisException

from apisight.llm import training_order
from apisight.llm.queries import op9_training_order

JSON = public_tokenizers.path("byte_bpe_50k.json")


def test_empty_table(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    out = f"file://{folder}/order"
    assert training_order.write_training_order(docs, JSON, out).count() == 0
    found = training_order.read_shards(spark, out)
    assert found.columns == ["slot", "ids"] and found.count() == 0
    docs.write.parquet(f"{folder}/in/documents.parquet")
    assert op9_training_order(spark, f"file://{folder}/in").count() == 0
    with pytest.raises(AnalysisException):
        training_order.read_shards(spark, f"{out}-missing").count()
