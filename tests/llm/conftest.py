import pytest


@pytest.fixture
def frame(spark):
    """A small documents-like frame with a clashing extra column."""
    def make(rows, schema="doc_id long, text string", extra=True):
        df = spark.createDataFrame(rows, schema)
        if extra:
            from pyspark.sql import functions as F
            df = df.withColumn("block", F.lit("x")).withColumn("n", F.lit(7)).withColumn("size", F.lit("?"))
        return df.repartition(3)
    return make
