"""What of a fit reaches the driver, and in what form."""

import tracemalloc

from pyspark.sql import functions as F

from tallyframe.llm import quality


def test_states_of_a_fit_are_columns_on_the_driver(spark):
    """300,000 features set most coordinates; as Python rows each would take 200 bytes or more of the driver."""
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 3000), i -> concat('w', id * 3000 + i)))").alias("text"))
    labels = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    tracemalloc.start()
    weights = quality.fit(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (weights != 0).any()
    assert peak < 40 << 20
