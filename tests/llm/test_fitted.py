"""Models are fitted in a task on the same rows, in the same order, as on the driver."""

import os

from tessella.llm.labelled import fitted, training_sample


def test_fitted_in_a_task(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    args = (docs, labels, "toxic", 50, 1000, 7)
    where, seen = fitted(lambda sample: (os.getpid(), sample), *args)
    assert where != os.getpid() and len(seen) == 50 and seen == training_sample(*args)
    assert fitted(len, docs, labels.limit(0), *args[2:]) == 0
