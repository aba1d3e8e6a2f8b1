"""Staged tables go when their work is done."""

import os

from pyspark.sql import functions as F

from spanloom import staging


def test_tables_of_a_run_go_at_its_end(spark):
    with staging.run(spark) as folder:
        kept = staging.stage(spark.range(5), "numbers")
        at = folder.removeprefix("file://")
        assert kept.agg(F.sum("id")).first()[0] == 10 and os.listdir(at)
    assert not os.path.exists(at)
    outside = staging.scratch(spark, "x")
    assert spark.sparkContext.applicationId in outside and "run-" not in outside
    assert staging.scratch(spark, "x") != outside
