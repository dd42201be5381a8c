"""Results do not depend on partitioning (so recomputing lost partitions is safe)."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL


@pytest.mark.parametrize("name", ["batch_sequence", "consolidated_comparison", "training_set",
                                  "parse_reasoning_replies", "model_stats"])
def test_same_result_at_any_partition_count(spark, name):
    results = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, E.queries()[name](spark, SF_SMALL).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
