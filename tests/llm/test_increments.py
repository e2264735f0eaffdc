import pytest

from panelforge.llm.linkage import increments


@pytest.mark.parametrize("batches, parts", [(1, 2), (5, 4), (4, 3), (6, 2)])
def test_null_batches_are_in_the_last_increment(spark, batches, parts):
    df = spark.createDataFrame([(i, i) for i in range(batches)] + [(99, None)], "proposal_id int, batch_no int")
    got = [[r["proposal_id"] for r in x.collect()] for x in increments(df, parts)]
    assert sorted(i for x in got for i in x) == [*range(batches), 99] and 99 in got[-1]
