"""What the driver plans, broadcasts and counts in the pipeline's stages stays small."""

import numpy as np
from fixtures import docs
from ephyra.llm import quality_rules, simhash
from ephyra.llm.common import discard, materialize, written_rows


def test_limits_come_from_one_small_plan(spark):
    plan = quality_rules.thresholds(quality_rules.with_stats(docs(spark)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6 and plan.count("Window") == 0


def test_written_tables_know_their_rows(spark):
    for df, n in ((spark.range(1000).repartition(7), 1000), (spark.range(10).where("id < 0"), 0), (spark.range(10).limit(0).join(spark.range(5), "id"), 0)):
        out = materialize(df)
        assert written_rows(out) == n == out.count()
        discard(out)


def test_labels_hold_only_nodes_that_moved(spark):
    own = lambda i: np.arange(100, dtype=np.uint64) + np.uint64(1000 * i)
    like = {1: 0, 2: 0, 7: 6}  # these have the sets of those
    nodes = materialize(spark.createDataFrame([(i,) for i in range(50)], "node long"))
    sets = materialize(spark.createDataFrame([(i, bytearray(own(like.get(i, i)).tobytes())) for i in range(50)], "node long, s binary"))
    links = simhash.Linking(nodes, sets, 0.8)
    assert links.take(spark.createDataFrame([(0, 1, 3), (1, 2, 3), (6, 7, 1), (7, 9, 5), (20, 21, 4)], "a long, b long, d long"))
    assert sorted(map(tuple, links.label.collect())) == [(1, 0), (2, 0), (7, 6)]
    assert sorted(map(tuple, links.apart().collect())) == [(6, 6), (7, 6), (9, 9), (20, 20), (21, 21)]
    assert not links.take(spark.createDataFrame([(0, 2, 1), (20, 21, 4)], "a long, b long, d long"))
