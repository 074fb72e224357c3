"""Queries read the line items in one job, however often they use the panel."""

import pytest

from terracause.plans import fixtures, registry


@pytest.mark.parametrize("name", ["graph_cluster", "predict_response", "predict_residual_to_raw", "predict_level", "var_scenario_table", "graph_order", "var_counterfactual", "var_mean_path", "graph_groups"])
def test_line_items_are_read_once(spark, sf_dir, monkeypatch, name):
    made, lines = [], fixtures.lines
    monkeypatch.setattr(fixtures, "lines", lambda s, d: made.append(d) or lines(s, d))
    df = registry.queries()[name](spark, sf_dir)
    assert len(made) == 1
    assert not [f for f in df.inputFiles() if "lineitem" in f]


def test_line_items_are_shuffled_once(spark, sf_dir):
    store, listeners = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def written():
        listeners.waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = store.stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        n = fixtures.lines(spark, sf_dir).count()
        # line items, orders, customers and orders with their pixel; nothing as long as the line items twice
        assert sum(k for stage, k in written().items() if stage not in before) < 2 * n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fit_alone(spark, sf_dir):
    panel = fixtures.ard(spark, sf_dir)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(fixtures.edges_ols(panel, 0)) == rows(fixtures.edges_ols(panel, 3).where("replicate = 0"))
