from veldt.plans import graph_queries as G

FOLDER = "/root/testdata/sf0.001"


def test_views_of_the_graph_start_from_written_tables(spark):
    """As cached plans, each stage of a view carried the tasks and metrics of the whole chain, all sent to the driver."""
    for df in G.graph_of(spark, FOLDER):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" not in plan and "Join" not in plan and "Aggregate" not in plan
        assert df.count() > 0
