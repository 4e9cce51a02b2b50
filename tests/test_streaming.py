from ontoflow.plans.ir import Dag
from ontoflow.sources.graph import Graph
from ontoflow.streaming.updates import score_stream


def test_memberships_that_arrive(spark, tmp_path):
    nodes = spark.createDataFrame([(i, None, None) for i in range(4)], "id long, dt string, num double")
    edges = spark.createDataFrame([("p", 0, 1), ("p", 2, 3)], "p string, src long, dst long")
    graph = Graph(nodes, edges, spark.createDataFrame([(1, "c", 1.0)], "id long, cls string, w double"))
    d = Dag()
    d.root("some", d.exists("p", d.atomic("c")))
    source = f"{tmp_path}/in"
    for k, rows in enumerate(([(0, "x")], [(3, "c"), (3, "c")])):
        spark.createDataFrame(rows, "id long, cls string").coalesce(1).write.mode("append").parquet(source)
        updates = spark.readStream.schema("id long, cls string").parquet(source)
        query = score_stream(graph, d, updates, f"{tmp_path}/out")
        assert query.awaitTermination(60)
        got = spark.read.parquet(f"{tmp_path}/out/members").where(f"batch = {k}")
        assert sorted(r.id for r in got.collect()) == [[0], [0, 2]][k]
