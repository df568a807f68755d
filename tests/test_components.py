from chunkweave.operators.components import connected_components


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 299), (301, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert {got[k] for k in range(61)} == {0} and got[200] == 100 and got[301] == 299 and len(got) == 66
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
