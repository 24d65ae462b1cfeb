"""Buckets that no mask divides further."""

from palimpsest.llm.simhash import components, near_links


def test_dense_group_ends(spark):
    fps = [sum(1 << 2 * n for n in range(9) if x >> n & 1) for x in range(1 << 9)]
    far = [(1 << 62) - (1 << 40), (1 << 40) - (1 << 20)]
    df = spark.createDataFrame([(x,) for x in fps + far], "fp long")
    root = {r.node: r.root for r in components(near_links(df, radius=11, parts=3, bucket=64)).collect()}
    assert {root[x] for x in fps} == {0} and not {root.get(x, x) for x in far} & {0}
