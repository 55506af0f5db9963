from pyspark.sql import functions as F

from orbiton.functions import sphere as S
from orbiton.operators import grid
from orbiton.sources import generators as G


def test_neighbours_cross_faces(spark):
    for res in (4, 5):
        near = grid.neighbors(spark, res)
        counts = {r["count"]: r["n"] for r in near.groupBy("cell").count().groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert counts == {8: 6 * res * res - 24, 7: 24}
        assert near.join(near.toDF("neighbor", "cell"), ["cell", "neighbor"], "left_anti").count() == 0
        far = grid.ring2(near).groupBy("cell").count().agg(F.max("count")).first()[0]
        assert far <= 16


def test_caps_hold_their_cells(spark):
    res = 6
    sites = G.uniform(spark, 500)
    placed = sites.select("site_id", *(F.col(c).cast("double").alias(f"p{c}") for c in "xyz"))
    placed = placed.withColumn("cell", S.cell_of(S.vector("p"), res)[3]).join(grid.cap_bounds(spark, res), "cell")
    assert placed.where(S.angular_separation(S.vector("p"), S.vector()) > F.col("radius")).count() == 0
    assert placed.where(grid.least_chord2(S.vector("p"), S.vector(), F.col("radius")) > 0).count() == 0


def test_sampled_lloyd_evens_out(spark):
    from orbiton.operators.build import compute

    sites, samples = G.uniform(spark, 60), G.fibonacci(spark, 6_000)
    spread = lambda s: compute(s).cell_area().agg(F.stddev("area")).first()[0]
    assert spread(grid.sampled_lloyd(sites, samples, 2)) < 0.7 * spread(sites)
