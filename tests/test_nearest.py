import time

import numpy as np

from plotweave.operators import blocking


def test_grid_finds_what_all_distances_find():
    rng = np.random.default_rng(4)
    for at in (rng.integers(0, 30, (500, 2)).astype(float), rng.random((300, 2)) * 1e6, np.array([[5.0, 5.0]]), np.column_stack([np.arange(50.0), np.zeros(50)])):
        p = np.concatenate([rng.integers(-40, 70, (400, 2)).astype(float), rng.random((200, 2)) * 1e6])
        d = (p[:, :1] - at[:, 0]) ** 2 + (p[:, 1:] - at[:, 1]) ** 2
        assert (blocking.PointGrid(at).nearest(p) == d.argmin(axis=1)).all()


def test_nearest_of_many_takes_no_product():
    p = np.random.default_rng(5).random((60_000, 2)) * 1e4
    began = time.process_time()
    assert (blocking.PointGrid(p).nearest(p) == np.arange(len(p))).all() and time.process_time() - began < 5


def test_centres_are_spread_and_those_of_the_edges(spark, data):
    from pyspark.sql import functions as F

    from plotweave.functions import geometry as g
    from plotweave.operators import georef

    layer = spark.read.parquet(f"{data}/parcels_legacy.parquet").dropDuplicates(["fid"]).coalesce(1)
    c = georef.centres(layer)
    assert c.rdd.getNumPartitions() >= 4
    want = layer.select("fid", g.edges_centroid(g.edges("geom")).alias("c")).filter("c.x is not null")
    both = want.join(c, "fid", "full").select(F.hypot(F.col("c.x") - F.col("x"), F.col("c.y") - F.col("y")).alias("d"))
    assert both.filter("d is null or d > 1e-6").count() == 0 and both.count() > 10
