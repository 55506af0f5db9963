import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbiton.errors import IndexedSphereQueryError, InvalidInput
from orbiton.functions import sphere as S
from orbiton.operators import locate as L, weld as W
from orbiton.operators.quality import stats
from orbiton.sources import generators as G
from orbiton.sources.packed import read_packed
from orbiton.streaming.locate import locate_stream
from orbiton.tables import components, dense_ids


def random(n, seed=0):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def brute(queries, sites):
    q, s = np.float32(queries).astype(float), np.float32(sites).astype(float)
    return (q[:, :1] * s[:, 0] + q[:, 1:2] * s[:, 1] + q[:, 2:] * s[:, 2]).argmax(axis=1)


@pytest.mark.parametrize("held", [True, False])
def test_locate_equals_brute_force(points, monkeypatch, held):
    if not held:
        monkeypatch.setattr(L, "BROADCAST_SITES", 10)
    sites, asked = random(300), random(200, 5)
    got = L.SphereLocator(points(sites)).locate(points(asked * 7.5).withColumnRenamed("site_id", "query_id"))
    assert {r.query_id: r.site_id for r in got.collect()} == dict(enumerate(brute(asked, sites).tolist()))


def test_locate_names_the_first_bad_query(points):
    asked = random(5)
    asked[1], asked[3] = 0, np.nan
    with pytest.raises(IndexedSphereQueryError) as e:
        L.SphereLocator(points(random(20))).locate(points(asked).withColumnRenamed("site_id", "query_id"))
    assert e.value.query_index == 1


def test_stream_locate(points, spark, tmp_path):
    sites, asked = random(50), random(40, 3)
    points(asked).withColumnRenamed("site_id", "query_id").write.parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema("query_id long, x float, y float, z float").parquet(f"{tmp_path}/q")
    q = locate_stream(stream, L.SphereLocator(points(sites))).writeStream.format("memory").queryName("located").start()
    q.processAllAvailable()
    q.stop()
    assert {r.query_id: r.site_id for r in spark.sql("select * from located").collect()} == dict(enumerate(brute(asked, sites).tolist()))


@pytest.mark.parametrize("n", [60, 2500])
def test_knn(points, n):
    p = np.float32(random(n)).astype(float)
    got = {(r.site_id, r.rank): r.neighbor_id for r in L.knn(points(p), 4).collect()}
    for i in range(0, n, max(1, n // 50)):
        d = p @ p[i]
        d[i] = -2
        assert [got[i, k] for k in range(1, 5)] == np.argsort(-d, kind="stable")[:4].tolist()


def test_weld_pairs_equal_all_pairs(points):
    p = np.float32(random(400))
    r = np.float32(0.08)
    d = ((p[:, None] - p[None]) ** 2)
    d = d[..., 0] + d[..., 1] + d[..., 2]
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if d[i, j] < r * r}
    assert {(x.a, x.b) for x in W.near_pairs(points(p), "site_id", float(r)).collect()} == want


def test_components_of_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 8), (8, 7), (3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[7] == got[8] == got[9] == 7 and 3 not in got


def test_dense_ids(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "k long").repartition(5)
    assert all(r.k == r.i for r in dense_ids(df, ["k"], "i").collect())


def test_cube_map_round_trip(spark):
    res = 8
    df = spark.range(6 * res * res)
    face, iu, iv = S.cell_to_face_ij(F.col("id"), res)
    p = S.face_uv_to_point(face, *(S.st_to_uv((i + 0.5) / res) for i in (iu, iv)))
    placed = df.select("id", *(c.alias(n) for c, n in zip(p, "xyz")))
    assert placed.where(S.cell_of(S.vector(), res)[3] != F.col("id")).count() == 0


def test_face_ties_go_to_x_then_y(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, 1.0, 1.0), (-1.0, 1.0, -1.0), (0.0, 0.0, -1.0)], "x double, y double, z double")
    assert [r[0] for r in df.select(S.face_uv(S.vector())[0]).collect()] == [0, 2, 1, 5]


def test_projection_survives_overflow(spark):
    big = 1.7e308
    e = S.SphereEmbedding((-big, 0.0, 0.0), 1.0)
    df = spark.createDataFrame([(0, big, 0.0, 0.0), (1, -big, 1.0, 0.0), (2, -big, 0.0, 0.0), (3, float("inf"), 0.0, 0.0)], "id long, x double, y double, z double")
    r = {x.id: (x.ux, x.uy, x.uz) for x in e.project(df).collect()}
    assert r[0] == (1, 0, 0) and r[1] == (0, 1, 0) and r[2][0] is None and r[3][0] is None


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(200)], "v double")
    s = stats(df, "v").first()
    assert (s.n, s["max"], s["mean"], s.p95, s.p99) == (200, 199.0, 99.5, 189.0, 197.0)


def test_owner_arcs(spark):
    g, h = (math.sin(0.1), 0.0, math.cos(0.1)), (-math.sin(0.1), 0.0, math.cos(0.1))
    a, b = (0.0, 0.0, 1.0), (0.0, 1.0, 0.0)
    df = spark.createDataFrame([(*a, *b, *g, *h)], ", ".join(f"{p}{c} double" for p in "abgh" for c in "xyz"))
    r = S.owner_arcs(df).first()
    assert r.arc_kind == "ordinary" and abs(r.angle - math.pi / 2) < 1e-12 and abs(r.ty - 1) < 1e-12


def test_generators_are_stable_and_on_the_sphere(spark):
    for make in G.FAMILIES.values():
        a, b = make(spark, 40), make(spark.newSession(), 40).repartition(3)
        assert a.where(~S.is_stored_point(S.vector())).count() == 0
        assert sorted(a.collect()) == sorted(b.collect())
    assert G.cubed_sphere(spark, 3).count() == 54


def test_packed_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(struct.pack("<6f", *range(6)))
    (tmp_path / "b.bin").write_bytes(struct.pack("<3f", 7, 8, 9))
    assert sorted(map(tuple, read_packed(spark, str(tmp_path)).collect())) == [(0, 0.0, 1.0, 2.0), (1, 3.0, 4.0, 5.0), (2, 7.0, 8.0, 9.0)]
    (tmp_path / "c.bin").write_bytes(b"12345")
    with pytest.raises(InvalidInput):
        read_packed(spark, str(tmp_path))
