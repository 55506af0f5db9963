"""Queries over generated sites, enough of them for the paths by blocks and lattice cells, and their DuckDB SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.sphere import rounded as r6
from ..operators import build, locate as L
from ..operators.diagram import SphericalVoronoi
from ..sources import generators as G
from ..sources.packed import embeddings_as_sites

#: Sites of the diagram and of the neighbour search, and those that are located among: each above its broadcast limit.
SITES, MANY = 10_000, 25_000
#: In SQL only sites within CHORD of each other make triples, and vertices farther than half of it from their sites don't count.
CHORD = 0.12


@lru_cache(maxsize=2)
def _cached(app: str) -> SphericalVoronoi:
    return build.compute(G.fibonacci(SparkSession.getActiveSession(), SITES))


def diagram(spark: SparkSession) -> SphericalVoronoi:
    return _cached(spark.sparkContext.applicationId)


def fibonacci_triangles(spark: SparkSession, d: str) -> DataFrame:
    t = diagram(spark).triangles().select(F.array_sort(F.array("a", "b", "c")).alias("t"))
    return t.select(*(F.col("t")[i].alias(n) for i, n in enumerate("abc")))


def fibonacci_areas(spark: SparkSession, d: str) -> DataFrame:
    return diagram(spark).cell_area().select("site_id", r6(F.col("area"), 9).alias("area"))


def fibonacci_knn8(spark: SparkSession, d: str) -> DataFrame:
    return L.knn(G.fibonacci(spark, SITES), 8).select("site_id", "rank", "neighbor_id", r6(F.col("dot"), 9).alias("dot"))


def fibonacci_locate(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of MANY sites to each embedding."""
    asked = embeddings_as_sites(spark.read.parquet(f"{d}/embeddings.parquet"), 4).withColumnRenamed("site_id", "query_id")
    return L.SphereLocator(G.fibonacci(spark, MANY)).locate(asked).select("query_id", "site_id")


QUERIES = {f.__name__: f for f in (fibonacci_triangles, fibonacci_areas, fibonacci_knn8, fibonacci_locate)}


def sites_sql(n: int, name: str = "sites") -> str:
    """name: the generated sites."""
    return f"""{name} AS (SELECT i AS site_id, (r * cos(t) / n)::FLOAT AS x, (r * sin(t) / n)::FLOAT AS y, (z / n)::FLOAT AS z FROM (SELECT *, sqrt(r * cos(t) * r * cos(t) + r * sin(t) * r * sin(t) + z * z) AS n
 FROM (SELECT *, sqrt(1 - z * z) AS r, i * {G.GOLDEN!r}::DOUBLE AS t FROM (SELECT range AS i, 1 - (2 * range + 1) / {float(n)!r}::DOUBLE AS z FROM range({n})))))"""


def mesh_sql(n: int) -> str:
    """sites as a diagram stores them, u, tri and pairs as for the embeddings, from triples of near sites."""
    return f"""{sites_sql(n, "raw")},
sites AS (SELECT site_id, (x / n)::FLOAT AS x, (y / n)::FLOAT AS y, (z / n)::FLOAT AS z FROM (SELECT *, sqrt(x::DOUBLE * x::DOUBLE + y::DOUBLE * y::DOUBLE + z::DOUBLE * z::DOUBLE) AS n FROM raw)),
u AS (SELECT site_id, x / n AS x, y / n AS y, z / n AS z FROM (SELECT site_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, sqrt(x::DOUBLE * x::DOUBLE + y::DOUBLE * y::DOUBLE + z::DOUBLE * z::DOUBLE) AS n FROM sites)),
pr AS MATERIALIZED (SELECT p.site_id AS a, q.site_id AS b FROM u p JOIN u q ON p.site_id <> q.site_id AND q.z BETWEEN p.z - {CHORD} AND p.z + {CHORD} AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) < {CHORD * CHORD}),
tr AS (SELECT p.a, p.b, q.b AS c FROM pr p JOIN pr q ON p.a = q.a AND p.b < q.b JOIN pr o ON o.a = p.b AND o.b = q.b WHERE p.a < p.b),
nv AS (SELECT t.*, p.x AS px, p.y AS py, p.z AS pz,
  (q.y - p.y) * (o.z - p.z) - (q.z - p.z) * (o.y - p.y) AS nx, (q.z - p.z) * (o.x - p.x) - (q.x - p.x) * (o.z - p.z) AS ny, (q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) AS nz
  FROM tr t JOIN u p ON p.site_id = t.a JOIN u q ON q.site_id = t.b JOIN u o ON o.site_id = t.c),
un AS (SELECT a, b, c, px, py, pz, s * nx / l AS x, s * ny / l AS y, s * nz / l AS z FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l, CASE WHEN nx * px + ny * py + nz * pz < 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS s FROM nv)),
ok AS (SELECT *, row_number() OVER () AS i FROM un WHERE 2 - 2 * (px * x + py * y + pz * z) < {CHORD * CHORD / 4}),
bad AS (SELECT DISTINCT i FROM ok JOIN pr ON pr.a = ok.a JOIN u ON u.site_id = pr.b WHERE pr.b NOT IN (ok.b, ok.c) AND u.x * ok.x + u.y * ok.y + u.z * ok.z > ok.px * ok.x + ok.py * ok.y + ok.pz * ok.z + 1e-13),
tri AS MATERIALIZED (SELECT a, b, c, x, y, z FROM ok WHERE i NOT IN (SELECT i FROM bad)),
pairs AS (SELECT a, b FROM tri UNION SELECT a, c FROM tri UNION SELECT b, c FROM tri)"""
