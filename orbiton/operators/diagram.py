"""A diagram as a bundle of tables, and what is derived from it."""

from __future__ import annotations

import dataclasses
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..config import NEAR_PI, VoronoiConfig
from ..errors import InvalidInput
from ..functions import sphere as S
from ..tables import dense_ids, written


@dataclasses.dataclass
class SphericalVoronoi:
    """sites (site_id, x, y, z FLOAT), weld (site_id, canonical_id), cell_edges (cell_id, pos, v0, v1,
    neighbor_id), vertices (vertex_id, g0, g1, g2, x, y, z DOUBLE).

    cell_edges holds canonical cells, their corners counter-clockwise from outside; a welded twin has its
    canonical site's cell. A vertex is known by its three sites g0 < g1 < g2.
    """

    sites: DataFrame
    weld: DataFrame
    cell_edges: DataFrame
    vertices: DataFrame
    config: VoronoiConfig = VoronoiConfig()
    preprocess: dict = dataclasses.field(default_factory=dict)
    degenerate: dict = dataclasses.field(default_factory=dict)
    assembly: object = None
    rebuild_status: str = "not_triggered"
    resolution: dict = dataclasses.field(default_factory=dict)

    # Access ------------------------------------------------------------------------------------------

    def num_cells(self) -> int:
        return self.weld.count()

    def num_vertices(self) -> int:
        return self.vertices.count()

    def effective_cell_count(self) -> int:
        return self.weld.where("site_id = canonical_id").count()

    def welded_twin_count(self) -> int:
        return self.weld.where("site_id <> canonical_id").count()

    def canonical(self) -> DataFrame:
        """Sites that have a cell of their own."""
        return self.sites.join(self.weld.where("site_id = canonical_id").select("site_id"), "site_id", "left_semi")

    def cells(self) -> DataFrame:
        """(site_id, canonical_id, degree, vertex_ids) of every input site."""
        own = self.cell_edges.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v0"))), lambda s: s["v0"]).alias("vertex_ids"))
        return self.weld.join(own, self.weld["canonical_id"] == own["cell_id"], "left").select("site_id", "canonical_id", F.coalesce(F.size("vertex_ids"), F.lit(0)).alias("degree"), "vertex_ids")

    def cell(self, site_id: int):
        """The row of cells() of one site, None if there is no such site."""
        one = self.weld.where(F.col("site_id") == site_id).first()
        if one is None:
            return None
        edges = self.cell_edges.where(F.col("cell_id") == one["canonical_id"]).orderBy("pos").collect()
        return (site_id, one["canonical_id"], len(edges), [e["v0"] for e in edges])

    def generator(self, site_id: int):
        return self.sites.where(F.col("site_id") == site_id).first()

    def vertex(self, vertex_id: int):
        return self.vertices.where(F.col("vertex_id") == vertex_id).first()

    def canonical_cell_index(self, site_id: int) -> int | None:
        row = self.weld.where(F.col("site_id") == site_id).first()
        return None if row is None else row["canonical_id"]

    def weld_map(self) -> DataFrame:
        return self.weld

    def effective(self) -> DataFrame:
        """(effective_index, site_id): the dense zero-based index of canonical sites."""
        return dense_ids(self.weld.where("site_id = canonical_id").select("site_id"), ["site_id"], "effective_index")

    def compact_vertices(self) -> tuple["SphericalVoronoi", int]:
        """The diagram without vertices that no cell uses, ids dense anew, and how many went."""
        used = self.cell_edges.select(F.col("v0").alias("vertex_id")).distinct()
        kept = self.vertices.join(used, "vertex_id", "left_semi").withColumnRenamed("vertex_id", "old")
        kept = written(dense_ids(kept, ["g0", "g1", "g2", "old"], "vertex_id"))
        ids = kept.select("old", "vertex_id")
        edges = self.cell_edges
        for end in ("v0", "v1"):
            edges = edges.join(ids.select(F.col("old").alias(end), F.col("vertex_id").alias("_n")), end).withColumn(end, F.col("_n")).drop("_n")
        removed = self.vertices.count() - kept.count()
        return dataclasses.replace(self, cell_edges=written(edges.select("cell_id", "pos", "v0", "v1", "neighbor_id")), vertices=kept.drop("old")), removed

    # Derived -----------------------------------------------------------------------------------------

    @cached_property
    def geometry(self) -> DataFrame:
        """cell_edges with ax..az, bx..bz (the ends), gx..gz (the cell's site) and hx..hz (the neighbour's), doubles."""
        ends = self.vertices.select("vertex_id", "x", "y", "z")
        sites = self.sites.select("site_id", *(F.col(c).cast("double").alias(c) for c in "xyz"))
        out = self.cell_edges
        for table, key, on, p in ((ends, "vertex_id", "v0", "a"), (ends, "vertex_id", "v1", "b"), (sites, "site_id", "cell_id", "g"), (sites, "site_id", "neighbor_id", "h")):
            out = out.join(table.select(F.col(key).alias(on), *(F.col(c).alias(p + c) for c in "xyz")), on, "left")
        return written(out)

    def adjacency(self) -> DataFrame:
        """(cell_id, pos, neighbor_id) of every canonical cell, in order of its edges."""
        return self.cell_edges.select("cell_id", "pos", "neighbor_id")

    def neighbors_of(self, site_id: int) -> DataFrame:
        cell = self.canonical_cell_index(site_id)
        return self.adjacency().where(F.col("cell_id") == (-1 if cell is None else cell)).orderBy("pos").select("neighbor_id")

    def is_complete(self) -> bool:
        """Every edge has a neighbour."""
        return self.cell_edges.where("neighbor_id is null").limit(1).count() == 0

    def adjacent_pairs(self) -> DataFrame:
        """(a, b), a < b, once for each pair of neighbours."""
        return self.cell_edges.where("cell_id < neighbor_id").select(F.col("cell_id").alias("a"), F.col("neighbor_id").alias("b")).distinct()

    def triangles(self) -> DataFrame:
        """(vertex_id, k, a, b, c): the Delaunay fan of every vertex, counter-clockwise from outside."""
        around = self.cell_edges.select(F.col("v0").alias("vertex_id"), "cell_id").distinct()
        around = around.join(self.vertices.select("vertex_id", *(F.col(c).alias(f"p{c}") for c in "xyz")), "vertex_id")
        around = around.join(self.sites.select(F.col("site_id").alias("cell_id"), "x", "y", "z"), "cell_id")
        e1, e2 = S.tangent_basis(S.vector("p"))
        angle = F.atan2(S.dot(S.vector(), e2), S.dot(S.vector(), e1))
        ring = around.groupBy("vertex_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(angle.alias("t"), "cell_id"))), lambda s: s["cell_id"]).alias("r"))
        fan = F.transform(F.sequence(F.lit(1), F.size("r") - 2), lambda k: F.struct(k.alias("k"), F.element_at("r", 1).alias("a"), F.element_at("r", k + 1).alias("b"), F.element_at("r", k + 2).alias("c")))
        return ring.where("size(r) >= 3").select("vertex_id", F.explode(fan).alias("t")).select("vertex_id", (F.col("t.k") - 1).alias("k"), "t.a", "t.b", "t.c")

    @cached_property
    def long_edges(self) -> DataFrame:
        """The rare edges of almost pi between two known cells, with their arcs."""
        return S.owner_arcs(self.geometry.where(self._is_long()))

    def _is_long(self):
        return (S.dot(S.vector("a"), S.vector("b")) <= -1 + NEAR_PI) & F.col("hx").isNotNull()

    def cell_area(self) -> DataFrame:
        """(site_id, area) of every input site: the fan about the site, long edges in two halves; under 3 corners 0."""
        a, b, m = (S.vector(p) for p in "abm")
        g = S.unit(S.vector("g"))  # stored sites are 32-bit: their length is off by up to 1e-7
        short = self.geometry.where(~self._is_long()).select("cell_id", S.solid_angle(g, a, b).alias("piece"))
        half = F.col("angle") / 2
        mid = self.long_edges.withColumns({f"m{c}": F.cos(half) * F.col(f"p{c}") + F.sin(half) * F.col(f"t{c}") for c in "xyz"})
        pieces = short.union(mid.select("cell_id", S.solid_angle(g, a, m) + S.solid_angle(g, m, b)))
        own = pieces.groupBy("cell_id").agg(F.abs(F.sum("piece")).alias("area"), F.count(F.lit(1)).alias("n"))
        out = self.weld.join(own, self.weld["canonical_id"] == own["cell_id"], "left")
        return out.select("site_id", F.when(F.col("n") >= 3, F.col("area")).otherwise(0.0).alias("area"))

    def _centroids(self) -> DataFrame:
        a, b = S.vector("a"), S.vector("b")
        short = self.geometry.where(~self._is_long()).withColumns({f"n{c}": e for c, e in zip("xyz", S.cross(a, b))}).withColumn("_l", S.length(S.vector("n")))
        turn = F.when(F.col("_l") > 2.220446049250313e-16, F.atan2(F.col("_l"), S.dot(a, b)) / F.col("_l")).otherwise(0.0)
        shape = ("cell_id", "gx", "gy", "gz")
        parts = short.select(*shape, *(turn * F.col(f"n{c}") for c in "xyz")).union(self.long_edges.select(*shape, *(F.col("angle") * F.col(f"n{c}") for c in "xyz"))).toDF(*shape, "mx", "my", "mz")
        sums = parts.groupBy("cell_id").agg(*(F.sum(f"m{c}").alias(f"m{c}") for c in "xyz"), *(F.first(f"g{c}").alias(f"g{c}") for c in "xyz"))
        m, g = S.vector("m"), S.vector("g")
        sums = sums.withColumns({"_l": S.length(m), "_f": F.when(S.dot(m, g) < 0, -1.0).otherwise(1.0)})
        return sums.select("cell_id", *(F.when(F.col("_l") > 2.220446049250313e-16, p / F.col("_l") * F.col("_f")).otherwise(q).alias(f"c{c}") for c, p, q in zip("xyz", m, g)))

    def cell_centroid(self) -> DataFrame:
        """(site_id, x, y, z DOUBLE) of every input site: the direction of the cell's first moment."""
        own = self._centroids()
        out = self.weld.join(own, self.weld["canonical_id"] == own["cell_id"], "left").join(self.sites, "site_id")
        return out.select("site_id", *(F.coalesce(f"c{c}", F.col(c).cast("double")).alias(c) for c in "xyz"))

    def lloyd_step(self) -> DataFrame:
        """(site_id, x, y, z FLOAT): every site moved to its cell's centroid; twins go with their canonical site."""
        return self.cell_centroid().select("site_id", *(F.col(c).cast("float").alias(c) for c in "xyz"))

    def edge_lengths(self) -> DataFrame:
        """(a, b, v0, v1, chord): once for each edge, by its two cells a < b."""
        return self.geometry.where("cell_id < neighbor_id").select(F.col("cell_id").alias("a"), F.col("neighbor_id").alias("b"), "v0", "v1", F.sqrt(S.chord2(S.vector("a"), S.vector("b"))).alias("chord"))

    def build_locator(self):
        from .locate import SphereLocator

        return SphereLocator(self.canonical())

    def validate(self):
        from .validate import validate

        return validate(self)

    # Written form --------------------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """The bundle as Parquet below path."""
        for name in ("sites", "weld", "cell_edges", "vertices"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SphericalVoronoi":
        """A saved bundle; its constraints are checked by queries.

        Every site has one weld row; canonical ids are canonical and not above their twins; edges name stored
        cells and vertices; corners are numbered from 0 without gaps.
        """
        t = {n: spark.read.parquet(f"{path}/{n}") for n in ("sites", "weld", "cell_edges", "vertices")}
        out = SphericalVoronoi(**t)
        roots = out.weld.where("site_id = canonical_id").select(F.col("site_id").alias("canonical_id"))
        problems = [
            (out.sites.join(out.weld, "site_id", "left_anti"), "site_id", "a site without a weld row"),
            (out.weld.groupBy("site_id").count().where("count > 1"), "site_id", "a site with two weld rows"),
            (out.weld.where("canonical_id > site_id"), "site_id", "a canonical id above its twin"),
            (out.weld.join(roots, "canonical_id", "left_anti"), "site_id", "a canonical id that is not canonical"),
            (out.cell_edges.join(roots.withColumnRenamed("canonical_id", "cell_id"), "cell_id", "left_anti"), "cell_id", "a cell that is no canonical site"),
            (out.cell_edges.join(out.vertices.select(F.col("vertex_id").alias("v0")), "v0", "left_anti"), "cell_id", "an edge at a vertex that is not stored"),
            (out.cell_edges.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("m"), F.countDistinct("pos").alias("d")).where("m + 1 <> n or d <> n"), "cell_id", "corners that are not numbered in a row"),
            (out.vertices.where(~S.finite(S.vector()) | (F.abs(S.dot(S.vector(), S.vector()) - 1) > 1e-4)), "vertex_id", "a vertex off the sphere"),
        ]
        for df, key, message in problems:
            first = df.agg(F.min(key)).first()[0]
            if first is not None:
                raise InvalidInput(first, message)
        return out


def window_rank(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """df with the zero-based rank within group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
