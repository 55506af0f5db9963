"""Streams against a fixed diagram. An addition: both are stateless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..config import VoronoiConfig
from ..operators.build import compute
from ..operators.diagram import SphericalVoronoi
from ..operators.locate import SphereLocator


def locate_stream(queries: DataFrame, locator: SphereLocator, key: str = "query_id") -> DataFrame:
    """(key, site_id, dot) of each arriving direction (key, x, y, z); bad directions get no site. For locators that fit a broadcast."""
    return locator.locate(queries, key, checked=False)


def recompute_each_batch(stream: DataFrame, sink: Callable[[SphericalVoronoi, int], None], config: VoronoiConfig = VoronoiConfig()):
    """A writer that gives sink the diagram of every micro-batch of sites (site_id, x, y, z) with 4 rows or more."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.limit(4).count() == 4:
            sink(compute(batch, config), number)

    return stream.writeStream.foreachBatch(step)
