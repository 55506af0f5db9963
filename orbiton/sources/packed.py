"""Packed files: little-endian 32-bit x, y, z triples without a header."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, x, y, z FLOAT) of the files at path, numbered in the order of paths; a length that isn't a multiple of 12 raises."""
    files = spark.read.format("binaryFile").load(path)
    sizes = files.select("path", "length")
    bad = sizes.where("length % 12 <> 0").agg(F.min("path")).first()[0]
    if bad is not None:
        raise InvalidInput(0, f"{bad} is not a whole number of triples")
    # One row for each file.
    first = sizes.select("path", (F.sum("length").over(Window.orderBy("path")) / 12 - F.col("length") / 12).cast("bigint").alias("first"))

    def run(batches):
        for pdf in batches:
            for start, content in zip(pdf["first"], pdf["content"]):
                p = np.frombuffer(content, "<f4").reshape(-1, 3)
                yield pd.DataFrame({"site_id": np.arange(start, start + len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return files.select("path", "content").join(first, "path").select("first", "content").mapInPandas(run, "site_id long, x float, y float, z float")


def embeddings_as_sites(df: DataFrame, first: int = 1, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """(site_id, x, y, z FLOAT): three components of a vector column, from number `first` on, as directions."""
    from ..functions import sphere as S

    parts = tuple(F.col(values)[i].cast("double") for i in range(first - 1, first + 2))
    return df.select(F.col(key).alias("site_id"), *S.as_float(S.unit(parts)))
