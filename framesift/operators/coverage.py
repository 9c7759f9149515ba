"""Coverage of a data set: embeddings on a plane."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.text import point_label


def principal_components(rows: DataFrame, key: str, embedding: str, k: int) -> DataFrame:
    """key, vector: the first k principal components of the centred embeddings."""
    vectors = rows.select(key, array_to_vector(F.col(embedding).cast("array<double>")).alias("v"))
    mean = vectors.agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    centred = vectors.join(F.broadcast(mean)).select(key, array_to_vector(F.zip_with(vector_to_array("v"), "m", lambda a, b: a - b)).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(centred)
    return model.transform(centred).select(key, vector_to_array("p").alias("vector"))


def principal_plane(rows: DataFrame, key: str = "path", embedding: str = "embedding", k: int = 2) -> DataFrame:
    """key, x, y: the first principal components of the centred embeddings."""
    found = principal_components(rows, key, embedding, k)
    return found.select(key, F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y"))


def percent_coordinates(points: DataFrame) -> DataFrame:
    """Adds x_pct, y_pct: the place within the range of all points; the middle where all are alike."""
    ends = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    pct = lambda c: F.coalesce((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)) * 100, F.lit(50.0))
    out = points.join(F.broadcast(ends)).withColumn("x_pct", pct("x")).withColumn("y_pct", 100 - pct("y"))
    return out.drop("lo_x", "hi_x", "lo_y", "hi_y")


def point_labels(files: DataFrame) -> DataFrame:
    """Adds label to (parent, name)."""
    shared = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1
    return files.withColumn("label", point_label(F.col("name"), F.col("parent"), shared))


def mock_embedding(name, size: int = 8):  # noqa: ANN001, ANN201
    """A made-up embedding that depends on a name alone, for runs without a model."""
    return F.array(*[(F.pmod(F.crc32(F.concat(name, F.lit(f"#{i}")).cast("binary")), F.lit(2001)) / 1000.0 - 1.0).cast("float") for i in range(size)])
