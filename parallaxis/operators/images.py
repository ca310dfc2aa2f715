"""Packed images: whether they can be used, and what of them goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types of an image's values: bytes from 0 to 255, or fractions.
TYPES = ("uint8", "float16", "float32", "float64")


def image_problems(images: DataFrame) -> DataFrame:
    """Adds ``problem`` to images of ``shape`` (an array), ``type`` and ``values``: the first rule that is broken, or null.

    An image has three axes, of which the first or the last has three channels, a known type, as
    many values as its shape says, and finite ones.
    """
    n = F.aggregate("shape", F.lit(1).cast("long"), lambda a, s: a * s)
    odd = F.exists("values", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    problem = (
        F.when(F.col("shape").isNull() | (F.size("shape") != 3), "not three axes").when((F.get("shape", F.lit(0)) != 3) & (F.get("shape", F.lit(2)) != 3), "not three channels")
        .when(F.col("type").isNull() | ~F.col("type").isin(*TYPES), "unknown type").when(F.col("values").isNull() | (F.size("values") != n), "not of its size").when(odd, "not finite")
    )
    return images.withColumn("problem", problem)


def usable_images(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The usable images, channels first and as fractions, and apart from them the others with their ``problem``.

    Nothing is lost: every row is in one of the two tables.
    """
    judged = image_problems(images)
    first = F.get("shape", F.lit(0)) == 3
    h, w = (F.when(first, F.get("shape", F.lit(i + 1))).otherwise(F.get("shape", F.lit(i))) for i in (0, 1))
    area = h * w
    moved = F.transform(F.sequence(F.lit(0), area * 3 - 1), lambda i: F.get("values", (i % area * 3 + F.floor(i / area)).cast("int")))
    ordered = F.when(first | (area == 0), F.col("values")).otherwise(moved)
    top = F.when(F.col("type") == "uint8", 255.0).otherwise(1.0)
    good = judged.where("problem is null").withColumns({"h": h, "w": w, "planes": F.transform(ordered, lambda v: v / top)}).drop("shape", "values", "problem")
    return good, judged.where("problem is not null")
