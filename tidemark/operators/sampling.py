"""Training samples of two-tower models: (user, positive, negative) triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.runtime import md5_long, small
from tidemark.schema import Columns
from tidemark.sources.dataset import Dataset
from tidemark.sources.interactions import user_item_matrix

#: What a draw of 60 random bits is divided by, to lie in (0, 1].
UNIT = float(1 << 60)


def triplets(dataset: Dataset, seed: int = 0) -> DataFrame:
    """user_id, positive, negative: of each user one item drawn by weight, and one of the catalog drawn evenly (it may be a
    positive). The draw by weight keeps the least -ln(u) / weight, a partial aggregate; u are MD5s of seed, user and item."""
    matrix = user_item_matrix(dataset.raw)
    if not matrix.where(F.col(Columns.Weight) < 0).isEmpty() or not matrix.groupBy(Columns.User).agg(F.max(Columns.Weight).alias("w")).where("w <= 0").isEmpty():
        raise ValueError("Every user must have an item of positive weight, and no weight may be negative")
    u = (md5_long(F.lit(seed), *Columns.UserItem) + 1) / UNIT
    chance = F.struct((-F.log(u) / F.col(Columns.Weight)).alias("key"), Columns.Item)
    positive = matrix.where(F.col(Columns.Weight) > 0).groupBy(Columns.User).agg(F.min(chance).alias("p"))
    catalog = dataset.item_id_map.table
    n = catalog.join(dataset.hot(Columns.Item).withColumnRenamed(Columns.Item, "external"), "external", "left_semi").agg(F.count("*").alias("n"))
    drawn = positive.crossJoin(F.broadcast(n)).withColumn("internal", md5_long(F.lit(seed), F.lit("negative"), Columns.User) % F.col("n"))  # one row
    return drawn.join(small(catalog), "internal").select(Columns.User, F.col(f"p.{Columns.Item}").alias("positive"), F.col("external").alias("negative"))
