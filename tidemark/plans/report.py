"""Data preparation of visual reports: requests, joined item data, metric tables; and their storage."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.runtime import md5_long, small
from tidemark.schema import Columns, require


class ReportStorage:
    """Interactions and recommendations of the chosen requests, with item data joined on."""

    def __init__(self, is_u2i: bool, requests: DataFrame, interactions: DataFrame, reco: DataFrame):
        self.is_u2i, self.requests, self.interactions, self.reco = is_u2i, requests, interactions, reco

    @property
    def id_col(self) -> str:
        return Columns.User if self.is_u2i else Columns.TargetItem

    @classmethod
    def from_raw(
        cls, reco: DataFrame | Mapping[str, DataFrame], interactions: DataFrame | None, item_data: DataFrame, selected_requests: Mapping[str, object] | None = None, n_random_requests: int = 0,
        is_u2i: bool = True, seed: int = 32,
    ) -> ReportStorage:
        """selected_requests maps names to ids; n_random_requests further ids are drawn by hash from those with recommendations."""
        id_col = Columns.User if is_u2i else Columns.TargetItem
        if isinstance(reco, Mapping):
            reco = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(Columns.Model, F.lit(n)) for n, t in reco.items()])
        require(reco.columns, [id_col, Columns.Item, Columns.Model])
        if Columns.Rank not in reco.columns and Columns.Score not in reco.columns:
            raise KeyError("Recommendations need a rank or a score")
        require(item_data.columns, [Columns.Item])
        if not selected_requests and n_random_requests <= 0:
            raise ValueError("Specify `selected_requests` or `n_random_requests`")
        spark = reco.sparkSession
        kind = reco.schema[id_col].dataType.simpleString()
        given = spark.createDataFrame([(n, v) for n, v in (selected_requests or {}).items()], f"request_name string, {id_col} {kind}")
        rest = reco.select(id_col).distinct().join(given, id_col, "left_anti")
        drawn = rest.orderBy(md5_long(F.lit(seed), id_col), id_col).limit(n_random_requests)
        numbered = drawn.select(F.concat(F.lit("random_"), F.row_number().over(_by(id_col))).alias("request_name"), id_col) if n_random_requests else given.limit(0)
        requests = given.unionByName(numbered)
        named = small(requests)
        if is_u2i:
            assert interactions is not None
            viewed = interactions.join(named, id_col)
        else:
            viewed = requests.withColumn(Columns.Item, F.col(id_col))
        # A name that both sides have stays the recommendation's; the item's gets a suffix.
        extra = [F.col(Columns.Item), *[F.col(c).alias(f"{c}_item_data" if c in reco.columns else c) for c in item_data.columns if c != Columns.Item]]
        shown = small(item_data.select(*extra))
        return cls(is_u2i, requests, viewed.join(shown, Columns.Item, "left"), reco.join(named, id_col).join(shown, Columns.Item, "left"))

    @property
    def request_names(self) -> list[str]:
        return [r[0] for r in self.requests.select("request_name").orderBy("request_name").collect()]

    @property
    def model_names(self) -> list[str]:
        return [r[0] for r in self.reco.select(Columns.Model).distinct().orderBy(Columns.Model).collect()]

    def save(self, path: str, overwrite: bool = False) -> None:
        mode = "overwrite" if overwrite else "error"
        for name, t in (("requests", self.requests.withColumn("is_u2i", F.lit(self.is_u2i))), ("interactions", self.interactions), ("reco", self.reco)):
            t.write.mode(mode).csv(f"{path}/{name}", header=True)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ReportStorage:
        requests, interactions, reco = (spark.read.csv(f"{path}/{n}", header=True, inferSchema=True) for n in ("requests", "interactions", "reco"))
        first = requests.first()
        return cls(bool(first["is_u2i"]) if first else True, requests.drop("is_u2i"), interactions, reco)


def _by(column: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.orderBy(column)  # over the few drawn requests


class MetricsReport:
    """Checked metrics by model and fold, with metadata of models."""

    def __init__(self, data: DataFrame, metric_names: list[str], meta_names: list[str]):
        self.data, self.metric_names, self.meta_names = data, metric_names, meta_names

    @classmethod
    def construct(cls, models_metrics: DataFrame, models_metadata: DataFrame | None = None) -> MetricsReport:
        require(models_metrics.columns, [Columns.Model])
        keys = [c for c in (Columns.Model, Columns.Split) if c in models_metrics.columns]
        metrics = [c for c in models_metrics.columns if c not in keys]
        if not metrics:
            raise KeyError("There is no metric column")
        if not models_metrics.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("Each pair of model and fold must occur once")
        if Columns.Split in keys:
            folds = models_metrics.agg(F.countDistinct(Columns.Split)).first()[0]
            if not models_metrics.groupBy(Columns.Model).count().where(F.col("count") != folds).isEmpty():
                raise ValueError("Each model must have all folds")
        meta: list[str] = []
        data = models_metrics
        if models_metadata is not None:
            require(models_metadata.columns, [Columns.Model])
            meta = [c for c in models_metadata.columns if c != Columns.Model]
            if not models_metadata.groupBy(Columns.Model).count().where("count > 1").isEmpty():
                raise ValueError("Each model must occur once in the metadata")
            data = data.join(models_metadata.select(Columns.Model, *meta), Columns.Model, "left")
        return cls(data, metrics, meta)

    @property
    def model_names(self) -> list[str]:
        return [r[0] for r in self.data.select(Columns.Model).distinct().orderBy(Columns.Model).collect()]

    @property
    def fold_ids(self) -> list[int] | None:
        return [r[0] for r in self.data.select(Columns.Split).distinct().orderBy(Columns.Split).collect()] if Columns.Split in self.data.columns else None

    def fold(self, i: int) -> DataFrame:
        return self.data.where(F.col(Columns.Split) == i)

    def average(self) -> DataFrame:
        """Means over folds; metadata stays."""
        return self.data.groupBy(Columns.Model, *self.meta_names).agg(*[F.avg(m).alias(m) for m in self.metric_names])
