"""The metrics: parameters, what they need, and their value for one user as an expression over that user's row.

Rows are built once for all metrics of a family (see tidemark.plans.metrics), so a metric is only an expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import DebiasConfig, MetricAtK, count_to
from .distances import PairwiseDistanceCalculator


@dataclass(frozen=True)
class Debiasable(MetricAtK):
    debias_config: DebiasConfig | None = None


# Families by hit lists (columns hits, n_relevant; n_catalog where a catalog is given).


@dataclass(frozen=True)
class HitMetric(Debiasable):
    needs_catalog = False

    def value(self, n_catalog: int | None) -> Column:
        raise NotImplementedError

    def parts(self) -> tuple[Column, Column, Column]:
        """TP, FP, FN; false positives count up to k even where fewer items were recommended."""
        tp = count_to("hits", self.k).cast("double")
        return tp, F.lit(float(self.k)) - tp, F.col("n_relevant").cast("double") - tp


@dataclass(frozen=True)
class Precision(HitMetric):
    r_precision: bool = False

    def value(self, n_catalog: int | None) -> Column:
        tp, _, _ = self.parts()
        return tp / (F.least(F.lit(float(self.k)), F.col("n_relevant").cast("double")) if self.r_precision else F.lit(float(self.k)))


@dataclass(frozen=True)
class Recall(HitMetric):
    def value(self, n_catalog: int | None) -> Column:
        return self.parts()[0] / F.col("n_relevant")


@dataclass(frozen=True)
class F1Beta(HitMetric):
    beta: float = 1.0

    def value(self, n_catalog: int | None) -> Column:
        tp, _, _ = self.parts()
        p, r, b = tp / self.k, tp / F.col("n_relevant"), self.beta**2
        return F.when(tp > 0, (1 + b) * p * r / (b * p + r)).otherwise(0.0)


@dataclass(frozen=True)
class HitRate(HitMetric):
    def value(self, n_catalog: int | None) -> Column:
        return (self.parts()[0] > 0).cast("double")


@dataclass(frozen=True)
class Accuracy(HitMetric):
    inputs = ("interactions", "catalog")
    needs_catalog = True

    def value(self, n_catalog: int | None) -> Column:
        tp, _, fn = self.parts()
        return (tp + F.lit(float(n_catalog or 0)) - self.k - fn) / F.lit(float(n_catalog or 0))


@dataclass(frozen=True)
class MCC(HitMetric):
    inputs = ("interactions", "catalog")
    needs_catalog = True

    def value(self, n_catalog: int | None) -> Column:
        tp, fp, fn = self.parts()
        tn = F.lit(float(n_catalog or 0)) - self.k - fn
        below = F.sqrt(F.greatest((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn), F.lit(0.0)))
        return F.when(below != 0, (tp * tn - fp * fn) / below).otherwise(0.0)


@dataclass(frozen=True)
class MAP(HitMetric):
    """Repeated test rows raise the running count of hits, but a rank is one term."""

    divide_by_k: bool = False

    def value(self, n_catalog: int | None) -> Column:
        total = F.expr(f"aggregate(array_distinct(filter(hits, x -> x <= {self.k})), 0D, (s, r) -> s + size(filter(hits, y -> y <= r)) / r)")
        return total / (F.lit(float(self.k)) if self.divide_by_k else F.col("n_relevant"))


@dataclass(frozen=True)
class NDCG(HitMetric):
    log_base: int = 2
    divide_by_achievable: bool = False

    def gain(self, rank: str) -> str:
        return f"{math.log(self.log_base)!r}D / ln({rank} + 1)"

    def value(self, n_catalog: int | None) -> Column:
        dcg = F.expr(f"aggregate(filter(hits, x -> x <= {self.k}), 0D, (s, r) -> s + {self.gain('r')})")
        best = [math.log(self.log_base) / math.log(r + 1) for r in range(1, self.k + 1)]
        if not self.divide_by_achievable:
            return dcg / sum(best)
        sums = F.array(*[F.lit(sum(best[: i + 1])) for i in range(self.k)])
        return dcg / F.element_at(sums, F.least(F.lit(self.k), F.col("n_relevant")).cast("int"))


@dataclass(frozen=True)
class MRR(HitMetric):
    def value(self, n_catalog: int | None) -> Column:
        return F.coalesce(1.0 / F.expr(f"array_min(filter(hits, x -> x <= {self.k}))"), F.lit(0.0))


# Family by AUC lists (columns positives, n_pos, max_rank).


@dataclass(frozen=True)
class AUCMetric(Debiasable):
    """insufficient_handling: what becomes of users with fewer than k false positives and a test item out of their list."""

    insufficient_handling: str = "ignore"

    def insufficient(self) -> Column:
        hits = F.size("positives")
        return (F.col("max_rank") - hits < self.k) & (hits < F.col("n_pos"))

    def value(self) -> Column:
        raise NotImplementedError

    def _sum(self, more: str) -> Column:
        # The i-th hit (from 0) at rank r has r - 1 - i false positives before it.
        return F.expr(f"aggregate(filter(transform(positives, (r, i) -> struct(r - 1 - i as fp, i + 1 as tp)), x -> x.fp < {self.k}{more}), 0D, (s, x) -> s + {self.k} - x.fp)")


@dataclass(frozen=True)
class PartialAUC(AUCMetric):
    def value(self) -> Column:
        return self._sum("") / (self.k * F.col("n_pos"))


@dataclass(frozen=True)
class PAP(AUCMetric):
    def value(self) -> Column:
        return self._sum(f" and x.tp <= {self.k}") / (self.k * F.least(F.col("n_pos"), F.lit(self.k)))


# Families by recommendations with the statistics of their items.


@dataclass(frozen=True)
class MeanInvUserFreq(MetricAtK):
    inputs = ("prev_interactions",)


@dataclass(frozen=True)
class AvgRecPopularity(MetricAtK):
    inputs = ("prev_interactions",)
    normalize: bool = False


@dataclass(frozen=True)
class Serendipity(MetricAtK):
    inputs = ("interactions", "prev_interactions", "catalog")


@dataclass(frozen=True)
class IntraListDiversity(MetricAtK):
    inputs = ()
    distance_calculator: PairwiseDistanceCalculator | None = None


@dataclass(frozen=True)
class CatalogCoverage(MetricAtK):
    inputs = ("catalog",)
    normalize: bool = False


@dataclass(frozen=True)
class Intersection(MetricAtK):
    inputs = ("ref_reco",)
    ref_k: int | None = None


@dataclass(frozen=True)
class SufficientReco(MetricAtK):
    inputs = ()
    deep: bool = False


@dataclass(frozen=True)
class UnrepeatedReco(MetricAtK):
    inputs = ()
    deep: bool = False


@dataclass(frozen=True)
class CoveredUsers(MetricAtK):
    pass
