"""Quality metrics of recommendation tables."""

from .base import DebiasConfig, MetricAtK, debias_interactions, merge_reco, outer_merge_reco
from .distances import PairwiseHammingDistanceCalculator, SparsePairwiseHammingDistanceCalculator
from .kinds import (
    MAP, MCC, MRR, NDCG, PAP, Accuracy, AvgRecPopularity, CatalogCoverage, CoveredUsers, F1Beta, HitRate, Intersection, IntraListDiversity, MeanInvUserFreq, PartialAUC, Precision, Recall,
    Serendipity, SufficientReco, UnrepeatedReco,
)

__all__ = [
    "MAP", "MCC", "MRR", "NDCG", "PAP", "Accuracy", "AvgRecPopularity", "CatalogCoverage", "CoveredUsers", "DebiasConfig", "F1Beta", "HitRate", "Intersection", "IntraListDiversity",
    "MeanInvUserFreq", "MetricAtK", "PairwiseHammingDistanceCalculator", "PartialAUC", "Precision", "Recall", "Serendipity", "SparsePairwiseHammingDistanceCalculator", "SufficientReco",
    "UnrepeatedReco", "debias_interactions", "merge_reco", "outer_merge_reco",
]
