"""Recommendation models."""

from .base import ModelBase, load_model, model_from_config, model_from_params
from .factors import ALSModel, PureSVDModel
from .neighbours import EASEModel, ItemKNNModel
from .popular import MixingStrategy, Popularity, PopularInCategoryModel, PopularModel, RandomModel, RatioStrategy
from .sequential import BERT4RecModel, HSTUModel, LiGRModel, SASRecModel
from .sgd import BPRModel, DSSMModel, LightFMModel
from .vector import VectorModel

__all__ = [
    "ALSModel", "BERT4RecModel", "BPRModel", "DSSMModel", "EASEModel", "HSTUModel", "ItemKNNModel", "LiGRModel", "LightFMModel", "MixingStrategy", "ModelBase", "Popularity", "PopularInCategoryModel", "PopularModel", "PureSVDModel",
    "RandomModel", "RatioStrategy", "SASRecModel", "VectorModel", "load_model", "model_from_config", "model_from_params",
]
