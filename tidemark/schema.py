"""Column vocabulary of interaction, recommendation and feature tables."""

from __future__ import annotations


class Columns:
    """Names that every operator agrees on."""

    User = "user_id"
    Item = "item_id"
    TargetItem = "target_item_id"
    Weight = "weight"
    Datetime = "datetime"
    Rank = "rank"
    Score = "score"
    Model = "model"
    Target = "target"
    Split = "i_split"
    UserItem = [User, Item]
    Interactions = [User, Item, Weight, Datetime]
    Recommendations = [User, Item, Score, Rank]
    RecommendationsI2I = [TargetItem, Item, Score, Rank]
    #: Orders rows that tie in time; hidden from results.
    Row = "_row_id"


def require(columns: list[str], needed: list[str]) -> None:
    missing = [c for c in needed if c not in columns]
    if missing:
        raise KeyError(f"Missed columns {set(missing)}")


class NotFittedError(Exception):
    """A model was asked to recommend before fit()."""

    def __init__(self, name: str):
        super().__init__(f"{name} isn't fitted, call method `fit` first.")


class NotFittedForStageError(Exception):
    """A candidate generator was asked for a stage that it isn't fitted for."""

    def __init__(self, name: str, stage: str):
        super().__init__(f"{name} isn't fitted for {stage}, refit it with the dataset of that stage.")


class UnknownIdError(KeyError):
    """A feature row names an id that the id map lacks."""


class AbsentIdError(ValueError):
    """An id of the map has no feature row."""
