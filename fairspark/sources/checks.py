"""Guards of arguments; each raises ValueError and says what is wrong."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Mapping

from fairspark.sources.prepare import Dataset


def check_dataset(dataset: Dataset) -> None:
    """A dataset has its row_id, its target, and a code column for each protected attribute."""
    if not isinstance(dataset, Dataset):
        raise ValueError(f"no dataset: {type(dataset).__name__}")
    wanted = ["row_id", "target", *(f"protected_{p}" for p in dataset.protected)]
    if gone := [c for c in wanted if c not in dataset.data.columns]:
        raise ValueError(f"the dataset has no {gone}")


def check_protected(dataset: Dataset, attribute: str) -> None:
    """The attribute is protected and has labels."""
    dataset.labels(attribute)


def check_keys(values: Mapping, keys: Iterable[str]) -> None:
    if gone := [k for k in keys if k not in values]:
        raise ValueError(f"keys are missing: {gone}")


def check_callable(function: object) -> None:
    if not callable(function):
        raise ValueError(f"not a function: {function!r}")


def check_parameters(function: Callable, parameters: Iterable[str]) -> None:
    """The function takes parameters of these names, or any at all."""
    check_callable(function)
    known = inspect.signature(function).parameters
    if any(p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD) for p in known.values()):
        return
    if gone := [p for p in parameters if p not in known]:
        raise ValueError(f"{getattr(function, '__name__', function)} has no {gone}")
