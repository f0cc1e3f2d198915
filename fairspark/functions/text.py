"""Helpers for messages: names of files, emphasis, values that must be there."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The escape codes of bold and of plain text on terminals.
BOLD, PLAIN = "\033[1m", "\033[0m"


def name_of(path: str) -> str:
    """A file's name up to its first dot, in capitals: how runs call a dataset."""
    return posixpath.basename(path).partition(".")[0].upper()


def bold(text: str) -> str:
    """The text in bold on terminals."""
    return f"{BOLD}{text}{PLAIN}"


def names_of(path: Column) -> Column:
    """``name_of`` of each row."""
    return F.upper(F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("."), F.lit(1)))


def bolds(text: Column) -> Column:
    """``bold`` of each row; null stays null."""
    return F.concat(F.lit(BOLD), text, F.lit(PLAIN))


def required(key: str, values: Mapping):
    """values[key]; ValueError with the key's name where it is missing."""
    if key not in values:
        raise ValueError(f"{key} is missing")
    return values[key]
