"""User settings as JSON documents: reading by dotted path in the engine, changes on the driver."""

from __future__ import annotations

import copy
import posixpath
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def setting(document: Column, path: str) -> Column:
    """Value at a dotted path as a string; null where it is absent."""
    return F.get_json_object(document, "$." + path)


def changed(settings: dict, path: str, value: Any) -> dict:
    """Settings with a value at a dotted path; groups on the way are made."""
    out = copy.deepcopy(settings)
    at = out
    *groups, name = path.split(".")
    for g in groups:
        if not isinstance(at.get(g), dict):
            at[g] = {}
        at = at[g]
    at[name] = value
    return out


def reset(settings: dict, path: str) -> dict:
    """Settings without what is at a dotted path."""
    out = copy.deepcopy(settings)
    at = out
    *groups, name = path.split(".")
    for g in groups:
        at = at.get(g)
        if not isinstance(at, dict):
            return out
    at.pop(name, None)
    return out


def coerced(current: Any, value: Any) -> Any:
    """A value in the type of the current one; the current one where that fails."""
    if current is None:
        return value
    try:
        return type(current)(value)
    except (TypeError, ValueError):
        return current


def inside(folder: str, path: str) -> bool:
    """Whether a path, once resolved, lies in the folder."""
    base = posixpath.normpath(folder)
    return posixpath.normpath(posixpath.join(base, path)).startswith(base.rstrip("/") + "/")
