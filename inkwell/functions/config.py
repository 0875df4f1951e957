"""Values of a configuration by their types: what is no such value, or out of bounds, becomes the default.

The expressions read a value as JSON text, so that ``true`` is no number and
``1.0`` no whole one. ``merged`` lays a configuration over the defaults.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(text: Column, low: int, high: int, default: int) -> Column:
    value = F.when(text.rlike(r"^-?[0-9]+\z"), text.try_cast("bigint"))
    return F.coalesce(F.when(value.between(low, high), value), F.lit(default).cast("bigint"))


def number(text: Column, low: float, high: float, default: float) -> Column:
    value = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"), text.try_cast("double"))
    return F.coalesce(F.when(value.between(low, high), value), F.lit(float(default)))


def flag(text: Column, default: bool) -> Column:
    return F.when(text.isin("true", "false"), text == "true").otherwise(F.lit(default))


def one_of(text: Column, values: tuple[str, ...], default: str) -> Column:
    return F.when(text.isin(*values), text).otherwise(F.lit(default))


def _fits(value: Any, default: Any) -> bool:
    if isinstance(default, bool) or isinstance(value, bool):
        return isinstance(value, bool) and isinstance(default, bool)
    if isinstance(default, float):
        return isinstance(value, (int, float)) and math.isfinite(value)
    return default is None or isinstance(value, type(default))


def merged(defaults: dict[str, Any], given: Any, path: str = "") -> tuple[dict[str, Any], list[str]]:
    """``given`` over ``defaults``, section by section, and what was wrong in it; unknown names are kept."""
    if not isinstance(given, dict):
        return dict(defaults), [f"{path or 'configuration'} is no section"]
    out, wrong = {**given, **defaults}, []
    for name in defaults.keys() & given.keys():
        default, value, place = defaults[name], given[name], f"{path}.{name}".lstrip(".")
        if isinstance(default, dict):
            out[name], told = merged(default, value, place)
            wrong += told
        elif _fits(value, default):
            out[name] = value
        else:
            wrong.append(f"{place} is no {type(default).__name__}")
    return out, sorted(wrong)
