"""Validators and recognisers that users add: by registration in code only, nothing is found or loaded by itself.

A plan names those it wants; a name that is not registered ends the plan, so a missing check never passes silently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A validator gives a Column of an array of error texts, from the columns of the record schema.
_validators: dict[str, Callable[[], Column]] = {}
#: A recogniser is an entity's name and a regular expression.
_recognisers: dict[str, tuple[str, str]] = {}


class PluginError(RuntimeError):
    """A plugin is not known or can't be made."""


def register_validator(name: str, make: Callable[[], Column]) -> None:
    _validators[name] = make


def register_recogniser(name: str, entity: str, pattern: str) -> None:
    _recognisers[name] = (entity, pattern)


def validator_errors(names: tuple[str, ...]) -> Column:
    """The errors of all named validators, one after the other; a validator whose errors are null for a row fails the job."""
    found = F.array().cast("array<string>")
    for name in names:
        if name not in _validators:
            raise PluginError(f"validator {name!r} is not registered")
        try:
            errors = _validators[name]()
        except Exception as e:
            raise PluginError(f"validator {name!r} failed: {e}") from e
        found = F.concat(found, F.coalesce(errors.cast("array<string>"), F.raise_error(F.lit(f"validator {name!r} gave no list"))))
    return found


def recogniser_patterns(names: tuple[str, ...]) -> dict[str, str]:
    out = {}
    for name in names:
        if name not in _recognisers:
            raise PluginError(f"recogniser {name!r} is not registered")
        entity, pattern = _recognisers[name]
        out[entity] = pattern
    return out
