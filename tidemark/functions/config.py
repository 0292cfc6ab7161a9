"""Configuration checks that report all errors at once."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F


def errors(config: dict[str, Any], shape: dict[str, type]) -> list[tuple[str, str]]:
    """(key, error) for keys that are missing, unknown or of another kind; numbers must be positive."""
    found = [(k, "is unknown") for k in sorted(config.keys() - shape.keys())]
    for key, kind in sorted(shape.items()):
        if key not in config:
            found.append((key, "is missing"))
        elif not isinstance(config[key], kind):
            found.append((key, f"is not a {kind.__name__}"))
        elif kind is int and config[key] <= 0:
            found.append((key, "is not positive"))
    return sorted(found)


def listed(text: Column, numbers: list[str]) -> Column:
    """array<struct<key, error>>, by key: all that is wrong with a configuration, a JSON object whose keys are to be these positive whole numbers.

    Text that is no object lacks all keys.
    """
    held = F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
    error = lambda k, e: F.struct(k.alias("key"), F.lit(e).alias("error"))
    shape = F.array(*map(F.lit, numbers))
    unknown = F.transform(F.array_except(F.map_keys(held), shape), lambda k: error(k, "is unknown"))

    def wrong(k: Column) -> Column:
        v = held[k]
        whole = v.rlike(r"^-?\d+$")
        return F.when(v.isNull(), error(k, "is missing")).when(~whole, error(k, "is not an int")).when(F.startswith(v, F.lit("-")) | v.rlike("^0+$"), error(k, "is not positive"))

    return F.array_sort(F.concat(unknown, F.array_compact(F.transform(shape, wrong))))
