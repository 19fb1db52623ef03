"""Selecting nested fields and recoding values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def field_paths(spec) -> list[tuple[str, ...]]:
    """Every root-to-leaf path of a nested column spec, in the order written.

    A string is a leaf, a mapping descends by its keys, any other iterable fans out.
    """
    if isinstance(spec, str):
        return [(spec,)]
    if isinstance(spec, Mapping):
        return [(key, *rest) for key, sub in spec.items() for rest in field_paths(sub)]
    if isinstance(spec, Iterable):
        return [path for sub in spec for path in field_paths(sub)]
    raise ValueError(f"a column spec is a string, mapping or iterable, not {type(spec).__name__}")


def select_nested_fields(fields, sep: str = ".") -> list[tuple[str, Column]]:
    """``(alias, column)`` for every leaf of ``fields``.

    The first step of a path is a column reference, where a dot means nesting.
    The later steps are literal names of struct fields or map keys, so
    ``{"price": {"net": ["per.unit"]}}`` gives ``price.net.per.unit``.
    """
    out = []
    for root, *steps in field_paths(fields):
        column = F.col(root)
        for step in steps:
            column = column[step]
        alias = sep.join((root, *steps))
        out.append((alias, column.alias(alias)))
    return out


def rename_values(col: Column | str, map_dict: Mapping, default=None) -> Column:
    """Look every value up in ``map_dict``; a miss gives null, or ``default``.

    For dictionaries beyond a few hundred entries use
    :func:`featloom.operators.reshape.rename_column_values`, which joins instead.
    """
    column = F.col(col) if isinstance(col, str) else col
    fallback = default if isinstance(default, Column) else F.lit(default)
    if not map_dict:
        return fallback
    pairs = [F.lit(item) for entry in map_dict.items() for item in entry]
    found = F.create_map(*pairs)[column]
    return found if default is None else F.coalesce(found, fallback)
