"""Extracting feature sets and joining them on full or partial index keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import named_col
from ..functions.nested import select_nested_fields
from ..plans.skew import DEFAULT_POLICY, HotKeys, SkewPolicy, hot_keys_of, split_join, stored_if_derived, with_all_values

# Accepted spellings of each join type.
JOIN_TYPES = {
    "inner": "inner",
    "left": "left", "leftouter": "left", "left_outer": "left",
    "right": "right", "rightouter": "right", "right_outer": "right",
    "outer": "full", "full": "full", "fullouter": "full", "full_outer": "full", "outer_coalesce": "full",
    "semi": "left_semi", "leftsemi": "left_semi", "left_semi": "left_semi",
    "anti": "left_anti", "leftanti": "left_anti", "left_anti": "left_anti",
}


def transform_featureset(fset_df: DataFrame, fset_name: str, variables, index_cols: Sequence[str]) -> DataFrame:
    """The index columns that ``fset_df`` has, and its selected features, flattened.

    Feature columns are called ``feature.{fset_name}@{alias}``.
    """
    index = [c for c in index_cols if c in fset_df.columns]
    return fset_df.select(
        *map(named_col, index),
        *(column.alias(f"feature.{fset_name}@{alias}") for alias, column in select_nested_fields(variables)))


@dataclass
class _Part:
    """One input frame, and whether its caller promised that its keys do not repeat."""

    df: DataFrame
    unique: bool = False

    def can_repeat(self, on: list[str], index_cols: list[str]) -> bool:
        held = [c for c in index_cols if c in self.df.columns]
        return set(on) <= set(held) and not (self.unique and set(on) == set(held))


class _Joined:
    """A frame on its way through the joins, with the index columns it carries.

    ``parts`` are inputs all of whose keys are still in the frame. Hot keys are looked up
    in those: they are scans and projections, while the joined frame would have to be
    recomputed.
    """

    def __init__(self, name: str, df: DataFrame, keys: list[str], parts: list[_Part]):
        self.name, self.df, self.keys, self.parts = name, df, keys, parts
        self.has_gaps = False  # rows of some parts have nulls in keys they lack

    def searched(self, on: list[str], index_cols: list[str]) -> list[_Part]:
        """The parts in which keys of a join on ``on`` may repeat."""
        return [part for part in self.parts if part.can_repeat(on, index_cols)]

    def hot(self, on: list[str], index_cols: list[str], seen: dict) -> HotKeys:
        return reduce(HotKeys.merge, (seen[id(part), tuple(on)] for part in self.searched(on, index_cols)), HotKeys())

    def join(self, other: "_Joined", how: str, index_cols: list[str], policy, seen: dict, spine: bool = False) -> "_Joined":
        on = [c for c in index_cols if c in self.keys and c in other.keys]
        if not on:
            raise ValueError(f"{self.name} and {other.name} share none of the index columns {index_cols}")
        filtering = how in ("left_semi", "left_anti")
        # one job for all parts of both sides that were not searched for these keys before
        new = [part for side in ([self] if filtering else [self, other]) for part in side.searched(on, index_cols)
               if (id(part), tuple(on)) not in seen]
        seen.update(((id(part), tuple(on)), hot) for part, hot in zip(new, hot_keys_of([part.df for part in new], on, policy)))
        hot_left = self.hot(on, index_cols, seen)
        hot_right = HotKeys() if filtering else other.hot(on, index_cols, seen)
        gaps = self.has_gaps or other.has_gaps
        if spine and how == "full":
            df = onto_spine([self.df, other.df], on, [hot_left, hot_right])
        else:
            df = split_join(self.df, other.df, on, how, hot_left, hot_right,
                            spread_nulls=policy is not None and gaps and how != "inner")
        out = _Joined(f"{self.name} + {other.name}", df, self.keys, self.parts)
        out.has_gaps = self.has_gaps
        if not filtering:
            out.keys = [c for c in index_cols if c in self.keys or c in other.keys]
            # a right join may lose keys of the left side
            out.parts = other.parts if how == "right" else self.parts + other.parts
            out.has_gaps = gaps or set(self.keys) != set(other.keys)
        return out


def join_featuresets(
    dataframes: Mapping[str, DataFrame],
    variables: Mapping[str, object],
    index_cols: Sequence[str],
    fill_values: Mapping[str, object] | None = None,
    join: str = "outer",
    initial_df: DataFrame | None = None,
    broadcast_columns: Mapping[str, DataFrame] | str | None = None,
    ignore_missing_columns: bool = True,
    *,
    unique_keys: bool = False,
    spine: bool = False,
    skew: SkewPolicy | None = DEFAULT_POLICY,
) -> DataFrame:
    """Extract features from many tables and join them to one.

    Sets that carry the same index columns are joined first, by full outer joins in the
    order given. The groups are then joined in first-seen order on whatever index columns
    both sides have: by full outer joins, or onto ``initial_df`` with join type ``join``.

    :param variables: per set, the nested spec of its features
    :param fill_values: per column, the value that replaces null (and NaN)
    :param broadcast_columns: per index column, a frame of the values over which the groups
        that lack this column are repeated; ``"infer"`` takes the values found in all sets
    :param ignore_missing_columns: drop index columns found nowhere, instead of raising
    :param unique_keys: the caller promises that no set repeats a key. Sets with the same
        index columns then meet in a single shuffle; a broken promise fails the query.
    :param spine: make full outer joins as left joins onto the distinct keys of all sides. Conditions on the
        keys of the result then reach every side's scan, and *k* sets with the same index columns take *k* + 1 exchanges
        instead of 2 *k* - 2; but keys are read once more. ``unique_keys`` takes precedence where it applies.
    :param skew: when to look for hot keys in the inputs (a job over their key columns); ``None`` never looks
    """
    how = JOIN_TYPES.get(join)
    if how is None:
        raise ValueError(f"unsupported join type {join!r}; use one of {sorted(JOIN_TYPES)}")
    if not dataframes and initial_df is None:
        raise ValueError("there is nothing to join")

    # dict order is the join order
    groups: dict[tuple[str, ...], list[tuple[str, DataFrame]]] = {}
    for name, frame in dataframes.items():
        keys = tuple(c for c in index_cols if c in frame.columns)
        groups.setdefault(keys, []).append(
            (name, transform_featureset(frame, name, variables[name], index_cols)))

    carriers = [set(keys) for keys in groups]
    if initial_df is not None:
        carriers.append({c for c in index_cols if c in initial_df.columns})
    found = set().union(*carriers)
    missing = [c for c in index_cols if c not in found]
    if missing and not ignore_missing_columns:
        raise ValueError(f"index columns found in no table: {missing}")
    index_cols = [c for c in index_cols if c in found]

    spread_values = _broadcast_values(broadcast_columns, groups, index_cols)
    seen: dict = {}
    sides = []
    held = [[c for c in index_cols if c in keys or c in spread_values] for keys in groups]
    if initial_df is not None:
        held.insert(0, [c for c in index_cols if c in initial_df.columns])
    searched = _searched_keys(held, index_cols, how)

    def stored(frame: DataFrame, key_sets: list[list[str]], unique: bool) -> DataFrame:
        own = [c for c in index_cols if c in frame.columns]
        for on in ([c for c in keys if c in own] for keys in key_sets):
            if on and _Part(frame, unique).can_repeat(on, index_cols):
                frame = stored_if_derived(frame, on, skew)
        return frame

    for place, (keys, members) in enumerate(groups.items(), start=initial_df is not None):
        lacking = [c for c in index_cols if c not in keys and c in spread_values]
        if not keys and (len(members) > 1 or not lacking):
            raise ValueError(f"no index column in {[name for name, _ in members]}")
        inner = [list(keys)] if len(members) > 1 and not unique_keys else []
        members = [(name, stored(frame, inner + searched[place], unique_keys)) for name, frame in members]
        side = _join_group(list(keys), members, unique_keys, spine, skew, seen)
        for column in lacking:
            values = spread_values[column]
            side.parts = [_Part(with_all_values(part.df.select(*map(named_col, side.keys)), values), part.unique)
                          for part in side.parts]
            side.df = with_all_values(side.df, values)
            side.keys = [c for c in index_cols if c in side.keys or c == column]
        sides.append(side)

    if initial_df is not None:
        initial_df = stored(initial_df, searched[0], False)
        sides.insert(0, _Joined("the initial table", initial_df, held[0], [_Part(initial_df)]))
    full = sides[0]
    for side in sides[1:]:
        full = full.join(side, how, index_cols, skew, seen, spine)

    # index columns as given, then the rest in join order
    index = [c for c in index_cols if c in full.df.columns]
    rest = [c for c in full.df.columns if c not in index]
    fills = fill_values or {}
    unknown = [c for c in fills if c not in full.df.columns]
    if unknown:
        raise ValueError(f"fill_values names columns that are not in the result: {unknown}")
    types = {f.name: f.dataType for f in full.df.schema.fields}
    return full.df.select(*(
        _filled(c, types[c], fills[c]).alias(c) if c in fills else named_col(c) for c in index + rest))


def _searched_keys(sides: list[list[str]], index_cols: list[str], how: str) -> list[list[list[str]]]:
    """For each side, in join order, the key sets of the joins that its rows take part in and whose hot keys are searched."""
    out: list[list[list[str]]] = [[] for _ in sides]
    joined = sides[0] if sides else []
    for k, keys in enumerate(sides[1:], start=1):
        on = [c for c in index_cols if c in joined and c in keys]
        filtering = how in ("left_semi", "left_anti")
        for side in out[:k] + ([] if filtering else [out[k]]):
            side.append(on)
        joined = joined if filtering else [c for c in index_cols if c in joined or c in keys]
    return out


def _filled(name: str, dtype: T.DataType, value) -> Column:
    column = named_col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        column = F.nanvl(column, F.lit(None).cast(dtype))
    return F.coalesce(column, F.lit(value).cast(dtype))


def _broadcast_values(broadcast_columns, groups, index_cols) -> Mapping[str, DataFrame]:
    if broadcast_columns is None:
        return {}
    if broadcast_columns != "infer":
        return broadcast_columns
    values = {}
    for column in index_cols:
        holders = [frame.select(named_col(column)) for keys, members in groups.items()
                   if column in keys for _, frame in members]
        if holders and any(column not in keys for keys in groups):
            values[column] = reduce(DataFrame.unionByName, holders).distinct()
    return values


def onto_spine(frames: Sequence[DataFrame], on: Sequence[str], hot: Sequence[HotKeys] | None = None) -> DataFrame:
    """Full outer join of all frames on the same keys: left joins onto the distinct keys of all.

    Rows with a null in the key match nothing; they are appended as they are. Hot keys of the frames are dealt out to parts.
    """
    hot = hot or [HotKeys() for _ in frames]
    null_key = reduce(lambda a, b: a | b, (named_col(c).isNull() for c in on))
    whole = [frame.where(~null_key) for frame in frames]
    full = reduce(DataFrame.union, (frame.select(*map(named_col, on)) for frame in whole)).distinct()
    known = HotKeys()
    for frame, keys in zip(whole, hot):
        keys = HotKeys(keys.table)
        full = split_join(full, frame, on, "left", known, keys)
        known = known.merge(keys)
    loose = [frame.where(null_key) for frame in frames if any(frame.schema[c].nullable for c in on)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), loose, full)


def _join_group(keys: list[str], members: list[tuple[str, DataFrame]], unique_keys: bool, spine: bool,
                skew: SkewPolicy | None, seen: dict) -> _Joined:
    sides = [_Joined(name, frame, keys, [_Part(frame, unique_keys)]) for name, frame in members]
    if len(sides) == 1:
        return sides[0]
    if unique_keys:
        return _Joined(" + ".join(name for name, _ in members), _merge_unique(keys, members), keys,
                       [part for side in sides for part in side.parts])
    if spine:
        frames = [frame for _, frame in members]
        found = hot_keys_of(frames, keys, skew)
        parts = [part for side in sides for part in side.parts]
        seen.update(((id(part), tuple(keys)), hot) for part, hot in zip(parts, found))
        return _Joined(" + ".join(name for name, _ in members), onto_spine(frames, keys, found), keys, parts)
    full = sides[0]
    for side in sides[1:]:
        full = full.join(side, "full", keys, skew, seen)
    return full


def _merge_unique(keys: list[str], members: list[tuple[str, DataFrame]]) -> DataFrame:
    """Full outer join of sets without repeated keys, in one shuffle for all of them.

    All rows with a whole key are stacked, each set's features packed in a struct of its own, and grouped
    by key. Rows with a null in the key match nothing; they pass by the grouping, each set's as they are.
    """
    features = [[c for c in frame.columns if c not in keys] for _, frame in members]
    packs = [f"__set{i}" for i in range(len(members))]
    stacked = [frame.select(*map(named_col, keys), F.struct(F.lit(1).alias("__row"), *map(named_col, names)).alias(pack))
               for (_, frame), names, pack in zip(members, features, packs)]
    loose = []
    for number, ((_, frame), pack) in enumerate(zip(members, packs)):
        nullable = [named_col(k).isNull() for k in keys if frame.schema[k].nullable]
        if nullable:
            null_key = reduce(lambda a, b: a | b, nullable)
            loose.append(stacked[number].where(null_key))
            stacked[number] = stacked[number].where(~null_key)

    def checked(pack: str) -> Column:
        repeated = F.count(pack) > 1
        return F.when(repeated, F.raise_error(F.lit("unique_keys=True, but a feature set repeats a key"))) \
            .otherwise(F.any_value(pack, ignoreNulls=True)).alias(pack)

    def together(frames: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    merged = together(stacked).groupBy(*map(named_col, keys)).agg(*map(checked, packs))
    return together([merged, *loose]).select(
        *map(named_col, keys),
        *(F.col(pack).getField(name).alias(name) for pack, names in zip(packs, features) for name in names))
