"""Masked selection from N-dimensional labelled arrays held as long tables.

An array is a table with one row per cell: a column per dimension and a value column.
A mask is such a table with a boolean value. Cells are selected by joins on dimensions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import named_col
from ..plans.ordered import with_position
from ..plans.skew import DEFAULT_POLICY, SkewPolicy, find_hot_keys, split_join, with_all_values


def dense_array(df: DataFrame, array_col: str, row_dims: Sequence[str], dim: str, value: str = "value") -> DataFrame:
    """An array column as cells: ``row_dims, dim, value`` with positions 0..n-1 in ``dim``."""
    return df.select(*map(named_col, row_dims), F.posexplode(named_col(array_col)).alias(dim, value))


def core_dim_labels_from_mask(mask: DataFrame, core_dims: Sequence[str], new_dim_name: str | None = None,
                              mask_col: str = "mask") -> DataFrame:
    """The labels of all true cells, one column per dimension of the mask.

    With ``new_dim_name`` the cells are also numbered 0..n-1 in row-major order of
    ``core_dims``; that runs a job and stores the labels.
    """
    selected = mask.where(named_col(mask_col)).select(*map(named_col, core_dims))
    if new_dim_name is None:
        return selected
    return with_position(selected, [named_col(d) for d in core_dims], new_dim_name)


def subset_variable(variable: DataFrame, core_dim_labels: DataFrame, core_dims: Sequence[str], value: str = "value",
                    dims: Sequence[str] | None = None, dense: bool = True,
                    skew: SkewPolicy | None = DEFAULT_POLICY) -> DataFrame:
    """The values of ``variable`` at the selected cells.

    Mask dimensions that the variable lacks repeat its values; dimensions of its own are
    kept. Selected cells that it does not hold give null -- for every label of its own
    dimensions if ``dense``. For a variable known to be complete, ``dense=False`` gives the
    same rows from a smaller join.

    :param dims: the variable's dimensions; all columns but ``value`` by default
    """
    dims = [c for c in variable.columns if c != value] if dims is None else list(dims)
    shared = [d for d in core_dims if d in dims]
    extra = [d for d in dims if d not in core_dims]
    if not shared:
        raise ValueError(f"the variable has none of the mask's dimensions {list(core_dims)}")
    labels, on = core_dim_labels, shared
    if extra and dense:
        for dim in extra:
            labels = with_all_values(labels, variable.select(named_col(dim)).distinct())
        on = shared + extra
    cells = variable.select(*map(named_col, dims), named_col(value))
    # a cell occurs once, so keys can repeat only where they leave a dimension out
    hot_labels = None if set(core_dims) <= set(on) else find_hot_keys(labels, on, skew)
    hot_cells = None if set(dims) <= set(on) else find_hot_keys(cells, on, skew)
    joined = split_join(labels, cells, on, "left", hot_labels, hot_cells)
    return joined.select(*map(named_col, core_dim_labels.columns), *map(named_col, extra), named_col(value))


@dataclass
class MaskedDataset:
    """Masked variables by name, and the persisted labels they share."""

    variables: dict[str, DataFrame]
    labels: DataFrame

    def __getitem__(self, name: str) -> DataFrame:
        return self.variables[name]

    def unpersist(self) -> None:
        self.labels.unpersist()


def dataset_masked_indexing(dataset: Mapping[str, DataFrame], mask: DataFrame, core_dims: Sequence[str],
                            new_dim_name: str | None = None, value: str = "value", mask_col: str = "mask",
                            persist: bool = True, dense: bool = True,
                            skew: SkewPolicy | None = DEFAULT_POLICY) -> MaskedDataset:
    """:func:`subset_variable` for every variable that shares a dimension with the mask.

    The others pass unchanged. The labels are computed once: numbered labels are stored
    anyway, others are persisted.
    """
    labels = core_dim_labels_from_mask(mask, core_dims, new_dim_name, mask_col)
    if persist and new_dim_name is None:
        labels = labels.persist(StorageLevel.MEMORY_AND_DISK)
    return MaskedDataset({
        name: subset_variable(variable, labels, core_dims, value, dense=dense, skew=skew)
        if set(core_dims) & (set(variable.columns) - {value}) else variable
        for name, variable in dataset.items()}, labels)
