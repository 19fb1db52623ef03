"""Feature tables at scale: reshaping, feature joins, curves, distributions, masks, models."""

import sys

from pyspark import cloudpickle

from .functions import (
    Beta, NegativeBinomial, Normal, denormalise_name, normalise_name, rename_values, select_nested_fields,
)
from .operators import *  # noqa: F401,F403
from .operators import __all__ as _operators
from .sources import load_featuresets

__all__ = [
    "Beta", "NegativeBinomial", "Normal", "denormalise_name", "load_featuresets", "normalise_name",
    "rename_values", "select_nested_fields", *_operators,
]

# The few functions that run in Python workers travel with the plan, so executors need
# no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
