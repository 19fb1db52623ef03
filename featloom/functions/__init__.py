from .names import decode_names, denormalise_name, encode_names, named_col, normalise_name, quoted
from .negbin import Beta, NegativeBinomial, Normal
from .nested import rename_values, select_nested_fields

__all__ = [
    "Beta", "NegativeBinomial", "Normal", "decode_names", "denormalise_name", "encode_names",
    "named_col", "normalise_name", "quoted", "rename_values", "select_nested_fields",
]
