from .parquet import load_featuresets, open_featuresets

__all__ = ["load_featuresets", "open_featuresets"]
