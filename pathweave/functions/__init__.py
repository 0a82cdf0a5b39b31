"""Column-level helpers."""

from .bitmaps import cardinality, product, to_bitmaps, to_pairs, union

__all__ = ["cardinality", "product", "to_bitmaps", "to_pairs", "union"]
