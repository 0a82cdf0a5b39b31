"""Boolean relations and reachability."""

from .propagate import Timeout, propagate, semi_naive, squaring
from .relation import BoolMatrix

__all__ = ["BoolMatrix", "Timeout", "propagate", "semi_naive", "squaring"]
