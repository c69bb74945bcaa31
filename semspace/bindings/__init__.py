from . import compose, features, text, vectors  # noqa: F401  (they register their queries)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
