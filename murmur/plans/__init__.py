from murmur.plans import modelling, reacting, studying, tables, texts  # noqa: F401  (registers the queries)
from murmur.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
