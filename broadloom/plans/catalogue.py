"""All registered queries."""

from broadloom.plans import q_model, q_profile, q_relational, q_split  # noqa: F401
from broadloom.plans.registry import CATALOGUE

__all__ = ["CATALOGUE"]
