"""Operators for training-data pipelines."""

from .queries import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
