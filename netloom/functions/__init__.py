"""Scalar functions as Column expressions."""

from .scalar import cluster_index, epsilon_schedule, exponential_decay, inverse, power_law

__all__ = ["cluster_index", "epsilon_schedule", "exponential_decay", "inverse", "power_law"]
