"""Cohort analytics as lazy Spark plans: prepare, split, evaluate, match."""

__version__ = "0.1.0"
