"""Benchmarking of predictive models on tables, written as Spark jobs."""

__version__ = "0.1.0"
