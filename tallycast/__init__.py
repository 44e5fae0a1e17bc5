"""Demand analytics over many item time series, expressed as Spark plans."""

__version__ = "0.1.0"
