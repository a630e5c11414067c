"""tabsmith: profiling, preprocessing, model selection, scoring, explanation and
drift monitoring for Spark DataFrames."""

from tabsmith.plans.autotable import AutoTable

__all__ = ["AutoTable"]
