"""Equity factor scoring, portfolio construction and backtesting on Spark.

Every public transform has the shape ``(DataFrame, params, by=[...]) -> DataFrame``.
Nothing inside the library runs an action: plans stay lazy until a sink writes.
"""

__version__ = "0.1.0"
