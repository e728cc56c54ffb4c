"""poslake — intraday portfolio positions on Spark.

Every operator is a function from DataFrames to a DataFrame; nothing is
collected except the small column map and the compare summary.
"""

__version__ = "0.1.0"
