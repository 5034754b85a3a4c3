"""Panel forecasting, lead scoring and series monitoring on Spark DataFrames."""

__version__ = "0.1.0"
