"""mixloom: mixed-effects modelling and relational summaries on Spark DataFrames."""

__version__ = "0.1.0"
