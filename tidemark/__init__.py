"""Positioning, macro and seasonality analytics on Spark DataFrames."""
