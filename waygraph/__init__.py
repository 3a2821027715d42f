"""Waygraph: route-graph analytics and data-quality operators on Spark DataFrames."""
