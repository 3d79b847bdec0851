"""Matrices and feature tables as Spark DataFrames: projections, reductions, search, shape, sets, linear algebra and models."""
