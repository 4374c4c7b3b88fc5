"""Relational, graph, history and training-data operators over DataFrames."""
