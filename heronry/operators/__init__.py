"""Retrieval, graph, event and rule operators: DataFrames in, DataFrames out."""
