"""Operators over DataFrames and topologies."""
