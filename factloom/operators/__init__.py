"""Operators: Column expressions. from DataFrames to DataFrames."""
