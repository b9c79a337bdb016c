"""The query language: lexer, parser, logical plan, compilation to DataFrames."""
