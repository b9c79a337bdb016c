"""Bitemporal knowledge-graph analytics on PySpark."""
