"""A bitemporal knowledge-graph engine on PySpark."""
