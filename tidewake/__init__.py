"""Tidewake: impact analytics over property graphs, fact logs and contracts, on PySpark."""
