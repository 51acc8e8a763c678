"""Lattica: relational and graph queries folded into Spark plans."""
