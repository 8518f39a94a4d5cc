"""Docloom: document analytics as Spark tables, expressions and streams."""
