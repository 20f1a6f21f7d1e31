"""Readers of edge lists, graphs derived from relational tables, and sinks."""
