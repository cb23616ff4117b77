"""Directed property graphs as a vertex and an edge DataFrame; see millrace.graph.graph."""
