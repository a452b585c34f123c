"""Relational, graph, retrieval and integrity operators."""
