"""Lectern: document collections as searchable, quizzable, training-ready Spark tables."""
