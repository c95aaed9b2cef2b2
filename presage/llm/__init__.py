"""Operators for training-data pipelines: text, vectors and conversations in, decisions and layouts out."""
