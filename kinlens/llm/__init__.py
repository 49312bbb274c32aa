"""Operators for training-data pipelines over text, conversations, vectors and audio."""
