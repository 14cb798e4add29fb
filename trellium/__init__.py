"""Trellium: trajectory, evaluation and training-corpus analytics on the Spark DataFrame API."""
