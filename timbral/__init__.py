"""Embedding verification and diarization analytics on PySpark DataFrames."""
