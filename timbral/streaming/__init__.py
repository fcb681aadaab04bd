"""Structured Streaming forms of the interval and feature operators."""
