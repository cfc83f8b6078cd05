"""Episodic time-series analytics on Spark."""
