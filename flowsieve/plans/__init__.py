"""Whole runs (replay, explain) and the documents they write."""
