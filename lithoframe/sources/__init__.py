"""Readers and writers of exchange formats; files are read by Spark, a file per row or a line per row."""
