"""Readers and writers: CSV files, the dataset store and its catalog."""
