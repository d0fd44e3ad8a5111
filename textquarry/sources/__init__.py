"""Readers that turn files, archives and chat exports into DataFrames."""
