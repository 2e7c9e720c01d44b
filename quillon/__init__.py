"""Quillon: document parsing, header-aware chunking and page layout on Spark DataFrames."""
