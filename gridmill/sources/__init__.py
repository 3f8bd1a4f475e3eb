"""Readers and writers for files, workbooks and databases."""
