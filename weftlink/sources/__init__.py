"""Readers and writers of record tables, results and reports."""
