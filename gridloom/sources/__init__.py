"""Readers and writers: graph files, measure logs, result trees, tables and corpora."""
