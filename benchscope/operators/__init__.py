"""Relational operators over the benchmark tables (all ``DataFrame -> DataFrame``)."""
