"""Readers and writers: run trees in, benchmark tables out and back in."""
