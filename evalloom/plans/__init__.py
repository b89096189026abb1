"""Whole programs: scoring a run, comparing runs, profiling a corpus, and the registered queries."""
