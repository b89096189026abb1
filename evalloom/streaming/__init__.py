"""Streams of questions to a log of answers."""
