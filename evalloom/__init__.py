"""Evaluation of answer batches and profiling of the data behind them, as plain DataFrame programs."""
