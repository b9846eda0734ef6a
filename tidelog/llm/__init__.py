"""Operators for preparing large text corpora for training. Nothing else in tidelog imports this."""
