"""Operators for building large training corpora. Nothing else in tidewell imports this package."""
