"""Operators for training-data pipelines, built on the core. Nothing in the core imports this package."""
