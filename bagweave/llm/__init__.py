"""Operators for training data: similar vectors, grouped splits, clusters, runs, packing, leakage, splitting."""
