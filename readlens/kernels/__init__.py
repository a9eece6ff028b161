"""Numpy kernels without Spark: alignment walks, dynamic programs, optimisers, samplers."""
