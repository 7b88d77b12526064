"""Tensor quantization and training-data operators on Spark DataFrames."""
