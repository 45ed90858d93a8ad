"""Scalar functions as Spark columns, and their plain Python twins for the decoders."""
