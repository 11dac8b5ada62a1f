"""Scalar functions: tokenizer, quantisation, term vectors, encoders, models."""
