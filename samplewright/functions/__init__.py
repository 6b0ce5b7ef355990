"""Scalar functions: expressions, printed results, distributions' tail probabilities."""
