"""Operators for building language-model training data, each a Spark job over whole tables."""
