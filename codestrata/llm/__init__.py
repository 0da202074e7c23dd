"""Operators for corpora that models are trained on. Nothing outside this folder imports it."""
