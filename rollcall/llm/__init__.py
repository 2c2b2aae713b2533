"""Operators for building training corpora: scoring, de-duplication, mixing, packing and output."""
