"""Operators for building training data: extraction, deduplication, classification, packing and scoring."""
