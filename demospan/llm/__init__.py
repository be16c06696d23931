"""Operators for building training data: filters, dedup, decontamination, token counts and packing."""
