"""Operators over DataFrames: extraction, registry, OCR reconciliation."""
