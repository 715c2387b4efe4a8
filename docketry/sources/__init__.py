"""Inputs and outputs: PDF scans, page tables, model replies, text, JSON and report sinks."""
