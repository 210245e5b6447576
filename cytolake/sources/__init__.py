"""Readers of genomic text formats, and tables derived from others."""
