"""Operators for building training corpora: deduplication, scans, filters, mixing, archives."""
