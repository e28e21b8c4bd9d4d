"""Scanning, reuse and reporting as DataFrame transformations."""
