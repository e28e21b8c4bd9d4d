"""Structured Streaming forms of the job loop and the bounded result cache."""
