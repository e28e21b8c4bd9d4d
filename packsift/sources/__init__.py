"""Readers and writers: jobs, rules, archives, files, matcher documents, tables."""
