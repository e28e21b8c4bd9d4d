"""Limits and defaults. All are plain values handed to operators as arguments."""

from __future__ import annotations

from dataclasses import dataclass

KIB = 1024
MIB = 1024 * KIB

# Limits and defaults that decide results.
MAX_FINDINGS = 500
MAX_PATH_BYTES = 1024
MAX_MESSAGE_BYTES = 1024
MAX_URL_BYTES = 2048
MAX_REASON_CHARS = 2048
MAX_RULE_ID_CHARS = 200
MAX_BASENAME_CHARS = 256
MAX_DISTRIBUTIONS = 32
MAX_ARCHIVE_ENTRIES = 4096
MAX_DOWNLOAD_SIZE = 32 * MIB
MAX_EXPANDED_SIZE = 64 * MIB
MAX_SCAN_SIZE = 16 * MIB
MAX_CACHE_RESULT_BYTES = 16 * KIB
MAX_LANGUAGE_BYTES = 32
CACHE_ENTRIES = 4096
CACHE_BYTES = 32 * MIB
AUDIT_EVERY = 100
BULK_SIZE = 20
INSPECTOR_HOST = "inspector.pypi.io"
RESULT_FORMAT_TAG = "durable-file-results-v1"

# Our own bounds on control data that is broadcast or written into a plan.
RULE_BATCH_ROWS = 256
RULE_BATCH_BYTES = 1 * MIB
ROWS_PER_SALT = 1_000_000
MAX_BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class ArchiveLimits:
    """Resource limits that an archive must meet before its files are used."""

    entries: int = MAX_ARCHIVE_ENTRIES
    download_size: int = MAX_DOWNLOAD_SIZE
    expanded_size: int = MAX_EXPANDED_SIZE
    scan_size: int = MAX_SCAN_SIZE
