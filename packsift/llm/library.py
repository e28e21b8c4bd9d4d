"""The tokenizer library inside tasks."""

from __future__ import annotations

import os
from functools import lru_cache


def loaded(path: str):
    """The tokenizer of a file without truncation and padding, loaded once in a worker process.
    It stays on the task's core: threads of its own would each keep memory."""
    found = os.stat(path)
    return _loaded(path, found.st_mtime_ns, found.st_size)


@lru_cache(maxsize=2)
def _loaded(path: str, *_version: int):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer
