"""Where vocabulary files lie."""

from __future__ import annotations

import os


def resolve(path: str) -> str:
    """A path as it is, or a bare file name's place among the installed public vocabularies."""
    if os.path.dirname(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)
