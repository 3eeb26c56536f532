"""Public tokenizers, loaded on the executors from a folder that is a parameter and never copied."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

DEFAULT = "byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text into words before the merges of this vocabulary apply.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = DEFAULT, folder: str | None = None) -> str:
    """Where a vocabulary file lies: in `folder`, or in NEWSLOOM_TOKENIZERS, or /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("NEWSLOOM_TOKENIZERS", "/opt/tokenizers"), name)


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder of a file of ranks; kept for the life of a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(enc, text: str) -> int:
    return len(enc.encode_ordinary(text)) if text else 0
