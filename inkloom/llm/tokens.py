"""Public tokenizers, loaded from vocabulary files named by path."""

from __future__ import annotations

import base64
import os
from functools import cache

#: Where the vocabulary files lie unless a path is given.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DEFAULT_TOKENIZER = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"

#: Fixed value: the published pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def bpe(path: str = DEFAULT_TOKENIZER):
    """The byte-level BPE of a rank file, kept once per Python process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
