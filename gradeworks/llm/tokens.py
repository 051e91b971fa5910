"""The public byte-level BPE vocabulary inside tasks."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY) -> Callable[[str], list[int]]:
    """``text -> ids`` of vocabulary ``name``, without special tokens added.

    The rank file and the ``tokenizers`` file hold the same vocabulary and pattern; the rank form is
    several times faster. A text that spells a special token goes to ``tokenizers``, which gives that
    token its own id.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = [str(t.content) for t in full.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(mark in text for mark in special):
            return full.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode
