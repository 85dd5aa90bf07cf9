"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np

END = 0
# The added token of ``byte_bpe_50k.json``. By default its string in a text is the token, and splits the text.
ADDED, ADDED_ID = "<|endoftext|>", 50256


@cache
def vocabulary(ranks_path: str):
    """The encoder of one worker; it knows no added tokens."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_ranks() -> str:
    """The file of ranks that gives the ids of ``byte_bpe_50k.json``; its reader is the faster of the two."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def ordinary(text: str, ranks_path: str) -> list[int]:
    """The ids of a whole text in which the strings of added tokens are plain text."""
    return vocabulary(ranks_path).encode_ordinary(text)


def encode(text: str | None, ranks_path: str, end: bool = False) -> np.ndarray:
    """The 16-bit ids of a whole text as the tokenizer gives them by default, with the closing id if asked for."""
    ids: list[int] = []
    for i, part in enumerate((text or "").split(ADDED)):
        if i:
            ids.append(ADDED_ID)
        ids += ordinary(part, ranks_path)
    if end:
        ids.append(END)
    return np.array(ids, "<u2")
