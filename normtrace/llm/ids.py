"""Token ids of whole texts from a byte-level BPE vocabulary file."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import numpy as np

from normtrace.llm.batches import loaded

VOCABULARY = "byte_bpe_50k"


def id_bytes(name: str = VOCABULARY) -> Callable[[str], bytes]:
    """A function from a text to its ids, packed as little-endian unsigned 32-bit numbers.

    The ids are those of the vocabulary's ``tokenizers`` file. The same vocabulary is read here in
    its form of ranks, which encodes several times faster; the tests hold both against each other.
    A special token's string in a text has that token's id, as in the library.
    """
    kept = loaded()
    if ("ids", name) not in kept:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as vocabulary:
            special = {t["content"]: t["id"] for t in json.load(vocabulary)["added_tokens"] if t["special"]}
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        kept["ids", name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    encoding = kept["ids", name]

    def encode(text: str) -> bytes:
        return np.asarray(encoding.encode_to_numpy(text, allowed_special="all"), "<u4").tobytes()

    return encode


def piece_starts(tokens: int, limit: int) -> list[int]:
    """Where the pieces of a document begin: whole pieces of ``limit``, the first takes the rest."""
    rest = tokens % limit or limit
    return [0, *range(rest, tokens, limit)] if tokens else []
