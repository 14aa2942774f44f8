"""Token ids of the public byte-level vocabulary."""

from __future__ import annotations

import base64

import numpy as np

from .common import at_task_end

_encoder = None


class Encoder:
    """Ids as ``tokenizers`` gives them for the vocabulary file, as little-endian 16-bit bytes.

    The same vocabulary and word pattern in the faster library give the same ids; texts that spell a
    special token go through ``tokenizers`` itself. Nothing of a text is remembered.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None) -> None:
        import public_tokenizers as p
        import tiktoken

        self.json_path = json_path or p.path("byte_bpe_50k.json")
        with open(ranks_path or p.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("words", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u2").tobytes()


def encoder() -> Encoder:
    """One for each task: a vocabulary takes less than a tenth of a second to load, and 40 MB."""
    global _encoder
    if _encoder is None:
        _encoder = Encoder()
    return _encoder


@at_task_end
def _forget() -> None:
    global _encoder
    _encoder = None
