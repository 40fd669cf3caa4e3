"""Token counts of a public byte-level BPE."""

from __future__ import annotations

import base64
from pathlib import Path

#: Folder of the public vocabulary files; a parameter of every operator that counts tokens.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The split pattern that belongs to this vocabulary (a fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TokenCounter:
    """Counts tokens of whole texts; strings that look like special tokens are ordinary text."""

    def __init__(self, folder: str = TOKENIZER_DIR) -> None:
        import tiktoken

        lines = Path(folder, VOCABULARY).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self._encode = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def count(self, text: str | None) -> int:
        return len(self._encode(text)) if text else 0
