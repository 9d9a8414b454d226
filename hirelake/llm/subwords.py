"""Subword ids of a public byte-level vocabulary.

Remembering the ids of frequent pieces in a bounded table was measured and is slower on texts
with many rare words: 295 to 359 CPU seconds a GB, against about 216 without.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The pattern that parts text before the merges of such vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The pattern takes a run of white space at once, but for its last character where a word follows.
# The encoder's own search fails on runs of hundreds of thousands, so such pieces are cut out first.
RUN = 10_000
_BLANKS = re.compile(rf"[^\S\x1c-\x1f]{{{RUN},}}(?!\S)")


class Subwords:
    """Encoder made from the ranks in a file. It is read once, on the driver, and broadcast:
    its size is that of the vocabulary."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.end = max(self.ranks.values()) + 1
        self.encoder = None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "end": self.end, "encoder": None}

    def starts(self) -> np.ndarray:
        """For every id, 1 if it begins a word after a blank, else 0; also for the end id."""
        out = np.zeros(self.end + 1, np.int64)
        out[[rank for token, rank in self.ranks.items() if token.startswith(b" ")]] = 1
        return out

    def encoding(self) -> tiktoken.Encoding:
        if self.encoder is None:
            self.encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return self.encoder

    def one(self, piece: str) -> list[int]:
        return self.encoding().encode_ordinary(piece)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.empty(0, np.uint16)
        at, out = 0, []
        for run in _BLANKS.finditer(text) if len(text) > RUN else ():
            out += [self._ids(text[at:run.start()]), np.array(self.encoding()._encode_single_piece(run[0]), np.uint16)]
            at = run.end()
        out.append(self._ids(text[at:]))
        return np.concatenate(out) if at else out[0]

    def _ids(self, text: str) -> np.ndarray:
        return self.encoding().encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
