"""Byte-level BPE ids of whole texts, as the tokenizers library gives them.

The pre-tokenizer runs over arrays of code points; a piece is encoded when a worker meets it first and looked up after.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .bpe import BatchBpe, PieceEncoder, code_points, pieces


class ByteBpe:
    """``ids(texts)``: little-endian unsigned 32-bit ids of each text; a special token's string is that token."""

    def __init__(self, path: str, most_cached: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces = PieceEncoder(BatchBpe(spec["model"]["vocab"], spec["model"]["merges"]), most_cached)

    def _plain(self, texts: list[str]) -> list[bytes]:
        points, offsets = code_points(texts)
        starts, ends = pieces(points, offsets, spaces=True)
        ids, counts = self.pieces.encode(points, starts, ends)
        raw = ids.astype("<u4").tobytes()
        to = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, offsets)] * 4
        bounds = to.tolist()
        return [raw[s:e] for s, e in zip(bounds, bounds[1:], strict=False)]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        texts = [t or "" for t in texts]
        most, i = 1 << 21, 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= most):
                size += len(texts[j])
                j += 1
            out += self._plain(texts[i:j])
            i = j
        if self.parts:
            for i, text in enumerate(texts):
                if any(t in text for t in self.special):
                    parts = self.parts.split(text)
                    found = self._plain([p if k % 2 == 0 else "" for k, p in enumerate(parts)])
                    out[i] = b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else f for k, (p, f) in enumerate(zip(parts, found, strict=True)))
        return out
