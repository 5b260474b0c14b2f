"""BPE encoding and decoding of whole texts with forced boundaries.

Merges only ever make tokens of the vocabulary, so no merge reaches across two adjacent bytes that stand side by side
inside no token: such a byte pair marks a certain cut. Pieces of the pre-tokenizer fall apart there into fragments, which
are encoded independently (the last one with the word's end) and concatenated. Workers keep what pieces encode to and
encode a batch's new pieces together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import BatchBpe, PieceEncoder, code_points, pieces, ragged
from .shared import lean_cached, require, worker_cache


class WordBpe:
    """Encoder and decoder of a word-end BPE with lower-casing, as its tokenizer file defines it."""

    def __init__(self, path: str, most_cached: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.pieces = PieceEncoder(BatchBpe(model["vocab"], model["merges"], model["end_of_word_suffix"]), most_cached)
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        shown = [(names.get(i, "") + " ").encode("utf-8") for i in range(max(names) + 1)]
        #: Each token's characters in UTF-8 and a space, end to end.
        self.shown_size = np.fromiter(map(len, shown), np.int64, len(shown))
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    @staticmethod
    def normalize(text: str) -> str:
        """Composed and lower-cased, outside ASCII by the library's own tables."""
        if text.isascii():
            return text.lower()
        from tokenizers import normalizers

        return worker_cache("normalizer", lambda: normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])).normalize_str(text)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        points, offsets = code_points([self.normalize(t) for t in texts])
        starts, ends = pieces(points, offsets, spaces=False)
        ids, counts = self.pieces.encode(points, starts, ends)
        to = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, offsets)].tolist()
        return [ids[s:e] for s, e in zip(to, to[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a special token's string is that token."""
        out: list[np.ndarray] = []
        texts = [t or "" for t in texts]
        most, i = 1 << 21, 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= most):
                size += len(texts[j])
                j += 1
            out += self._plain(texts[i:j])
            i = j
        for i, text in enumerate(texts):
            if any(t in text for t in self.special):
                parts = self.parts.split(text)
                found = self._plain([p if k % 2 == 0 else "" for k, p in enumerate(parts)])
                out[i] = np.concatenate([np.array([self.special[p]], np.int32) if k % 2 else f for k, (p, f) in enumerate(zip(parts, found, strict=True))])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens in UTF-8 with a space between; special tokens stay."""
        return self.shown[ragged(self.shown_at[ids], self.shown_size[ids])].tobytes()[:-1]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids binary, decoded string)`` of every document (doc_id, text); null: the empty text, which has no ids.

    ids are little-endian unsigned 32-bit integers, and decoded is what they decode to, special tokens included. Rows
    that repeat a doc_id are kept; an empty table gives an empty result.
    """

    @lean_cached
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_cache(f"word_bpe:{path}", lambda: WordBpe(path))
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                few = b.slice(s, 1024)
                got = bpe.encode(few.column(1).to_pylist())
                ids = pa.array([g.astype("<u4").tobytes() for g in got], pa.binary())
                decoded = pa.array([bpe.decode(g) for g in got], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([few.column(0), ids, decoded], ["doc_id", "ids", "decoded"])

    id_type = dict(docs.dtypes)["doc_id"]
    return require(docs, "doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids binary, decoded string")
