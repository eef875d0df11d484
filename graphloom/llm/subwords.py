"""Subword ids of whole texts: each distinct word of a batch is tokenized once, the rest is gathering."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Subwords:
    """Ids of a public byte-level vocabulary, whose file every machine has at `path`. White space only separates words, each with one blank in front."""

    def __init__(self, path: str = TOKENIZER):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin (one more at the end). A null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.utf8_split_whitespace(texts)
        words, first = split.flatten(), np.concatenate(([0], np.cumsum(np.array(pc.list_value_length(split), np.int64))))
        coded = pc.dictionary_encode(words)
        code, names = np.array(coded.indices, np.int64), coded.dictionary.to_pylist()
        full = np.array([w != "" for w in names], bool)
        real = [w for w in names if w]
        flat = np.array(self.encode(" " + " ".join(real)) if real else [], np.int64)
        starts = np.flatnonzero(self.opens[flat])  # only a word's first subword begins with a blank
        if len(starts) != len(real):
            each = [self.encode(" " + w) for w in real]
            flat = np.array([i for e in each for i in e], np.int64)
            starts = np.concatenate(([0], np.cumsum([len(e) for e in each])))[:-1].astype(np.int64)
        at, lens = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        at[full], lens[full] = starts, np.diff(np.append(starts, len(flat)))
        n = lens[code]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(at[code] - ends[:-1], n) + np.arange(ends[-1])] if ends[-1] else flat[:0]
        return out.astype(np.int32), ends[first]
