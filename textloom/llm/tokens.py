"""Words, their hashes and public tokenizers, batch-wise in NumPy."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pandas as pd

#: Maximal runs of letters and digits; an underscore is neither.
WORD = re.compile(r"[^\W_]+")

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, ends)``: the word hashes of all texts in a row, and where each text ends."""
    words: list[str] = []
    ends = []
    for t in texts:
        if t:
            words += WORD.findall(t.lower())
        ends.append(len(words))
    if not words:
        return np.empty(0, np.uint64), np.asarray(ends, np.int64)
    codes, uniques = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(uniques.astype(object), categorize=False)[codes], np.asarray(ends, np.int64)


def windows(hashes: np.ndarray, ends: np.ndarray, offsets: Iterable[int], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``span`` consecutive elements, of which only those at ``offsets`` count.

    Returns the window hashes of all texts in a row, the text each belongs to,
    and the position of each in its text.
    """
    n = len(hashes)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lengths = np.maximum(ends - starts - (span - 1), 0)
    doc = np.repeat(np.arange(len(ends)), lengths)
    if not len(doc):
        return np.empty(0, np.uint64), doc, np.empty(0, np.int64)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = starts[doc] + pos
    out = np.zeros(len(doc), np.uint64)
    for j, o in enumerate(offsets):
        out = mix(out + hashes[at + o] * np.uint64(2 * j + 3) + _STEP)
    assert n >= 0
    return out, doc, pos


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their token counts, for a vocabulary file.

    ``.tiktoken`` files are rank lists, ``.json`` files whole tokenizers,
    ``.model`` files piece models. Special tokens are never parsed from texts.
    """
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        enc = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)] if texts else []
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in whole.encode_batch_fast(texts, add_special_tokens=False)]
