"""Blocks of texts as numbered words: each distinct word of a block is looked at once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a block; a longer text makes a block of its own.
BLOCK_BYTES = 3 << 20


class Block(NamedTuple):
    at: int  # first row of the block in its batch
    texts: pa.Array  # without nulls
    begins: np.ndarray  # where each text's words begin in `which`, and their end
    which: np.ndarray  # number of each word
    words: pa.Array  # the distinct words


def blocks(texts: pa.Array) -> Iterator[Block]:
    """Runs of rows with their words, split at white space; null texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
        own = texts.slice(at, to - at)
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(own))
        ends = lists.offsets.to_numpy()
        numbered = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        begins, which = (ends - ends[0]).astype(np.int64), numbered.indices.to_numpy(zero_copy_only=False)
        nothing = pc.index(numbered.dictionary, "").as_py()
        if nothing >= 0:  # a text without words splits into an empty one
            some = which != nothing
            begins, which = np.concatenate(([0], np.cumsum(some)))[begins], which[some]
        yield Block(at, own, begins, which, numbered.dictionary)
        at = to


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each word with a blank on both sides, and where each word begins."""
    joined = " " + "  ".join(words.to_pylist()) + " " if len(words) else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    return codes, np.cumsum(sizes) - sizes


def ngrams(codes: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """A bucket for each run of ``n`` code points that begins at each place but the last ``n`` - 1."""
    mixed = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for i in range(n):
        mixed = (mixed ^ codes[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(buckets)).astype(np.int64)
