"""Helpers the corpus operators share: scratch tables, Arrow slices, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from filequarry.operators.scratch import join_hot, saved as written, shared_dir  # noqa: F401

#: Text bytes that one vectorised step inside a task handles at a time.
SLICE_BYTES = 512 << 10


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches: long texts make the default 10,000 rows too many for a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterable[pa.RecordBatch], text_column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches where their text passes ``limit`` bytes; a longer single text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(size.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C13 | 3
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to the n-th at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            _powers.append(out)
    return _powers


#: All of ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def hash_words(texts: list[str | None], lower: bool = True, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes outside ``space``, ASCII white space) of all texts in
    turn, and where each text's words begin and end in them. ``lower``: A-Z count as a-z."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    edge = np.flatnonzero(np.diff(space[data], prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * up[: len(data)], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts])
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return hashes, bounds


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], n: int, lower: bool = True) -> list[np.ndarray]:
    """The distinct hashes of each text's runs of ``n`` words, ascending; fewer words count as one run."""
    words, bounds = hash_words(texts, lower)
    if len(words) >= n:
        runs = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            runs = mix64(runs ^ words[i : len(words) - n + 1 + i])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = mix64(one ^ words[k : k + 1])
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def joined_batches(batches: Iterable[pa.RecordBatch], text_column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes of text: small ones are joined, large ones cut as by ``slices``."""
    held, size = [], 0
    for part in slices(batches, text_column, limit):
        held.append(part)
        size += pc.sum(pc.binary_length(part.column(text_column))).as_py() or 0
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"]] = True  # not <, | and >, of which special strings consist
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: UTF-8 forms of white space beyond ASCII by last byte, and U+001C to U+001F: nothing is cut after these.
_WIDE = np.zeros(256, bool)
_WIDE[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space beyond ASCII (or may be to some)."""
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    pair = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    pair |= (three == 0xE1) & (((two == 0x9A) & (one == 0x80)) | ((two == 0xA0) & (one == 0x8E)))
    pair |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8B) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    pair |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    return pair | ((three == 0xE3) & (two == 0x80) & (one == 0x80)) | ((one >= 0x1C) & (one <= 0x1F))


def units_of(texts: pa.Array, keep_case: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of all texts, the number of each unit in turn, and the bounds of each text's.

    A unit is white space and the characters after it, cut before an ASCII mark that follows a letter
    or digit of Latin-1, too. Tokenizers that split at white space, letters and marks break at each of these
    places, so their pre-tokens lie inside units. keep_case: texts whose A-Z stay (None: all).
    """
    texts = pc.fill_null(texts, "").cast(pa.string())
    n = len(texts)
    _, offsets, body = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    if not len(data):
        return [], np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    space = _SPACE[data]
    letter = _ALNUM[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.zeros(len(data), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & letter[:-1])
    maybe = np.flatnonzero(cut)
    maybe = maybe[_WIDE[data[maybe - 1]]]
    cut[maybe[_wide_space(data, maybe)]] = False
    cut[ends[:-1][ends[:-1] < len(data)]] = True
    at = np.flatnonzero(cut)
    if keep_case is not None:
        upper = (data >= 65) & (data <= 90)
        if keep_case.any():
            upper &= ~np.repeat(keep_case, np.diff(ends))
        data = data + upper.astype(np.uint8) * np.uint8(32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    found = words.dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(at, ends)
