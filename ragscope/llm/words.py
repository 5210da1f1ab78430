"""Arrow and numpy helpers that run inside tasks: bounded slices of a batch, and its words as numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes that a task works on at a time.
CHUNK_BYTES = 1 << 20


def slices(texts: pa.Array, most: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[slice]:
    """Consecutive slices of about ``most`` bytes, and at most ``rows`` texts; a longer text stands alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most)))
        end = end if rows is None else min(end, at + rows)
        yield slice(at, end)
        at = end


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int | None = None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches cut into bounded pieces, each with its texts (null: empty)."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
        for s in slices(texts, rows=rows):
            yield batch.slice(s.start, s.stop - s.start), texts.slice(s.start, s.stop - s.start)


@dataclass
class Words:
    """The words of some texts, end to end: ``code`` of each in ``distinct``, ``doc`` it is from, words per text."""
    code: np.ndarray
    doc: np.ndarray
    count: np.ndarray
    distinct: pa.Array

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.count) - self.count


def words_of(texts: pa.Array) -> Words:
    """Runs of anything but ASCII white space."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if (empty := pc.index(distinct, "").as_py()) >= 0:  # beside leading and trailing white space
        real = code != empty
        code, doc = code[real], doc[real]
    return Words(code.astype(np.int64), doc, np.bincount(doc, minlength=len(texts)), distinct)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(distinct))
