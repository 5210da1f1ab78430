"""Token-ID output as Arrow stream files of equal-length sequences.

Documents are encoded, closed with an end id and laid end to end in ascending id order; the stream is cut
into sequences of ``seq_len`` ids. A data file is an Arrow stream of batches with two fixed-size-list columns:
``ids`` (uint16 where the vocabulary fits, else uint32) and ``mask`` (true for ids, false for the
padding of a file's last sequence). All batches but the last hold the same number of sequences, so a memory map
gives any sequence without copying. A small index file beside it has each document's place.

One range partition of ids makes one data file. File names carry an attempt's own token: a task that runs
twice leaves an unused file, never a mixed one, and the manifest names the files of the attempts that count.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_path, table

END_ID = 1
SEQ_LEN = 2048
#: Sequences of one Arrow batch: a megabyte or two.
BATCH = 256
#: UTF-8 bytes that are encoded at a time within a task.
CHUNK_BYTES = 4 << 20
#: Distinct words whose ids a worker remembers at most; beyond it starts anew.
MAX_CACHED = 400_000
#: A special token of the vocabulary in a text has to reach the tokenizer whole; so has a letter whose lower case ends
#: in a combining mark, which punctuation after it would be joined to.
_WHOLE = "<\\||\u0130"


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts through a vocabulary whose pieces never cross white space, one distinct word at a time.

    White space separates pieces and has no id, and a letter before ASCII punctuation always ends a piece, so a
    text's ids are the ids of its parts in order. Each part is encoded once and remembered. Parts of Latin letters
    only are one piece each and go straight to the vocabulary's merges; all others, and whole texts with a special
    token or a dotted capital I, take the tokenizer's full path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.merges, self.letters = self.whole.model, _byte_letters()
        self.lower = "Lowercase" in repr(self.whole.normalizer)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.lengths, self.pool = [1], [END_ID]  # entry 0 is the end id

    def _learn(self, words: list[str]) -> None:
        slow = []
        for w in words:
            low = w.lower()
            if self.lower and low.isalpha() and ord(max(low)) < 0x250:
                self._add(w, [t.id for t in self.merges.tokenize(low.encode().decode("latin-1").translate(self.letters))])
            else:
                slow.append(w)
        for w, e in zip(slow, self.whole.encode_batch_fast(slow, add_special_tokens=False)):
            self._add(w, e.ids)

    def _add(self, word: str, ids: list[int]) -> None:
        self.place[word] = len(self.lengths)
        self.lengths.append(len(ids))
        self.pool.extend(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, an end id after each, and the ids per text."""
        if len(self.lengths) > MAX_CACHED:
            self.clear()
        odd = pc.match_substring_regex(texts, _WHOLE)
        split = pc.replace_substring_regex(pc.ascii_lower(texts), r"(\pL)([!-/:-@\[-`{-~])", r"\1 \2")
        lists = pc.ascii_split_whitespace(split)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.place])
        entry = np.fromiter((self.place[w] for w in words), np.int64, len(words))
        lengths, pool = np.asarray(self.lengths), np.asarray(self.pool, np.uint32)
        starts = np.cumsum(lengths) - lengths
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        parts = np.insert(entry[coded.indices.to_numpy()], np.cumsum(counts), 0)  # end ids
        sizes = lengths[parts]
        ends = np.cumsum(sizes)
        ids = pool[np.repeat(starts[parts] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        closed = np.cumsum(counts + 1)
        upto = ends[closed - 1] if len(closed) else np.zeros(0, np.int64)
        per_text = np.diff(upto, prepend=0)
        if not pc.any(odd).as_py():
            return ids, per_text
        out = []
        for i, (text, whole) in enumerate(zip(texts.to_pylist(), odd.to_pylist())):
            out.append(np.array([*self.whole.encode(text, add_special_tokens=False).ids, END_ID], np.uint32) if whole
                       else ids[upto[i] - per_text[i]: upto[i]])
        return np.concatenate(out), np.array([len(x) for x in out])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process: the remembered words serve all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Slices of about CHUNK_BYTES; a longer text stands alone."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES)))
        yield slice(at, end)
        at = end


def _fs(path: str):
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


class _Sequences:
    """Writes a stream of ids as fixed-size-list batches."""

    def __init__(self, sink, kind: pa.DataType, seq_len: int):
        self.seq_len, self.kind, self.rest = seq_len, kind, []
        self.held = 0
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = pa.ipc.new_stream(sink, self.schema)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        self.out.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.seq_len),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.kind.to_pandas_dtype()))
        self.held += len(ids)
        whole = self.seq_len * BATCH
        if self.held >= whole:
            flat = np.concatenate(self.rest)
            cut = len(flat) // whole * whole
            for at in range(0, cut, whole):
                self._write(flat[at: at + whole], whole)
            self.rest, self.held = [flat[cut:]], len(flat) - cut

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.rest)
            self._write(np.pad(flat, (0, -len(flat) % self.seq_len)), len(flat))
        self.out.close()


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, data string, index string, n_docs long, n_tokens long"


def _writer(folder: str, tokenizer: str, seq_len: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, at, n_docs, streams = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0, None
        kind = pa.uint16() if words.whole.get_vocab_size() <= 1 << 16 else pa.uint32()
        for batch in batches:
            if not batch.num_rows:
                continue
            if streams is None:
                fs, root = _fs(folder)
                fs.create_dir(root, recursive=True)
                name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}"
                sinks = [fs.open_output_stream(name + end) for end in (".arrows", ".index.arrows")]
                streams = _Sequences(sinks[0], kind, seq_len), pa.ipc.new_stream(sinks[1], INDEX)
            texts = batch.column(1)
            for part in _slices(texts):
                ids, per_text = words.encode(texts[part.start: part.stop])
                streams[0].add(ids)
                ends = at + np.cumsum(per_text)
                streams[1].write_batch(pa.record_batch([batch.column(0)[part.start: part.stop], pa.array(ends - per_text), pa.array(per_text)], schema=INDEX))
                at, n_docs = int(ends[-1]), n_docs + len(per_text)
        if streams:
            for x in (*streams, *sinks):
                x.close()
            base = f"{folder}/{name.rpartition('/')[2]}"
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([base + ".arrows"]), pa.array([base + ".index.arrows"]),
                                   pa.array([n_docs], pa.int64()), pa.array([at], pa.int64())],
                                  names=["shard", "data", "index", "n_docs", "n_tokens"])
    return write


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                    seq_len: int = SEQ_LEN, bytes_per_file: int = 64 << 20, order: list[Column] | None = None) -> DataFrame:
    """Encode every whole text and write the files; returns the manifest, one row per data file.

    Rows are range-sorted by ``order``, or else by (doc_id, hash of the text): null ids come first, repeated ids and repeated
    rows are documents of their own, also when one id has a third of all rows. A null text is empty and has its end id only.
    An empty table gives an empty manifest and no file. Other columns are ignored. The number of files follows the bytes
    of text. ``folder`` must be one that all executors share.
    """
    keys = [F.col(doc_id).cast("long"), F.xxhash64(text)] if order is None else order
    at = [f"at{i}" for i in range(len(keys))]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       *[k.alias(a) for k, a in zip(keys, at)])
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n = max(1, ceil(total / bytes_per_file), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total >> 20))
    ordered = rows.repartitionByRange(n, *at).sortWithinPartitions(*at).select("doc_id", "text")
    return materialise(ordered.mapInArrow(_writer(folder, tokenizer, seq_len), MANIFEST), "token-manifest")


def open_sequences(path: str) -> pa.Table:
    """All sequences of a data file through a memory map: nothing is copied until values are used."""
    return pa.ipc.open_stream(pa.memory_map(path)).read_all()


def sequence(data: pa.Table, i: int) -> tuple[np.ndarray, pa.Array]:
    """Sequence ``i`` as a view of the mapped ids, and its mask."""
    batch, row = data.column("ids").chunks[i // BATCH], i % BATCH
    width = batch.type.list_size
    ids = batch.flatten()[row * width: (row + 1) * width].to_numpy(zero_copy_only=True)
    return ids, data.column("mask").chunks[i // BATCH].flatten()[row * width: (row + 1) * width]


def _reader(end_only: bool = False):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for manifest in batches:
            for row in manifest.to_pylist():
                (fs, data), (_, index) = _fs(row["data"]), _fs(row["index"])
                with fs.open_input_stream(data) as raw, fs.open_input_stream(index) as places:
                    chunks = (np.asarray(b.column(0).flatten())[np.asarray(b.column(1).flatten())] for b in pa.ipc.open_stream(raw))
                    held, first = np.zeros(0, np.uint16), 0  # ids from position first on
                    for docs in pa.ipc.open_stream(places):
                        start, size, crc = docs.column(1).to_numpy(), docs.column(2).to_numpy(), []
                        for s, n in zip(start.tolist(), size.tolist()):
                            if s - first + n > len(held):
                                parts, have = [held[s - first:]], len(held) - (s - first)
                                while have < n:
                                    parts.append(next(chunks))
                                    have += len(parts[-1])
                                held, first = np.concatenate(parts), s
                            crc.append(zlib.crc32(held[s - first: s - first + n].astype("<u4").tobytes()))
                        yield pa.record_batch([docs.column(0), pa.array(start + row["base"]), docs.column(2), pa.array(crc, pa.int64())],
                                              names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return read


def read_documents(manifest: DataFrame) -> DataFrame:
    """Each document as the files have it: its place in the whole stream, its ids' number and CRC-32. A task reads one
    file as a stream; only the manifest, one row per file, is summed in one place."""
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (placed.repartitionByRange(max(1, manifest.count()), "shard").select("data", "index", "base")
            .mapInArrow(_reader(), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def token_files(spark, docs: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    return read_documents(write_sequences(docs, shared_path(spark, "tokens"), tokenizer_file(), order=order))


def written_order(docs: DataFrame) -> list[Column]:
    """Sort keys that give the rows of a Parquet table in the order in which a sorted DataFrame was written: the number of
    the part file and the row in it."""
    meta = docs.metadataColumn("_metadata")
    return [F.regexp_extract(meta["file_name"], r"part-(\d+)", 1).cast("int"), meta["row_index"]]


def op4_arrow_sequences(spark, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"))
