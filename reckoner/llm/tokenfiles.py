"""Token ids in Arrow files of equal-length sequences.

``write`` deals documents into ranges of ascending doc_id, encodes each range and
writes it as one Arrow IPC file: record batches of the columns ``ids``
(fixed-size list of ``length`` unsigned integers, 16 bits wide where the vocabulary
allows) and ``mask`` (fixed-size list of booleans, false for padding), so sequence
k of a file is found by arithmetic and read from a memory map without a copy. A
second file holds ``doc_id``, ``first`` and ``n_tokens`` of its documents. The
returned manifest has a row for each range. ``read`` goes back from the files
to documents.

Defined results: null and empty texts are documents of the end id alone; rows
with a null doc_id come first; rows with equal doc_id are ordered by text; extra
columns are not written. No documents give no files.

Lost executors: a task writes to a name of its own attempt and renames it at the
end, so a repeated task leaves the same file. Files lie below the session's shared
folder and are reached through its own file system.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reckoner.llm import words

LENGTH = 2048
BATCH_ROWS = 256
CACHE_WORDS = 1_000_000
SLICE_BYTES = 8 << 20
LINE_WORDS = 200
#: The tokenizer takes a run of such letters as one word, and cuts before a mark.
_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_LETTERS = re.compile(f"{_LATIN}+")


class Encoder:
    """Encodes texts with a tokenizer that never joins text across white space and
    closes each word with a piece in ``</w>``.

    Each different word is encoded by the library once and then remembered, up to
    ``CACHE_WORDS`` words; ids of a text are gathered from that memory.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.final[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {"": 0}
        self.flat = np.array([self.end_id], np.uint32)
        self.size = np.array([0, 1], np.int64)  # of slot 0, nothing, and slot 1, the end
        self.begin = np.array([0, 0], np.int64)

    def add(self, new: list[str]) -> None:
        """Encode strings not seen yet; letters alone go to the library in long lines."""
        plain = [x for x in new if _LETTERS.fullmatch(x)]
        other = [x for x in new if not _LETTERS.fullmatch(x)]
        ids, n = [], []
        for a in range(0, len(plain), LINE_WORDS):
            line = np.array(self.tokenizer.encode(" ".join(plain[a : a + LINE_WORDS]), add_special_tokens=False).ids, np.uint32)
            ids.append(line)
            n.append(np.diff(np.flatnonzero(self.final[line]) + 1, prepend=0))
        got = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        ids.append(np.fromiter((i for x in got for i in x), np.uint32))
        n.append(np.fromiter(map(len, got), np.int64, len(got)))
        size = np.concatenate(n)
        self.slots.update(zip(plain + other, range(len(self.size), len(self.size) + len(size)), strict=True))
        self.begin = np.concatenate([self.begin, np.cumsum(size) - size + len(self.flat)])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, *ids])

    def slot_pairs(self, distinct: pa.Array) -> np.ndarray:
        """The slots of each string's letters and of the marks behind them."""
        if len(self.slots) > CACHE_WORDS:
            self.forget()
        plain = pc.match_substring_regex(distinct, f"^{_LATIN}+[.,;:!?]*$")
        heads = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(distinct, ".,;:!?")), distinct)
        tails = pc.if_else(plain, pc.replace_substring_regex(distinct, f"^{_LATIN}+", ""), "")
        columns = []
        for part in (heads, tails):
            code = part.dictionary_encode()
            strings = code.dictionary.to_pylist()
            if new := [x for x in strings if x not in self.slots]:
                self.add(new)
            columns.append(np.fromiter(map(self.slots.__getitem__, strings), np.int64, len(strings))[code.indices.to_numpy(zero_copy_only=False)])
        return np.stack(columns, 1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each row closed by the end id, and the rows' counts."""
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        code = split.flatten().dictionary_encode()
        pairs = self.slot_pairs(code.dictionary)
        slots = pairs[code.indices.to_numpy(zero_copy_only=False)].reshape(-1)
        last = 2 * np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        slots = np.insert(slots, last, 1)
        n = self.size[slots]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[slots] - (ends - n), n)]
        return ids, np.diff(ends[last + np.arange(len(last))], prepend=0)


@functools.lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> Encoder:
    """One for each worker process, so its memory lasts over tasks."""
    return Encoder(path, end_id)


def _rows_of(column: pa.Array) -> Iterator[pa.Array]:
    _, offsets = words.utf8(column)
    for a, b in words.slices(offsets, SLICE_BYTES):
        yield column.slice(a, b - a)


def _id_type(wide: bool, length: int) -> pa.DataType:
    return pa.list_(pa.uint32() if wide else pa.uint16(), length)


class _Writer:
    def __init__(self, system: fs.FileSystem, path: str, wide: bool, length: int):
        self.dtype, self.length, self.waiting, self.n = np.uint32 if wide else np.uint16, length, [], 0
        self.schema = pa.schema([("ids", _id_type(wide, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = system.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: np.ndarray, last: bool = False) -> None:
        """Ids wait until they fill a batch, so all batches but a file's last are equal."""
        self.waiting.append(ids)
        self.n += len(ids)
        size = BATCH_ROWS * self.length
        if self.n < size and not last:
            return
        ids = np.concatenate(self.waiting)
        full = len(ids) if last else len(ids) // size * size
        self.waiting, self.n = [ids[full:]], len(ids) - full
        for a in range(0, full, size):
            now = ids[a : min(a + size, full)]
            padded = -(-len(now) // self.length) * self.length
            real = np.arange(padded) < len(now)
            now = np.concatenate([now, np.zeros(padded - len(now), np.uint32)]).astype(self.dtype)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (now, real)]
            self.file.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema))

    def close(self) -> None:
        self.add(np.zeros(0, np.uint32), last=True)
        self.file.close()
        self.sink.close()


_MANIFEST = "part int, path string, docs_path string, n_docs long, n_tokens long"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Write the token files below ``path``; the manifest, itself stored below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end_id)
        part = TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(path)
        names = [f"{root}/ids-{part:06d}.arrow", f"{root}/docs-{part:06d}.arrow"]
        own = [f"{x}.{uuid.uuid4().hex}" for x in names]
        writer, ids_of, sizes = None, [], []
        for batch in batches:
            if batch.num_rows and writer is None:
                system.create_dir(root, recursive=True)
                writer = _Writer(system, own[0], encoder.wide, length)
            ids_of.append(batch.column(0))
            for rows in _rows_of(batch.column(1)):
                ids, n = encoder.encode(rows)
                writer.add(ids)
                sizes.append(n)
        if writer is None:
            return
        writer.close()
        n = np.concatenate(sizes)
        doc = pa.table({"doc_id": pa.chunked_array(ids_of), "first": np.cumsum(n) - n, "n_tokens": n})
        with system.open_output_stream(own[1]) as sink, pa.ipc.new_file(sink, doc.schema) as file:
            file.write_table(doc, max_chunksize=1 << 16)
        for a, b in zip(own, names, strict=True):
            system.move(a, b)
        uri = path.rstrip("/")
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "path": [f"{uri}/ids-{part:06d}.arrow"], "docs_path": [f"{uri}/docs-{part:06d}.arrow"], "n_docs": pa.array([len(n)], pa.int64()), "n_tokens": pa.array([int(n.sum())], pa.int64())}
        )

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # Writing happens once, here: what follows reads the stored manifest.
    dealt.mapInArrow(run, _MANIFEST).write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.parquet(f"{path}/manifest")


def sequences(path: str) -> pa.Table:
    """The sequences of one file, from a memory map where the file system has one."""
    system, name = fs.FileSystem.from_uri(path)
    source = pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name)
    return pa.ipc.open_file(source).read_all()


def _ids(path: str) -> Iterator[np.ndarray]:
    system, name = fs.FileSystem.from_uri(path)
    source = pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name)
    file = pa.ipc.open_file(source)
    for k in range(file.num_record_batches):
        batch = file.get_batch(k)
        yield batch.column(0).flatten().to_numpy()


def _documents(path: str, docs_path: str) -> Iterator[pa.RecordBatch]:
    """The documents of one file, a batch at a time: id, place, count, checksum."""
    system, name = fs.FileSystem.from_uri(docs_path)
    index = pa.ipc.open_file(system.open_input_file(name))
    stream, have, at = _ids(path), np.zeros(0, np.uint32), 0
    for k in range(index.num_record_batches):
        batch = index.get_batch(k)
        sums = []
        for first, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            more = [have[first - at :]]
            size = len(more[0])
            while size < n:
                more.append(next(stream))
                size += len(more[-1])
            have, at = (np.concatenate(more), first) if len(more) > 1 else (have, at)
            sums.append(zlib.crc32(np.ascontiguousarray(have[first - at : first - at + n], dtype="<u4")))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], ["doc_id", "first", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the file of every document.

    ``start`` counts the ids of all documents before; it comes from the running
    total over the manifest, which has one row for each file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for docs in _documents(row["path"], row["docs_path"]):
                    start = pc.add(docs.column(1), row["base"])
                    yield pa.RecordBatch.from_arrays([docs.column(0), start, docs.column(2), docs.column(3), pa.array([row["part"]] * len(docs), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "part"])

    # One row a file, so the window needs no partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("part", "path", "docs_path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())
    return based.repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")
