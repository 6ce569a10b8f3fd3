"""Token ids in files of bit or byte planes.

``write_tokens`` encodes texts with a tokenizer file, ends every document with
``END`` and writes the ids in ascending ``doc_id`` order; ``read_tokens`` gives
the documents back, ``read_range`` any stretch of a file's ids.

A file is

* a head: magic, unit (1: bit planes, 8: byte planes), ids per block;
* the chunks: a block of ids as 32-bit numbers is transposed, so that the same
  bit (byte) of all its ids stands together, and every plane is compressed by
  itself with Zstandard;
* the chunk index: place, number of ids, CRC-32 and plane lengths of each chunk;
* the document index: ``doc_id`` (with a null flag) and number of ids of each
  (both indexes with a checksum);
* a tail with the lengths of both indexes.

Blocks have a fixed size and run over document ends.  A file closes behind the
document in which it reaches ``FILE_IDS`` ids.  Tasks hold one block, one text
and the two indexes.

The rows are range-partitioned by ``doc_id`` (nulls last), then by a hash of
the text and the row's number in the scan, so neither a shared id nor a row
that is repeated in any number lands in one task.  Files carry the name of
their task attempt; the manifest of the attempts that counted gives their order
and, by a running sum over one row per file, the place of each in the whole
stream.  A file that is absent, damaged or differs from the manifest raises.

Encoding: a byte-level BPE without normaliser never merges over the ends of its
pre-tokens, so a text is cut where such an end is certain (before a blank or
line feed that follows neither blank nor other white space, and behind a word
of ASCII letters) and every distinct piece is encoded once per worker while it
is among ``CACHE`` pieces.  Other tokenizers, and texts with other white space
before a blank, are encoded whole.  Strings of special tokens are ordinary text
unless ``special=True``.

Edge cases: null and empty texts have the end id only; rows with a null
``doc_id`` come last; repeated rows and shared ids are documents of their own;
other columns are left out; an empty table has no files and gives no rows.
"""

from __future__ import annotations

import array
import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import cut, shared_folder
from parley.session import scratch_path

END = 2
BLOCK = 1 << 16
FILE_IDS = 1 << 23
LEVEL = 3
CACHE = 600_000
TEXT_BYTES = 1 << 23  # bytes of the texts that are encoded together (one text at least)
MAGIC = b"IDPLANE1"
_HEAD = struct.Struct("<8sII")
_TAIL = struct.Struct("<QQQ8s")

_WORD = r"\A ?[A-Za-z]+\z"
_INNER = r"(?s)\A[ \n].*[^\s\pZ\v\x1c-\x1f\x{85}]\z"  # begins with a blank, ends without white space
_ODD_SPACE = re.compile(r"[^\S \n][ \n]")


def to_planes(ids: np.ndarray, unit: int) -> list[bytes]:
    """The planes of a block, lowest bit (byte) first."""
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == 8:
        return [cells[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, unit: int) -> np.ndarray:
    if unit == 8:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """One file of ids."""

    def __init__(self, sink, unit: int = 8, block: int = BLOCK):
        self.sink, self.unit, self.block = sink, unit, block
        self.box = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting, self.held = [], 0
        self.chunks: list[tuple] = []
        self.doc_ids, self.sizes = array.array("q"), array.array("Q")
        self.nulls = bytearray()
        self.at, self.ids = _HEAD.size, 0
        sink.write(_HEAD.pack(MAGIC, unit, block))

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """A document's ids as little-endian 32-bit numbers."""
        n = len(raw) // 4
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.sizes.append(n)
        self.ids += n
        self.waiting.append(raw)
        self.held += n
        if self.held >= self.block:
            data = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(data) // self.block * self.block
            for start in range(0, whole, self.block):
                self._chunk(data[start : start + self.block])
            self.waiting, self.held = [data[whole:].tobytes()], len(data) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.box.compress(p) for p in to_planes(ids, self.unit)]
        self.chunks.append((self.at, len(ids), zlib.crc32(ids.tobytes()), *map(len, planes)))
        for p in planes:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._chunk(np.frombuffer(b"".join(self.waiting), "<u4"))
        sealed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        index = sealed.compress(np.array(self.chunks, "<u8").tobytes())
        documents = sealed.compress(self.doc_ids.tobytes() + self.sizes.tobytes() + bytes(self.nulls))
        self.sink.write(index)
        self.sink.write(documents)
        self.sink.write(_TAIL.pack(len(index), len(documents), len(self.doc_ids), MAGIC))
        self.sink.close()


class Reader:
    """One file of ids: its indexes, and any chunk by itself."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if size < _HEAD.size + _TAIL.size:
            raise ValueError("the file is cut off")
        magic, self.unit, self.block = _HEAD.unpack(self._read(0, _HEAD.size))
        index, documents, n, end = _TAIL.unpack(self._read(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC or end != MAGIC or self.unit not in (1, 8):
            raise ValueError("no file of id planes")
        box = self.box = zstandard.ZstdDecompressor()
        at = size - _TAIL.size - documents
        try:
            raw = box.decompress(self._read(at, documents))
            self.chunks = np.frombuffer(box.decompress(self._read(at - index, index)), "<u8").reshape(-1, 3 + 32 // self.unit)
        except (zstandard.ZstdError, ValueError) as e:
            raise ValueError(f"damaged index: {e}") from e
        if len(raw) != 17 * n:
            raise ValueError("the document index has another length")
        self.doc_ids, self.sizes, self.nulls = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n)
        self.ids = int(self.chunks[:, 1].sum())
        if self.ids != int(self.sizes.sum()):
            raise ValueError("documents and chunks differ in ids")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, i: int) -> np.ndarray:
        at, n, crc, *lengths = self.chunks[i].tolist()
        raw = self._read(at, sum(lengths))
        ends = list(itertools.accumulate(lengths, initial=0))
        try:
            planes = [self.box.decompress(raw[a:b]) for a, b in itertools.pairwise(ends)]
        except zstandard.ZstdError as e:
            raise ValueError(f"chunk {i}: {e}") from e
        if any(len(p) != (n if self.unit == 8 else (n + 7) // 8) for p in planes):
            raise ValueError(f"chunk {i}: a plane has another length")
        ids = from_planes(planes, n, self.unit)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {i}: checksum")
        return ids

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``doc_id``, first id's number in the file, ids; chunk after chunk."""
        at, next_chunk, held = 0, 0, np.zeros(0, "<u4")
        for doc_id, n, null in zip(self.doc_ids.tolist(), self.sizes.tolist(), self.nulls.tolist()):
            if len(held) < n:
                parts, have = [held], len(held)
                while have < n:
                    parts.append(self.chunk(next_chunk))
                    have += len(parts[-1])
                    next_chunk += 1
                held = np.concatenate(parts)
            yield None if null else doc_id, at, held[:n]
            held, at = held[n:], at + n


def read_range(source, start: int, stop: int) -> np.ndarray:
    """The ids ``start`` to ``stop`` of a file; reads the chunks that hold them."""
    file = Reader(source)
    stop = min(stop, file.ids)
    if start >= stop:
        return np.zeros(0, "<u4")
    first = start // file.block
    parts = [file.chunk(i) for i in range(first, (stop - 1) // file.block + 1)]
    return np.concatenate(parts)[start - first * file.block : stop - first * file.block]


def ragged(ids: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``at`` of ``ids``, which are ``size`` long, one behind the other."""
    n = size[at]
    shift = (np.cumsum(size) - size)[at] - (np.cumsum(n) - n)
    return ids[np.repeat(shift, n) + np.arange(n.sum())]


class Pieces:
    """Distinct pieces of text with the ids of each, as columns."""

    def __init__(self, text: pa.Array | None = None, size: np.ndarray | None = None, ids: np.ndarray | None = None):
        self.text = pa.array([], pa.large_binary()) if text is None else text
        self.size = np.zeros(0, np.int64) if size is None else size
        self.ids = np.zeros(0, np.uint32) if ids is None else ids

    def __len__(self) -> int:
        return len(self.text)

    def find(self, wanted: pa.Array) -> np.ndarray:
        """The places of ``wanted``, -1 where a piece is not here."""
        return pc.fill_null(pc.index_in(wanted, value_set=self.text), -1).to_numpy().astype(np.int64)

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces(self.text.take(pa.array(at)), self.size[at], ragged(self.ids, self.size, at))

    def joined(self, *others: Pieces) -> Pieces:
        every = (self, *others)
        return Pieces(pa.concat_arrays([p.text for p in every]), np.concatenate([p.size for p in every]), np.concatenate([p.ids for p in every]))


class Encoder:
    """Texts to ids as little-endian 32-bit numbers."""

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        cutter, model = form.get("pre_tokenizer") or {}, form["model"]
        tokens = form.get("added_tokens") or []
        plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and form.get("normalizer") is None and model.get("type") == "BPE"
        # An added token must lie inside a piece wherever it is looked for.
        self.by_piece = plain and (not special or not tokens)
        self.by_piece = self.by_piece and all(t["special"] for t in tokens)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = not special
        self.known, self.older = Pieces(), Pieces()
        if self.by_piece:
            self.words = Tokenizer.from_file(path)
            self.words.no_truncation()
            self.words.encode_special_tokens = True
            self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
            # In a byte-level vocabulary a token's characters stand for its bytes.
            vocab = self.tokenizer.get_vocab()
            self.width = np.zeros(max(vocab.values()) + 1, np.int64)
            self.width[list(vocab.values())] = [len(t) for t in vocab]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _dealt(self, ids: list[int], pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per piece its number of ids, by the bytes that they stand for; the ids."""
        ids = np.array(ids, np.uint32)
        ends = np.cumsum(self.width[ids])
        wanted = np.cumsum(pc.binary_length(pieces).to_numpy())
        last = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[last], wanted):
            raise ValueError("an id reaches over the end of a piece")
        return np.diff(last + 1, prepend=0), ids

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per piece its number of ids; the ids.  Words are pre-tokens already,
        so they go to the model in the vocabulary's own letters; other pieces
        that begin with a blank and end without are encoded as one text, which
        has certain ends between them."""
        pieces = pa.array(new, pa.large_string())
        word, inner = (pc.match_substring_regex(pieces, p).to_numpy(zero_copy_only=False) for p in (_WORD, _INNER))
        kind = np.where(word, 0, np.where(inner, 1, 2))
        parts = []
        for k, (tokenizer, between) in enumerate(((self.words, "\n"), (self.tokenizer, ""))):
            some = pieces.filter(pa.array(kind == k))
            if len(some):
                text = between.join(some.to_pylist())
                text = text.replace(" ", "\u0120") if tokenizer is self.words else text
                parts.append(self._dealt(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, some))
        raw = self._whole(pieces.filter(pa.array(kind == 2)).to_pylist())
        parts.append((np.array([len(r) // 4 for r in raw], np.int64), np.frombuffer(b"".join(raw), np.uint32)))
        size, ids = (np.concatenate(p) for p in zip(*parts))
        place = np.empty(len(new), np.int64)
        place[np.argsort(kind, kind="stable")] = np.arange(len(new))
        return size[place], ragged(ids, size, place)

    def _find(self, used: pa.Array) -> np.ndarray:
        """The places of distinct pieces in ``known``.  Pieces are kept in two
        generations: a full one becomes the older one, from which pieces that
        are met again move on; only those not met for so long are forgotten."""
        if len(self.known) > CACHE // 2:
            self.known, self.older = Pieces(), self.known
        found = self.known.find(used)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            wanted = used.take(pa.array(missing))
            old = self.older.find(wanted)
            moved = self.older.take(old[old >= 0])
            unknown = wanted.filter(pa.array(old < 0))
            learnt = Pieces(unknown, *self._learn(unknown.cast(pa.large_string()).to_pylist()))
            found[missing[old >= 0]] = len(self.known) + np.arange(len(moved))
            found[missing[old < 0]] = len(self.known) + len(moved) + np.arange(len(learnt))
            self.known = self.known.joined(moved, learnt)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._whole(texts)
        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of a string column: the pieces are cut, told apart and put
        together as columns, and only distinct ones are looked up."""
        if not self.by_piece:
            return self._whole(texts.to_pylist())
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return []
        ends = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        starts, odd = cut_places(data, ends)
        places = pa.py_buffer(np.append(starts, len(data)).astype("<i8"))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, places, pa.py_buffer(data)]).dictionary_encode()
        code = self._find(pieces.dictionary)[pieces.indices.to_numpy()]
        before = np.append(0, np.cumsum(self.known.size[code]))
        out = ragged(self.known.ids, self.known.size, code)
        raw, cuts = out.tobytes(), (4 * before[np.searchsorted(starts, ends)]).tolist()
        encoded = [raw[a:b] for a, b in itertools.pairwise(cuts)]
        for i in odd.tolist():
            text = texts[i].as_py()
            if _ODD_SPACE.search(text):
                encoded[i] = self._whole([text])[0]
        return encoded


def cut_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of texts in UTF-8 begin that lie one behind the other
    between ``ends``, and the numbers of the texts that may hold other white
    space before a blank.

    A piece begins with a text, with a run of blanks and line feeds, and behind
    ASCII letters that stand between such a run (or the text's begin) and
    another ASCII character.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KINDS[data]
    head = np.zeros(len(data) + 1, bool)
    head[ends] = True
    head = head[:-1]
    blank, letter = kind == _BLANK, kind == _LETTER
    after = np.append(False, blank[:-1])  # behind a blank
    begin = head | (blank & ~after)
    run = np.append(False, letter[:-1]) & ~head  # behind a letter of the same text
    first, last = np.flatnonzero(letter & ~run), np.flatnonzero(run & ~letter)
    # A run of letters that ends with its text has no end in ``last``.
    at = np.searchsorted(first, last) - 1
    word = (head | after)[first[at]] & (kind[last] != _BLANK) & (data[last] < 128)
    begin[last[word]] = True
    spaced = np.flatnonzero(blank & ~head & np.append(False, _MAYBE_SPACE[data[:-1]]))
    return np.flatnonzero(begin), np.unique(np.searchsorted(ends, spaced, "right") - 1)


_BLANK, _LETTER = 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \n")] = _BLANK
_KINDS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
# Last bytes of the white space other than blank and line feed.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[c.encode("utf-8", "replace")[-1] for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n"]] = True


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, special: bool = False) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` range-partitioned and sorted by ``doc_id``, nulls last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc(), F.col("row").asc()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``TEXT_BYTES`` of text each."""
    size = np.append(0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(size, size[at] + TEXT_BYTES, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END, unit: int = 8, block: int = BLOCK, file_ids: int = FILE_IDS, special: bool = False) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)``; returns the manifest ``part,
    number, name, documents, ids, start`` of the files, where ``start`` counts
    the ids of all files before."""
    spark = docs.sparkSession
    address = shared_folder(spark, folder)
    last = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(address)
        task, own = TaskContext.get(), encoder(tokenizer, special)
        part, files, writer, name = task.partitionId(), [], None, ""

        def close() -> None:
            writer.close()
            files.append((part, len(files), name, len(writer.sizes), writer.ids))

        for batch in batches:
            for piece in slices(batch):
                for doc_id, raw in zip(piece.column(0).to_pylist(), own.encode_column(piece.column(1))):
                    if writer is None:
                        name = f"{part:06d}-{len(files):05d}-{task.taskAttemptId()}.ids"
                        writer = Writer(fs.open_output_stream(f"{root}/{name}"), unit, block)
                    writer.add(doc_id, raw + last)
                    if writer.ids >= file_ids:
                        close()
                        writer = None
        if writer is not None:
            close()
        columns = list(zip(*files)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _MANIFEST)], names=["part", "number", "name", "documents", "ids"])

    files = cut(in_order(docs).mapInArrow(run, "part int, number int, name string, documents long, ids long"))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


_MANIFEST = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())


def read_tokens(manifest: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document in
    the files of ``manifest``."""
    address = shared_folder(manifest.sparkSession, folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    names = [f.split()[0] for f in schema.split(", ")]
    types = [*[pa.int64()] * 4, pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(address)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for name, documents, expected, start in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{root}/{name}") as source:
                    file = Reader(source)
                    if (len(file.sizes), file.ids) != (documents, expected):
                        raise ValueError(f"{name} differs from the manifest")
                    rows, size = [], 0
                    for doc_id, at, found in file.documents():
                        row = (doc_id, start + at, len(found), zlib.crc32(found.tobytes()))
                        rows.append((*row, found.astype(np.int64)) if ids else row)
                        size += len(found) if ids else 1
                        if size >= 1 << 16:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)

    files = manifest.select("name", "documents", "ids", "start")
    # One file a task; without a number the few rows would be coalesced into one.
    return files.repartition(max(1, files.count())).mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, **params) -> DataFrame:
    """Write ``docs`` and read the files back: one row per document."""
    folder = folder or scratch_path(docs.sparkSession, f"ids-{uuid.uuid4().hex}")
    return read_tokens(write_tokens(docs, folder, tokenizer, **params), folder, ids=False)


def default_tokenizer(spark: SparkSession | None = None) -> str:
    """Place of the byte-level vocabulary that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
