"""Token ids in binary files of bit planes or byte planes.

A file holds the ids of some documents in a row, cut into blocks of a fixed number of ids. A block is transposed, so that
bit k (or byte k) of all its ids lies together, and each plane is compressed by itself with zstandard; planes above the
highest that is used are left out. Behind the blocks lie two Arrow tables, the index of the chunks (where a block
begins, its number of ids, the sizes of its planes) and that of the documents (id and number of ids), then their sizes
and the number of the file. A reader finds any id from the end of the file, the two tables and one block.

Files are written by Spark itself, each block as a record of a partition, so that any store will do and a task that
is run again leaves no trace: the partitions are ranges of doc_id, and a partition is a file.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.functions.storage import fresh_path
from wakeline.llm._shared import texts

# Fixed values of the format. Records end with a line feed, as Spark writes them; offsets and sizes are without it.
MAGIC = b"WLTOKEN1"
TAIL = struct.Struct("<QQq8s")  # bytes of the chunk index, bytes of the document index, number of the file, MAGIC
BLOCK_IDS = 1 << 16
#: A file holds the ids of about this many bytes of text.
FILE_BYTES = 32 << 20
#: Words whose ids a worker remembers: this many of the latest, and the last full set before them.
KNOWN_WORDS = 350_000


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first, up to the highest that has a bit set; at least one."""
    if kind == "bit":
        bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        n = max(1, int(ids.max(initial=0)).bit_length())
        return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(n)]
    parts = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    n = max(1, -(-int(ids.max(initial=0)).bit_length() // 8))
    return [parts[:, k].tobytes() for k in range(n)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The n ids whose planes these are."""
    if kind == "bit":
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    parts = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        parts[:, k] = np.frombuffer(p, np.uint8)
    return parts.view("<u4").ravel()


def _arrow(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue()


class FileWriter:
    """The records of one file, in turn: add documents, then take what close gives."""

    def __init__(self, number: int, id_type: pa.DataType, block_ids: int = BLOCK_IDS, kind: str = "byte") -> None:
        self.number, self.id_type, self.block_ids, self.kind = number, id_type, block_ids, kind
        self.held: list[bytes] = []
        self.n_held = self.at = 0
        self.chunks: list[tuple[int, int, list[int]]] = []
        self.docs: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.packer = zstandard.ZstdCompressor(level=3)

    def _record(self, ids: np.ndarray) -> bytes:
        planes = [self.packer.compress(p) for p in to_planes(ids, self.kind)]
        record = b"".join(planes)
        self.chunks.append((self.at, len(ids), [len(p) for p in planes]))
        self.at += len(record) + 1
        return record

    def add(self, doc_ids: pa.Array, ids: list[bytes]) -> Iterator[bytes]:
        """Takes documents, their ids as little-endian bytes; gives the blocks that are full."""
        self.docs.append(doc_ids.cast(self.id_type))
        self.sizes.append(np.array([len(x) // 4 for x in ids], np.int64))
        full = 4 * self.block_ids
        for x in ids:
            self.held.append(x)
            self.n_held += len(x)
            if self.n_held >= full:
                data = b"".join(self.held)
                cut = len(data) // full * full
                for i in range(0, cut, full):
                    yield self._record(np.frombuffer(data, "<u4", self.block_ids, i))
                self.held, self.n_held = [data[cut:]], len(data) - cut

    def close(self) -> Iterator[bytes]:
        """The last block, and the record with both indexes."""
        if self.n_held:
            yield self._record(np.frombuffer(b"".join(self.held), "<u4"))
        chunks = pa.table({
            "offset": pa.array([c[0] for c in self.chunks], pa.int64()), "n_ids": pa.array([c[1] for c in self.chunks], pa.int64()),
            "planes": pa.array([c[2] for c in self.chunks], pa.list_(pa.int64())),
        }).replace_schema_metadata({"kind": self.kind})
        docs = pa.table({"doc_id": pa.chunked_array(self.docs, self.id_type), "n_ids": pa.array(np.concatenate([np.zeros(0, np.int64), *self.sizes]))})
        a, b = _arrow(chunks), _arrow(docs)
        yield a + b + TAIL.pack(len(a), len(b), self.number, MAGIC)


class FileReader:
    """A file of token ids, from its bytes: number, kind, chunks (offset, n_ids, planes) and docs (doc_id, n_ids)."""

    def __init__(self, content: bytes | memoryview) -> None:
        self.content = memoryview(content)
        end = len(self.content) - 1  # of the last record, before its line feed
        if end < TAIL.size or bytes(self.content[end - 8 : end]) != MAGIC:
            raise ValueError("not a file of token ids")
        a, b, self.number, _ = TAIL.unpack(self.content[end - TAIL.size : end])
        b_at = end - TAIL.size - b
        self.chunks = pa.ipc.open_stream(self.content[b_at - a : b_at]).read_all()
        self.docs = pa.ipc.open_stream(self.content[b_at : end - TAIL.size]).read_all()
        self.kind = self.chunks.schema.metadata[b"kind"].decode()
        self._unpacker = zstandard.ZstdDecompressor()

    def block(self, k: int) -> np.ndarray:
        """The ids of one block; nothing else of the file is decoded."""
        at, planes = self.chunks.column("offset")[k].as_py(), []
        for size in self.chunks.column("planes")[k].as_py():
            planes.append(self._unpacker.decompress(self.content[at : at + size]))
            at += size
        return from_planes(planes, self.chunks.column("n_ids")[k].as_py(), self.kind)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place start of the file on, from the blocks that have them."""
        sizes = np.concatenate([[0], np.cumsum(self.chunks.column("n_ids").to_numpy())])
        first, last = np.searchsorted(sizes, start, "right") - 1, np.searchsorted(sizes, start + n)
        found = np.concatenate([np.zeros(0, "<u4"), *(self.block(k) for k in range(first, last))])
        return found[start - sizes[first] : start - sizes[first] + n]

    def each(self) -> Iterator[list[np.ndarray]]:
        """The ids of the documents in turn, each as the parts that lie in successive blocks; a block is decoded once."""
        k, block = -1, np.zeros(0, "<u4")
        for n in self.docs.column("n_ids").to_pylist():
            parts = []
            while n:
                if not len(block):
                    k += 1
                    block = self.block(k)
                parts.append(block[:n])
                n -= len(parts[-1])
                block = block[len(parts[-1]) :]
            yield parts


#: Letters that have one form, whose lower case is one letter, and that the tokenizer takes as parts of words.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[{_LETTER}]+").fullmatch
#: Between such a letter and ASCII that is neither letter nor apostrophe one token always ends and another begins.
_PARTS = re.compile(f"(?<=[{_LETTER}])(?=[\x00-&(-@\\[-`{{-\x7f])|(?<=[\x00-&(-@\\[-`{{-\x7f])(?=[{_LETTER}])").split


#: What a text in lower case must not have for its parts to be such letters and such ASCII alone.
_OTHER = re.compile("[^a-zß-öø-ÿ\\x00-&(-@\\[-`{-\\x7f]").search
_RUNS = re.compile("[a-zß-öø-ÿ]+|[\\x00-\\x1f!-&(-@\\[-`{-\\x7f]+").findall


class Words(dict):
    """The ids of stretches without blanks as little-endian bytes, from the tokenizer where they are not known yet.

    A stretch falls into parts that no token and no normal form reaches across. Parts of plain letters go to the
    tokenizer's model directly, as its normal form and pre-tokenizer leave them whole; all else takes the whole way, as
    does what might hold a special token."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.before: dict[str, bytes] = {}
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, range(256)) if _PLAIN(c)}
        # whether words of plain letters are what the whole way makes of them, for this tokenizer
        self.direct = all(self._whole(w) == self._plain(w.lower()) for w in ("a", "Word", "ÉTÉ", "straße", "nothing" * 9))

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, word: str) -> bytes:
        """The ids of plain letters, in lower case."""
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """The ids of a text. One of plain letters and ASCII falls into its runs of these at once, any other into stretches."""
        low = text.lower()
        plain = self.direct and "<|" not in text and not _OTHER(low)
        return b"".join(map(self.__getitem__, _RUNS(low) if plain else text.split(" ")))

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            if self.direct and word.isalpha() and _PLAIN(word):
                ids = self._plain(word.lower())
            else:
                parts = _PARTS(word) if self.direct and "<|" not in word else [word]
                ids = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else self._whole(word)
        if len(word) < 100:
            if len(self) >= KNOWN_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


_known: dict[str, Words] = {}


def known_words(path: str) -> Words:
    """The words that this worker has met with a tokenizer; one tokenizer at a time."""
    if path not in _known:
        _known.clear()
        _known[path] = Words(path)
    return _known[path]


def encode(docs: DataFrame, tokenizer: str, end_id: int, kind: str, block_ids: int) -> DataFrame:
    """The records of the files, of docs (doc_id, text) in the order of each partition.

    The tokenizer's words never hold white space and its normal form does not reach across it, so a text's ids are those
    of the stretches between its blanks, in turn, or of still smaller parts that no token crosses; a worker asks the
    tokenizer once for each different one."""
    id_type = docs.schema["doc_id"].dataType

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = known_words(tokenizer), np.array([end_id], "<u4").tobytes()
        file = None

        def rows(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
            for x in records:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["record"])

        for b in batches:
            file = file or FileWriter(TaskContext.get().partitionId(), b.schema.field(0).type, block_ids, kind)
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                yield from rows(file.add(part.column(0), [words.ids(t) + last for t in part.column(1).to_pylist()]))
        if file:
            yield from rows(file.close())

    return docs.select(F.col("doc_id").cast(id_type), "text").mapInArrow(written, "record binary")


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, kind: str = "byte", block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> str:
    """Writes the ids of all texts to files below path, in ascending doc_id over all files; returns path.

    A null text counts as empty and has the end id alone; null ids come first, rows with one id are in order of a hash
    of their texts. Repeated rows are written each. An empty table leaves no document. ``tokenizer`` is a file of the
    tokenizers library whose pre-tokenizer parts words at white space.
    """
    if kind not in ("bit", "byte"):
        raise ValueError(f"kind is bit or byte, not {kind}")
    rows = texts(docs, id_col, text_col)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 8), F.lit(0))).first()[0]
    # equal rows are spread over ranges by the partition that they come from
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("part"))
    order = ["doc_id", "hash", "part"]
    ranges = keyed.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)
    records = encode(ranges.select("doc_id", "text"), tokenizer, end_id, kind, block_ids)
    # a record is bytes; as a string Spark writes them as they are
    records.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", 0).option("compression", "none").text(path)
    return path


def read_tokens(spark: SparkSession, path: str, id_type: str = "long", with_ids: bool = True) -> DataFrame:
    """file, place, doc_id, first, n_tokens, ids_crc32 and, if asked for, ids of every document in the files below path.

    file numbers the files in order and place the documents of each; first is the place of a document's first id in its
    file. A file that ends with something else than an index is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                if not len(content.as_buffer()):
                    continue
                file = FileReader(content.as_buffer())
                n = file.docs.column("n_ids").to_numpy()
                first = np.concatenate([[0], np.cumsum(n)])[:-1]
                crc, ids, at = [], [], 0

                def found(at: int, crc: list, ids: list, file: FileReader = file, n: np.ndarray = n, first: np.ndarray = first) -> pa.RecordBatch:
                    size = len(crc)
                    own = [pa.array(ids, pa.list_(pa.int64()))] if with_ids else []
                    return pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(size, file.number)), pa.array(np.arange(at, at + size)), file.docs.column("doc_id").slice(at, size).combine_chunks(),
                            pa.array(first[at : at + size]), pa.array(n[at : at + size]), pa.array(crc, pa.int64()), *own,
                        ],
                        ["file", "place", "doc_id", "first", "n_tokens", "ids_crc32", *["ids"] * with_ids],
                    )

                for parts in file.each():
                    c = 0
                    for p in parts:
                        c = zlib.crc32(p.tobytes(), c)
                    crc.append(c)
                    if with_ids:
                        ids.append(np.concatenate([np.zeros(0, "<u4"), *parts]).astype(np.int64))
                    if len(crc) == 2000:
                        yield found(at, crc, ids)
                        at, crc, ids = at + len(crc), [], []
                if crc:
                    yield found(at, crc, ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(read, f"file long, place long, doc_id {id_type}, first long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files below path; start counts the ids of all documents
    before it. The sums before each file are a window over one row a file."""
    found = read_tokens(spark, path, id_type, with_ids=False)
    before = W.orderBy("of_file").rowsBetween(W.unboundedPreceding, -1)
    sums = found.groupBy(F.col("file").alias("of_file")).agg(F.sum("n_tokens").alias("n")).select("of_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return found.join(sums, F.col("file") == F.col("of_file")).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def tokens_to_files(docs: DataFrame, tokenizer: str, end_id: int = 2, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per row of docs, read back from the files that its ids are written to in the shared
    folder."""
    path = write_tokens(docs, tokenizer, fresh_path(docs.sparkSession, "tokens"), end_id, kind, id_col=id_col, text_col=text_col)
    return token_index(docs.sparkSession, path, docs.schema[id_col].dataType.simpleString())
