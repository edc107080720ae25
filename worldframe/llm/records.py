"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record is a frame: the payload's length (8 bytes), that length's masked checksum (4), the payload, its masked checksum (4) and a
newline, which the text sink writes. The payload is the document id (8 bytes, signed), flags (1: the id is null, 2: ids of 4 bytes) and the
ids, 2 bytes each while the vocabulary has at most 65,536 of them. All numbers are little-endian. A checksum is a crc32, rotated right by 15 bits plus
0xA282EAD8, so that checksums of data that hold checksums stay apart.

write() deals documents over tasks by ranges of their ids, and each task encodes its rows in ascending order into files of about FILE_BYTES: the files
in the order of tasks and pieces are the corpus in order. Spark's own sink writes and commits them, so a lost task leaves nothing behind, in any
store that Spark writes. The index is made from the files themselves: `files` says where in the corpus a file begins, `records` where in a file each document stands.
read() goes through whole files; fetch() reads wanted documents alone, through the index.

Null and empty texts hold the end id alone. Rows without an id come first. Rows of one id are in the order of a hash of the text. Texts of any length
are one record. An empty table gives an empty folder and empty results. Other columns of the input are not read, whatever their names.
"""

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worldframe.llm.common import as_bytes, parts, trim

FILE_BYTES = 8 << 20
#: Tasks whose files are summed in one group on the way to a file's place in the corpus.
SPAN = 256
#: Files up to which their places are broadcast, about 100 bytes each; beyond, contents are shuffled to them.
SMALL_INDEX = 300_000
#: Known units from which on they are forgotten.
CACHE = 400_000
#: Units encoded in one text.
LOT = 200
_HEAD, _PAYLOAD = "<QI", "<qB"
#: Bytes of a frame besides the ids.
_BESIDE = 12 + 9 + 4 + 1
#: White space that is no single byte, and controls that some engines take for white space: such texts are encoded whole.
_OTHER_WHITE = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[32, *range(9, 14)]] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2
_KIND[[b for b in range(128) if chr(b).isalpha()]] = 3


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    payload = struct.pack(_PAYLOAD, doc_id or 0, (doc_id is None) + 2 * wide) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload)), b"\n"))


def frames(content: bytes | memoryview) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(offset, document id, ids) of the records in content; a wrong checksum is an error."""
    at = 0
    while at < len(content):
        size, check = struct.unpack_from(_HEAD, content, at)
        if masked(content[at : at + 8]) != check:
            raise ValueError(f"length at byte {at} is damaged")
        payload = content[at + 12 : at + 12 + size]
        if len(payload) != size or masked(payload) != struct.unpack_from("<I", content, at + 12 + size)[0]:
            raise ValueError(f"record at byte {at} is damaged")
        doc_id, flags = struct.unpack_from(_PAYLOAD, payload)
        yield at, None if flags & 1 else doc_id, np.frombuffer(payload, dtype="<u4" if flags & 2 else "<u2", offset=9)
        at += size + 17


class ByteEncoder:
    """ids of whole texts of a byte-level tokenizer that splits at white space: distinct units reach the tokenizer once.

    A unit is white space and what follows it, cut once more where an ASCII letter meets a stop. No pre-token of such a tokenizer spans these
    places, and it looks ahead at white space only, so a unit has the same ids alone as in its text. Probes check that for the given file; if they
    fail, and for texts with added tokens or other white space, whole texts are encoded.
    """

    PROBES = ("it's a  b\n\n c\t\td. 'll they'll (x) [y]", "a\n", "  \n lead", "x1 2y 3.4,5 don't!'s", "é ü\r\nñ", " \t ")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.line = self._ids("\n")[0]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()
        self.by_unit = True
        for p in self.PROBES:
            self.by_unit &= self._units(pa.array([p], pa.large_string()))[0].tolist() == self._ids(p)

    def _forget(self) -> None:
        self.units, self.ids, self.bound = pa.array([], pa.large_binary()), np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units in a row and each unit's number of ids: many in one text, parted by new lines, which stand in none of them."""
        lots = [units[at : at + LOT] for at in range(0, len(units), LOT)]
        found = [np.array([*e.ids, self.line], dtype="<u4") for e in self.tokenizer.encode_batch_fast(["\n".join(x) for x in lots], add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, dtype="<u4"), *found])
        ends = np.flatnonzero(flat == self.line)
        if len(ends) != len(units):  # another tokenizer
            single = [np.array(self._ids(u), dtype="<u4") for u in units]
            return np.concatenate(single), np.array([len(x) for x in single])
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def _learn(self, new: pa.Array) -> None:
        text = new.cast(pa.large_string())
        simple = pc.match_substring_regex(text, r"^ ?[^ \t\n\v\f\r]+$")
        other = [self._ids(u) for u in text.filter(pc.invert(simple)).to_pylist()]
        ids, sizes = self._joined(text.filter(simple).to_pylist())
        self.units = pa.concat_arrays([self.units, new.filter(simple), new.filter(pc.invert(simple))])
        self.ids = np.concatenate([self.ids, ids, np.fromiter((i for x in other for i in x), dtype="<u4")])
        self.bound = np.concatenate([self.bound, self.bound[-1] + np.cumsum([*sizes.tolist(), *(len(x) for x in other)], dtype=np.int64)])

    def _units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and the texts' bounds there."""
        data, bounds = as_bytes(texts)
        kind = _KIND[data]
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = ((kind[1:] == 1) & (kind[:-1] != 1)) | ((kind[1:] == 2) & (kind[:-1] == 3))
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        start = np.append(np.flatnonzero(begins), len(data))
        units = pa.Array.from_buffers(pa.large_binary(), len(start) - 1, [None, pa.py_buffer(start.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        if len(self.units) > CACHE:
            self._forget()
        self._learn(coded.dictionary.filter(pc.is_null(pc.index_in(coded.dictionary, value_set=self.units))))
        known = pc.index_in(coded.dictionary, value_set=self.units).to_numpy(zero_copy_only=False)
        unit = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, dtype=np.int64)
        size = np.diff(self.bound)[unit]
        total = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(int(total[-1]), dtype="<u4")
        for lo in range(0, len(unit), 500_000):
            n, first = size[lo : lo + 500_000], total[lo : lo + 500_000][: len(unit) - lo]
            out[first[0] : first[0] + n.sum()] = self.ids[np.repeat(self.bound[unit[lo : lo + len(n)]] - first, n) + np.arange(first[0], first[0] + n.sum())]
        return out, total[np.searchsorted(start, bounds)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, _OTHER_WHITE) if self.by_unit else pa.array([True] * len(texts))
        for t in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, t))
        plain = np.flatnonzero(~np.asarray(whole.to_numpy(zero_copy_only=False), dtype=bool))
        out: list[np.ndarray | None] = [None] * len(texts)
        ids, bounds = self._units(texts.take(pa.array(plain)))
        for i, lo, hi in zip(plain.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = ids[lo:hi]
        return [np.array(self._ids(t.as_py()), dtype="<u4") if x is None else x for x, t in zip(out, texts, strict=True)]


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 0, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The records of all documents in `path`/data and their index in `path`/files and `path`/records; path must be one that executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(tokenizer)
        written, row = 0, 0
        for batch in batches:
            for lo, n in parts(batch.column(2)):
                part = batch.slice(lo, n)
                made = [frame(i, np.append(ids, np.array(end, dtype="<u4")), encoder.wide) for i, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(2)), strict=True)]
                upto = written + np.cumsum([len(x) for x in made])
                piece = (upto - [len(x) for x in made]) // file_bytes
                # The newline is the sink's.
                arrays = [pa.array(piece, pa.int32()), pa.array(row + np.arange(n), pa.int64()), pa.array([x[:-1] for x in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["piece", "row", "frame"])
                written, row = int(upto[-1]), row + n
        del encoder
        trim()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").mapInArrow(run, "piece int, row long, frame binary")
    # Rows come in this order; told so, the sink does not sort them by piece alone.
    ordered = made.sortWithinPartitions("piece", "row").select("piece", F.col("frame").cast("string").alias("value"))
    ordered.write.partitionBy("piece").option("lineSep", "\n").text(f"{path}/data")
    _index(docs.sparkSession, path)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """file (below `path`/data), task, piece, content of the data files, none if nothing was written."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/data")
    except Exception as e:
        raise FileNotFoundError(f"no records in {path}") from e
    file = F.regexp_extract("path", "/data/(.*)$", 1)
    return found.select(file.alias("file"), F.regexp_extract(file, r"part-(\d+)", 1).cast("long").alias("task"), F.regexp_extract(file, r"piece=(\d+)", 1).cast("long").alias("piece"), "content")


def _index(spark: SparkSession, path: str) -> None:
    """`path`/records: file, offset, bytes, doc_id, start, n of each record; `path`/files: file, base and records of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = [(at, _BESIDE + ids.nbytes, doc, len(ids)) for at, doc, ids in frames(batch.column(3)[i].as_buffer().to_pybytes())]
                at, size, doc, n = zip(*rows, strict=True)
                before = np.cumsum(n) - np.array(n)
                same = [batch.column(j).take(pa.array([i] * len(rows))) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(x, pa.int64()) for x in (at, size, doc, before, n))], names=["file", "task", "piece", "offset", "bytes", "doc_id", "before", "n"])

    kinds = "file string, task long, piece long, offset long, bytes long, doc_id long, before long, n long"
    _contents(spark, path).mapInArrow(run, kinds).write.parquet(f"{path}/scanned")
    scanned = spark.read.schema(kinds).parquet(f"{path}/scanned")
    files = scanned.groupBy("file", "task", "piece").agg(F.sum("n").alias("n"), F.count("*").alias("records")).withColumn("span", F.floor(F.col("task") / SPAN))
    spans = files.groupBy("span").agg(F.sum("n").alias("n"))
    before = spans.select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("span_base"))
    within = F.sum("n").over(Window.partitionBy("span").orderBy("task", "piece")) - F.col("n")
    placed = files.withColumn("within", within).join(before, "span")
    placed.select("file", (F.col("span_base") + F.col("within")).alias("base"), "records", F.col("n").alias("ids")).write.parquet(f"{path}/files")
    files = spark.read.schema("file string, base long, records long, ids long").parquet(f"{path}/files")
    scanned.join(files.select("file", "base"), "file").select("file", "offset", "bytes", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n").write.parquet(f"{path}/records")


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, offset, bytes, start, n of every record."""
    return spark.read.schema("file string, offset long, bytes long, doc_id long, start long, n long").parquet(f"{path}/records")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (unsigned 32-bit, little-endian) of every record, whole files at a time, checksums verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(doc, ids) for _, doc, ids in frames(content.as_buffer().to_pybytes())]
                doc, ids = zip(*rows, strict=True)
                n = np.array([len(x) for x in ids])
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(base + np.cumsum(n) - n, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "start", "ids"])
        trim()

    files = spark.read.schema("file string, base long, records long, ids long").parquet(f"{path}/files").select("file", "base")
    files = F.broadcast(files) if files.count() <= SMALL_INDEX else files
    return _contents(spark, path).join(files, "file").select("base", "content").mapInArrow(run, "doc_id long, start long, ids binary")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, start, ids of the records of wanted (doc_id, any order): a file's wanted offsets are read from it, nothing else is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = content.as_buffer().to_pybytes()
                rows = [(doc, p["start"], ids) for p in places for _, doc, ids in frames(data[p["offset"] : p["offset"] + p["bytes"]])]
                doc, start, ids = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "start", "ids"])
        trim()

    found = index(spark, path).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    # A file's places: as many as it has records at most.
    places = found.groupBy("file").agg(F.collect_list(F.struct("offset", "bytes", "start")).alias("places"))
    return _contents(spark, path).join(places, "file").select("content", "places").mapInArrow(run, "doc_id long, start long, ids binary")


def digest(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of records that were read."""
    return read_back.select("doc_id", "start", F.floor(F.length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
