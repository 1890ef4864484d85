"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids (operator 2)."""

from __future__ import annotations

import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkevidence.llm.shared import new_path, saved, small_batches

END_ID = 1
#: Words whose ids a worker keeps at hand.
KEPT_WORDS = 600_000
#: Marks that a word may end in; a run of them is one piece of the splitter.
_MARKS = b".,;:!?*#$%&|)(\"-"
#: Rows that a file holds about.
FILE_ROWS = 1 << 15
ORC_OPTIONS = {
    "orc.compress": "ZSTD",
    "orc.stripe.size": str(64 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones as themselves, the rest from U+0100 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


if sys.byteorder != "little":
    raise ImportError("ids are written as little-endian integers")


class WordEncoder(dict):
    """Ids of words, as 32-bit integers by UTF-8 bytes; a word is encoded when it is first asked for.

    The tokenizer's normaliser and splitter never join across white space, so a text's ids are those of its words in order. Words of
    Latin characters that are in normal form are split here by the tokenizer's own pattern and their pieces go to its BPE model;
    any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.model = self.tokenizer.model
        self.splitter = regex.compile(config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.plain = regex.compile("[\\x21-\\x7E\u00A1-\u012F\u0131-\u024F]+")
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the splitter, in lower case."""
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= KEPT_WORDS:
                self.pieces.clear()
            letters = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids

    def _word(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isalpha():  # ASCII letters: one piece, and perhaps one of marks after it
            text = core.decode()
        else:
            text = core.decode()
            if b"<|" in word or not self.plain.fullmatch(word.decode()) or not unicodedata.is_normalized("NFC", text):
                return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
            if not text.isalpha():
                return b"".join([self._piece(x) for x in self.splitter.findall(word.decode().lower())])
            text = text.lower()
        return self._piece(text) + self._piece(word[len(core) :].decode()) if len(core) < len(word) else self._piece(text)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self[word] = self._word(word)
        return ids

    def encode(self, text: bytes) -> bytes:
        """A-Z are lower-cased before words are looked up, as the normaliser does anyway, unless the text may hold a special token."""
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


_encoders: dict[str, WordEncoder] = {}


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder, end, done = _encoders[path], np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            held, size, a = [], 0, 0
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                held.append(encoder.encode(text) + end)
                size += len(text)
                if size > 2 << 20 or i == batch.num_rows - 1:
                    at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in held]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(held), "<i4")))
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a : i + 1], pa.array(np.arange(done, done + len(held))), lists], names=["doc_id", "place", "ids"])
                    done += len(held)
                    held, size, a = [], 0, i + 1

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, file_rows: int = FILE_ROWS) -> None:
    """Writes rows (doc_id, place, ids) of docs (doc_id, text) as ORC, files and rows in ascending doc_id order (nulls first), rows of
    one doc_id in order of a hash of their texts; place counts a file's rows. The number of files grows with the table (about
    file_rows rows each; small ones are merged while spark.sql.shuffle.partitions are enough), and rows that repeat a doc_id may lie in several files."""
    spark = docs.sparkSession
    small_batches(spark)
    usual, files = int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // file_rows)
    order = ["doc_id", F.xxhash64("text")]
    spread = docs.select("doc_id", "text").repartitionByRange(*([files] if files > usual else []), *order).sortWithinPartitions(*order)
    encoded = spread.mapInArrow(_encoded(tokenizer or word_tokenizer(), end_id), "doc_id long, place long, ids array<int>")
    encoded.write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows of written tokens; ids or a range of ids are pushed down to ORC's file, stripe and row-group statistics and Bloom filters."""
    out = spark.read.schema("doc_id long, place long, ids array<int>").orc(path)
    if doc_ids is not None:
        out = out.where(F.col("doc_id").isin(doc_ids))
    if least is not None:
        out = out.where(F.col("doc_id") >= least)
    return out if most is None else out.where(F.col("doc_id") <= most)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        at = np.asarray(ids.offsets).astype(np.int64)
        raw = memoryview(np.ascontiguousarray(np.asarray(ids.values), "<i4").view(np.uint8))
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(1), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "file", "place", "n_tokens", "ids_crc32"])


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of written tokens, from the files.

    start counts the ids of all rows before in the files: totals of whole files are summed first, then rows within a file, in the order
    in which they lie there. Files hold ascending ranges of doc_id, numbered in that order, so neither step gathers more than a file's rows
    or one row per file. An empty table gives an empty result.
    """
    small_batches(spark)
    rows = read_tokens(spark, path).select("doc_id", "place", "ids", F.col("_metadata.file_path").alias("file"))
    rows = saved(rows.mapInArrow(_checked, "doc_id long, file string, place long, n_tokens long, ids_crc32 long"), "token-rows")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = F.coalesce(F.sum("total").over(Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = files.select("file", before.alias("before"))
    within = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return rows.join(offsets, "file").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame) -> DataFrame:
    """Writes the tokens of docs (doc_id, text) to the shared folder and reports on the files read back.

    A null or empty text has only the end id; a null doc_id comes first; rows that repeat a doc_id are rows of their own; texts of any
    length are encoded whole; other columns of docs are not looked at; an empty table gives an empty result.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return token_report(docs.sparkSession, path)
