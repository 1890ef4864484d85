"""Spelling variants by Bloom-guided neighbourhoods (operator 13).

Each word's deletions and replacements are generated as hashes, without making the strings, and probed against blocked Bloom filters,
one for each word length, that are broadcast. Only positives are shuffled to the vocabulary, where the exact strings are compared, so
false positives go. Insertions are the deletions of the longer word. A vocabulary that needs more filter bits than the bound is split by
hash into rounds, each with a filter within the bound.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkevidence.llm.hashing import BASE, BYTE_CODES, U, mix
from sparkevidence.llm.shared import dropped, saved, small_batches, text_or_empty

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Fixed values of the contract.
ODD, SHORTEST, LEAST, TIMES = 97, 5, 3, 2
#: Code points of words, all of one byte in Latin-1.
ALPHABET = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint8)
#: A filter has blocks of 512 bits, so many bits for each word, of which a word sets PROBES; all filters of a round have at most FILTER_BYTES.
BITS, PROBES, FILTER_BYTES = 16, 6, 32 << 20
#: Distinct words that a task holds before it passes their counts on, and edits that it generates at once.
HELD, EDITS = 1 << 19, 1 << 20
_INVERSE = U(pow(BASE, -1, 1 << 64))


def changed(doc_id: int | None, run: str) -> str:
    """A lower-cased run as this document has it: where 97 divides the crc32 of id and run, one code point is deleted."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % ODD:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): partial counts, passed on whenever many distinct words are held."""
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            for run, n in Counter(RUN.findall(text.as_py().translate(LOWER))).items():
                word = changed(doc_id, run)
                if len(word) >= SHORTEST:
                    held[word] += n
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n): words of at least five code points and at least so many occurrences over all documents."""
    counts = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, U(BASE))
    out[:1] = 1
    return np.multiply.accumulate(out)


def _finished(h: np.ndarray, length: int) -> np.ndarray:
    """Keys of polynomial hashes of words of one length."""
    return mix(h ^ U((length * BASE) & ((1 << 64) - 1)))


def hashes(letters: np.ndarray) -> np.ndarray:
    """Hashes of words of one length, a row of letters for each."""
    return (BYTE_CODES[letters] * _powers(letters.shape[1])).sum(axis=1, dtype=U)


def edits(letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, place, letter, key, length) of each deletion (letter 0) and each replacement by a greater code point, a few words at a time."""
    m, length = letters.shape
    weights = _powers(length)
    terms = BYTE_CODES[letters] * weights
    before = np.cumsum(terms, axis=1, dtype=U)
    whole = before[:, -1:]
    shorter = (before - terms) + (whole - before) * _INVERSE
    row, at = np.divmod(np.arange(m * length), length)
    yield row, at, np.zeros(m * length, np.uint8), _finished(shorter.ravel(), length - 1), length - 1
    step = max(1, EDITS // (len(ALPHABET) * length))
    wide = max(1, EDITS // len(ALPHABET))
    for a in range(0, m, step):
        for b in range(0, length, wide):
            old = letters[a : a + step, b : b + wide]
            r, p, c = np.nonzero(ALPHABET[None, None, :] > old[:, :, None])
            key = whole[a + r, 0] + (BYTE_CODES[ALPHABET[c]] - BYTE_CODES[old[r, p]]) * weights[b + p]
            yield a + r, b + p, ALPHABET[c], _finished(key, length), length


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, and their letters."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        for a in range(0, len(at), step := max(1, EDITS // int(length))):
            part = at[a : a + step]
            yield part, np.frombuffer("".join([words[i] for i in part]).encode("latin-1"), np.uint8).reshape(len(part), length)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds key (of the word) and length."""
    for batch in batches:
        words = batch["word"].to_pylist()
        keys, lengths = np.zeros(len(words), U), np.zeros(len(words), np.int32)
        for at, letters in _by_length(words):
            keys[at], lengths[at] = _finished(hashes(letters), letters.shape[1]), letters.shape[1]
        yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(keys.view(np.int64)), pa.array(lengths)], names=["word", "n", "key", "length"])


def _round(key: np.ndarray, rounds: int) -> np.ndarray:
    return (key >> U(48)) % U(rounds)


def _probe_bits(key: np.ndarray) -> np.ndarray:
    return mix(key ^ U(BASE))


class Filter:
    """Blocked Bloom filters of the words of one round, one for each length: 64-bit words, eight to a block."""

    def __init__(self, blocks: dict[int, int]) -> None:
        self.blocks, self.start, at = blocks, {}, 0
        for length in sorted(blocks):
            self.start[length], at = at, at + blocks[length]
        self.bits = np.zeros(at * 8, U)

    def holds(self, key: np.ndarray, length: int) -> np.ndarray:
        """Places of the keys that may be words of this length."""
        if length not in self.blocks:
            return np.zeros(0, np.int64)
        at = np.arange(len(key))
        block = (self.start[length] + ((key & U(0xFFFFFFFF)) % U(self.blocks[length])).astype(np.int64)) * 8
        bits = _probe_bits(key)
        for j in range(PROBES):
            bit = (bits >> U(9 * j)) & U(511)
            hit = (self.bits[block + (bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == 1
            at, block, bits = at[hit], block[hit], bits[hit]
        return at


def _lines(blocks: dict[int, int], start: dict[int, int], rounds: int, this: int):
    """(line, bits): for each word of this round the 64-bit words of the filter that it sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, length = batch["key"].to_numpy().view(U), batch["length"].to_numpy()
            own = _round(key, rounds) == this
            key, length = key[own], length[own]
            first = np.array([start[x] for x in length.tolist()], np.int64)
            size = np.array([blocks[x] for x in length.tolist()], U)
            block = (first + ((key & U(0xFFFFFFFF)) % np.maximum(size, U(1))).astype(np.int64)) * 8
            bits = _probe_bits(key)
            lines, values = [], []
            for j in range(PROBES):
                bit = (bits >> U(9 * j)) & U(511)
                lines.append(block + (bit >> U(6)).astype(np.int64))
                values.append(U(1) << (bit & U(63)))
            lines, values = np.concatenate(lines), np.concatenate(values)
            flat, at = np.unique(lines, return_inverse=True)
            merged = np.zeros(len(flat), U)
            np.bitwise_or.at(merged, at, values)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(merged.view(np.int64))], names=["line", "bits"])

    return run


def _filter(words: DataFrame, counts: dict[int, int], rounds: int, this: int) -> Filter:
    """The filter of one round: tasks make its lines, Spark unites them, the driver gets the lines of one filter within its bound."""
    out = Filter({length: max(1, -(-n * BITS // (512 * rounds))) for length, n in counts.items()})
    lines = words.select("key", "length").mapInArrow(_lines(out.blocks, out.start, rounds, this), "line long, bits long")
    table = lines.groupBy("line").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.bits[table["line"].to_numpy()] = table["bits"].to_numpy().view(U)
    return out


def _positives(shared, rounds: int, this: int):
    """(word, n, at, letter, key, length) of each edit that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for batch in batches:
            words, n = batch["word"].to_pylist(), batch["n"].to_numpy()
            for own, letters in _by_length(words):
                for row, at, letter, key, length in edits(letters):
                    if rounds > 1:
                        here = np.flatnonzero(_round(key, rounds) == this)
                        row, at, letter, key = row[here], at[here], letter[here], key[here]
                    hit = bloom.holds(key, length)
                    for a in range(0, len(hit), step := max(1, (8 << 20) // letters.shape[1])):
                        h = hit[a : a + step]
                        w = own[row[h]]
                        yield pa.RecordBatch.from_arrays([batch["word"].take(pa.array(w)), pa.array(n[w]), pa.array(at[h].astype(np.int32)), pa.array(letter[h].astype(np.int32)), pa.array(key[h].view(np.int64)), pa.array(np.full(len(h), length, np.int32))], names=["word", "n", "at", "letter", "key", "length"])

    return run


def _edited(word: Column, at: Column, letter: Column) -> Column:
    """The word with the code point at a place deleted (letter 0) or replaced."""
    return F.concat(F.substring(word, F.lit(1), at), F.when(letter == 0, F.lit("")).otherwise(F.chr(letter)), F.substring(word, at + 2, F.length(word)))


def near(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n), both ways, of all pairs of words that differ by one inserted, deleted or replaced code point; words: a
    written table (word, n, key, length)."""
    spark = words.sparkSession
    counts = {r["length"]: r["count"] for r in words.groupBy("length").count().collect()}  # lengths of words, not words
    rounds = max(1, -(-sum(counts.values()) * BITS // (8 * filter_bytes)))
    found = None
    for this in range(rounds):
        shared = spark.sparkContext.broadcast(_filter(words, counts, rounds, this))
        part = saved(words.select("word", "n").mapInArrow(_positives(shared, rounds, this), "word string, n long, at int, letter int, key long, length int"), "positives")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    exact = words.select("key", "length", F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = found.join(exact.hint("merge"), ["key", "length"]).where(F.col("other") == _edited(F.col("word"), F.col("at"), F.col("letter")))
    pairs = pairs.select("word", "n", "other", "other_n").distinct()
    return pairs.union(pairs.select("other", "other_n", "word", "n"))


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of docs (doc_id, text).

    Words are runs of Latin letters of five code points or more that occur often enough; a form is the most frequent word one code point
    away, if it is frequent enough; root follows forms to the last. A word has at most 90 * (2 * length + 1) near words, so no group
    grows with the corpus; chains at least double n at each step, so they are short.
    Nulls: a null text has no words; a null doc_id is empty text in the hash. Rows that repeat a doc_id or a text count as often as they
    are there. Long texts and long runs are taken whole. Other columns of docs are not looked at. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words = saved(vocabulary(docs, least).mapInArrow(_hashed, "word string, n long, key long, length int"), "vocabulary")
    best = near(words, filter_bytes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    told = words.select("word", "n").join(best.hint("merge"), "word", "left")
    formed = -F.col("best.less") >= times * F.col("n")
    told = saved(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "forms")
    # Pointers that jump twice as far at each step, until none leads to a word that has a form.
    step = told.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        jump = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step, old = saved(step.join(jump.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots"), step
        if not step.where("moved").limit(1).count():
            break
        step = step.select("word", "root")
    roots = step.select("word", "root")
    out = told.join(roots.hint("merge"), "word", "left")
    dropped(words)
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = """
    WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS r FROM documents),
    low AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM runs GROUP BY 1, 2),
    b AS (SELECT r, n, flatten(list_transform(string_split(concat(doc_id, ':', r), ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)) AS bytes FROM low),
    h AS (SELECT r, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, y: xor(a >> 1, 3988292384 * (a & 1))))) AS h FROM b),
    w AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
    cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
    pairs AS (SELECT cut.word AS a, cut.n AS an, w.word AS b, w.n AS bn FROM cut JOIN w ON cut.short = w.word UNION SELECT w.word, w.n, cut.word, cut.n FROM cut JOIN w ON cut.short = w.word
        UNION SELECT x.word, x.n, y.word, y.n FROM cut x JOIN cut y ON x.short = y.short AND x.i = y.i AND x.word <> y.word),
    best AS (SELECT a, count(*) AS n_near, first(b ORDER BY bn DESC, b) AS b, max(bn) AS bn FROM pairs GROUP BY 1),
    forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * n THEN b END AS form, CASE WHEN bn >= 2 * n THEN bn END AS form_n FROM w LEFT JOIN best ON word = a),
    walk AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT walk.word, walk.next, forms.form FROM walk JOIN forms ON forms.word = walk.next)
    SELECT forms.word, form, walk.at AS root, n, n_near, form_n FROM forms JOIN walk ON walk.word = forms.word AND walk.next IS NULL
"""
