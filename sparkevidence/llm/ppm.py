"""Language-model scoring by prediction by partial matching over bytes (operator 12).

A document is coded as its lower-cased words, a space after each, then an end symbol. The trie of byte contexts is a table of
(context, symbol, count) over all training documents, so it grows with the corpus. A symbol is coded in its longest context; a symbol
that was not seen there costs an escape (method C: as many escapes as distinct symbols), and shorter contexts leave out the symbols
that longer ones have seen. Documents lie in blocks of bounded bytes: a block asks for its distinct contexts and words once, so texts
are shuffled once and what is sent for the model is far less than one row for each byte.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkevidence.llm.shared import dropped, saved, small_batches, text_or_empty

#: Bytes of context; up to 6.
ORDER = 4
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 24 << 20
#: Rows of the trie that one group takes.
TRIE_ROWS = 1 << 18
#: Symbols: all byte values except ASCII white space; of these the space ends words and the line feed ends documents.
SYMBOLS = 252
END = b"\n"
U = np.uint64


def words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased: bytes between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def coded(parts: list[bytes], order: int) -> np.ndarray:
    """For each symbol of a document, its context of so many bytes and the symbol itself, as one integer."""
    data = np.frombuffer(END * order + b"".join([p + b" " for p in parts]) + END, np.uint8)
    n = len(data) - order
    out = data[:n].astype(U)
    for j in range(1, order + 1):
        out = (out << U(8)) | data[j : j + n]
    return out.view(np.int64)


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids = []
            for n in pc.binary_length(batch["text"]).to_pylist():
                if size and size + n > most:
                    block, size = block + 1, 0
                size += n
                ids.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *batch.columns], names=["block", *batch.schema.names])

    return run


class Gathered:
    """Distinct codes and words of a block, and how often training documents have them."""

    def __init__(self) -> None:
        self.raw: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.folded: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: Counter[bytes] = Counter()
        self.waiting = 0

    def add(self, parts: list[bytes], codes: np.ndarray, learn: bool) -> None:
        self.raw[learn].append(codes)
        self.waiting += len(codes)
        if learn:
            self.words.update(parts)
            self.words[END] += 1
        else:
            self.words.update(dict.fromkeys([*parts, END], 0))
        if self.waiting > 1 << 21:
            self.fold()

    def fold(self) -> None:
        for learn, raw in self.raw.items():
            if raw:
                codes, n = np.unique(np.concatenate(raw), return_counts=True)
                self.folded.append((codes, n if learn else np.zeros(len(n), np.int64)))
                raw.clear()
        self.waiting = 0

    def batch(self, block: int) -> pa.RecordBatch:
        self.fold()
        codes, n, _ = _sums(np.concatenate([c for c, _ in self.folded]), np.concatenate([n for _, n in self.folded]))
        k, m = len(codes), len(self.words)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k + m, block)), pa.array(np.concatenate([codes, np.zeros(m, np.int64)]), mask=np.arange(k + m) >= k), pa.array([None] * k + list(self.words), pa.binary()), pa.array(np.concatenate([n.astype(np.int64), np.fromiter(self.words.values(), np.int64, m)]))],
            names=["block", "code", "word", "n"],
        )


def _asked(order: int):
    """(block, code, word, n): what each block's documents hold; either code or word is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, got = None, Gathered()
        for batch in batches:
            for b, learn, text in zip(batch["block"].to_pylist(), batch["learn"].to_pylist(), batch["text"]):
                if b != block and block is not None:
                    yield got.batch(block)
                    got = Gathered()
                block, parts = b, words(text.as_py())
                got.add(parts, coded(parts, order), learn)
        if block is not None:
            yield got.batch(block)

    return run


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of n for each, and the place of each given key."""
    flat, at = np.unique(keys, return_inverse=True)
    return flat, np.bincount(at, n, len(flat)), at


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table that holds them all."""
    return np.searchsorted(table, keys)


def probabilities(code: np.ndarray, n: np.ndarray, order: int, short: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each (context, symbol), given the counts of all rows whose contexts end in the same two bytes.

    short: (code, n) of all contexts of one byte. A shorter context has seen all that a longer one has, so what longer contexts leave
    out at a level is what the next longer one has seen.
    """
    levels = []  # for each level: codes, counts, contexts, their totals, their numbers of distinct symbols
    for k in range(order, -1, -1):
        keys, counts = (code, n) if k >= 2 else short
        keys, counts, _ = _sums(keys & ((1 << 8 * (k + 1)) - 1), counts)
        keys, counts = keys[counts > 0], counts[counts > 0]
        contexts, totals, at = _sums(keys >> 8, counts)
        levels.append((keys, counts, contexts, totals, np.bincount(at, minlength=len(contexts))))
    out = np.zeros(len(code))
    open_ = np.ones(len(code), bool)
    below = None  # the level before
    for k, (keys, counts, contexts, totals, distinct) in zip(range(order, -1, -1), levels):
        if not open_.any():
            return out
        if not len(keys):
            continue  # below stays: nothing was seen in longer contexts either
        own = (code & ((1 << 8 * (k + 1)) - 1))[open_]
        at = np.minimum(_find(contexts, own >> 8), len(contexts) - 1)
        known = contexts[at] == own >> 8
        total, q = totals[at] * known, distinct[at] * known
        if below is not None:
            longer, b_contexts, b_distinct = below
            # counts at this level of the symbols that each longer context has seen
            left_out = np.bincount(_find(b_contexts, longer >> 8), counts[_find(keys, longer & ((1 << 8 * (k + 1)) - 1))], len(b_contexts))
            up = (code & ((1 << 8 * (k + 2)) - 1))[open_] >> 8
            b = np.minimum(_find(b_contexts, up), len(b_contexts) - 1)
            was = b_contexts[b] == up
            total, q = total - left_out[b] * was, q - b_distinct[b] * was
        hit_at = np.minimum(_find(keys, own), len(keys) - 1)
        hit = keys[hit_at] == own
        places = np.flatnonzero(open_)
        with np.errstate(divide="ignore", invalid="ignore"):
            here = np.where(hit, counts[hit_at], q) / (total + q)
            out[places] += np.where(q > 0, np.log10(here), 0.0)
        open_[places[hit]] = False
        below = (keys, contexts, distinct)
    if open_.any():
        _, _, _, _, distinct = levels[-1]
        out[open_] -= np.log10(SYMBOLS - (distinct[0] if len(distinct) else 0))
    return out


def _predicted(order: int, short: tuple[np.ndarray, np.ndarray]):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        code, n = rows["code"].to_numpy(), rows["n"].to_numpy()
        return pa.table({"code": rows["code"], "value": pa.array(probabilities(code, n, order, short))})

    return run


def _scored(order: int):
    def run(docs: pa.Table, model: pa.Table) -> pa.Table:
        is_code = pc.is_valid(model["code"])
        grams = model.filter(is_code)
        codes, values = grams["code"].to_numpy(), grams["value"].to_numpy()
        by_code = np.argsort(codes)
        codes, values = codes[by_code], values[by_code]
        own = model.filter(pc.invert(is_code))
        base = {w: (v, c > 0) for w, v, c in zip(own["word"].to_pylist(), own["value"].to_pylist(), own["n"].to_pylist())}
        tokens, known, base_score, score = [], [], [], []
        for text in docs["text"]:
            parts = words(text.as_py())
            total = 0.0
            c = coded(parts, order)
            for a in range(0, len(c), 1 << 20):
                total += float(values[_find(codes, c[a : a + (1 << 20)])].sum())
            parts.append(END)
            found = [(n, *base[w]) for w, n in Counter(parts).items()]
            tokens.append(len(parts))
            known.append(sum(n for n, _, k in found if k))
            base_score.append(sum(n * v for n, v, _ in found))
            score.append(total)
        long = partial(pa.array, type=pa.int64())
        return pa.table({"doc_id": docs["doc_id"], "held_out": pc.invert(docs["learn"]), "n_tokens": long(tokens), "n_known": long(known), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def score(docs: DataFrame, order: int = ORDER, block: int = BLOCK, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    Documents whose crc32(doc_id as text) leaves 1 when divided by 5 are held out; the model learns from all others. base_score is that of
    smoothed word counts, score that of the model: log10 of the probability of all symbols of the text. The trie's rows are grouped by
    the last two bytes of their contexts, so each group has all of its longer contexts; contexts of one byte and of none, at most
    256 * 256 counts, go to every task.
    Nulls: a null text is empty (its end symbol alone is coded); a null doc_id counts as empty text for the remainder and stays null.
    Rows that repeat a doc_id or a text are documents of their own, learned as often as they are there. Long texts are coded whole and
    alone in their block. Other columns of docs are not looked at. Without training documents all symbols are equally likely. Empty
    tables give an empty result.
    """
    if not 2 <= order <= 6:
        raise ValueError("order has to lie between 2 and 6")
    spark = docs.sparkSession
    small_batches(spark)
    learn = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1).alias("learn")
    rows = docs.select("doc_id", learn, text_or_empty().alias("text"))
    rows = saved(rows.mapInArrow(_blocks(block), "block long, doc_id long, learn boolean, text string"), "blocks", "zstd")
    asked = saved(rows.mapInArrow(_asked(order), "block long, code long, word binary, n long"), "asked")
    # Words: counts over all training documents, and the smoothed probability of each. A word has a row for each block.
    by = Window.partitionBy("word")
    known = asked.where("word is not null").select("block", "word", F.sum("n").over(by).alias("n"), (F.row_number().over(by.orderBy("block")) == 1).alias("first"))
    known = saved(known, "words")
    size = known.where("first and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    share = F.log10((F.col("n") + 0.5) / (size["n"] + 0.5 * (size["v"] + 1)))
    by_word = known.select("block", F.lit(None).cast("long").alias("code"), "word", "n", share.alias("value"))
    # Codes: counts of all contexts, then the probability of each symbol that any document has in one.
    trie = saved(asked.where("code is not null").groupBy("code").agg(F.sum("n").alias("n")), "trie")
    short = trie.groupBy(F.col("code").bitwiseAND(0xFFFF).alias("code")).agg(F.sum("n").alias("n")).toPandas()
    short = (short["code"].to_numpy(np.int64), short["n"].to_numpy(np.int64))
    groups = max(16, -(-trie.count() // trie_rows))
    group = F.pmod(F.xxhash64(F.shiftright("code", 8).bitwiseAND(0xFFFF)), F.lit(groups)).alias("group")
    predicted = saved(trie.select(group, "code", "n").groupBy("group").applyInArrow(_predicted(order, short), "code long, value double"), "predicted")
    by_code = asked.where("code is not null").select("block", "code").join(predicted.hint("merge"), "code").select("block", "code", F.lit(None).cast("binary").alias("word"), F.lit(0).cast("long").alias("n"), "value")
    model = by_word.unionByName(by_code)
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = rows.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(_scored(order), kind)
    dropped(trie)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(size["n"]).cast("long").alias("train_tokens"), "base_score", "score")
