"""Exact removal of repeated substrings with per-shard suffix arrays (operator 5).

Strings are judged in two alphabets: windows of `length` bytes, and passages of so many words. Every window has an anchor: its least
hashed gram of k symbols, the leftmost on ties. Equal windows have equal anchors at equal offsets, so only windows of one anchor can
be equal. A run of windows that share an anchor occurrence is a context: the symbols from the first window's start to the last one's
end. All windows of a context hold its anchor, so what repeats of it is one range. Copies of a context are told by a hash and stand
in the suffix arrays once; a context that occurs twice is repeated as a whole. In text that repeats itself one context holds several
occurrences of its anchor, so its windows can be equal to each other: it is looked at even if its anchor has no other context.

Contexts of an anchor with several different ones are dealt to shards of a fixed size. Each shard sorts the suffixes of its contexts by
Larsson-Sadakane refinement, takes Kasai common prefixes and reports windows equal to a neighbour. Where an anchor has more contexts
than one shard takes, its shards are merged: each sends its distinct windows as a sorted run of 128-bit hashes, cut by binary search
at the bounds of key ranges; the runs of one range meet in one task, which finds by binary search what several of them hold, and
sends it back. What is shipped grows with the contexts, and no pairs of contexts or shards are formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkevidence.llm.hashing import BASE, BASE2, SEPARATOR, U, Rolling, mix
from sparkevidence.llm.shared import arrow_bytes, dropped, saved, slices, small_batches, text_or_empty, unused

LENGTH = 400
GRAM = 48
#: Words of the least passage that counts as repeated, and of its grams.
PASSAGE_WORDS = 51
PASSAGE_GRAM = 8
#: Contexts of one anchor that one shard takes; more are spread over several shards, which are merged.
SHARD_CONTEXTS = 2048
#: Bytes of text that are hashed at once, and of contexts whose suffixes are sorted at once.
CHUNK = 1 << 20
SHARD_BYTES = 1 << 20
LONGEST = 4 << 20
_GAP = np.iinfo(np.int64).max


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    if w == 1:
        return x
    n = len(x)
    full = np.concatenate((x, np.full(-n % w, _GAP, x.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of bytes: a code of each word without the ASCII marks at its edges (a word of marks stays), where each row's words
    start (one more for the end), and where each word starts and ends."""
    inside = np.concatenate((~SEPARATOR[data], [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside & (edge | ~np.concatenate(([False], inside[:-1])))
    ends = np.concatenate(([False], inside[:-1])) & (edge | ~inside)
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    core = np.flatnonzero(_CORE[data])
    i, j = np.searchsorted(core, a), np.searchsorted(core, b)
    core = np.append(core, 0)
    first, last = np.where(i < j, core[i], a), np.where(i < j, core[j - 1] + 1, b)
    with np.errstate(over="ignore"):
        codes = mix(Rolling(data).span(first, last) + (last - first).astype(U) * U(BASE2))
    return codes, np.searchsorted(a, offsets), a, b


def joined(anchor: np.ndarray, row: np.ndarray, place: np.ndarray, first: np.ndarray, reach: int) -> np.ndarray:
    """The last of each run of contexts that can be one, as all their windows hold the last one's anchor: contexts with equal grams
    that follow each other, as in text that repeats itself. first: each context's first window; reach: how far in a window its gram may
    start."""
    n = len(anchor)
    chained = (anchor[1:] == anchor[:-1]) & (row[1:] == row[:-1])
    last = np.ones(n, bool)
    starts = np.flatnonzero(chained & ~np.concatenate(([False], chained[:-1])))
    stops = np.flatnonzero(chained & ~np.concatenate((chained[1:], [False]))) + 1
    for i, end in zip(starts.tolist(), stops.tolist()):
        last[i : end + 1] = False
        while i <= end:
            j = i + int(np.searchsorted(place[i : end + 1], first[i] + reach, "right")) - 1
            last[j] = True
            i = j + 1
    return np.flatnonzero(last)


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, k: int, base: int = 0) -> tuple[np.ndarray, ...]:
    """Of rows of symbols (bytes or codes): row, first window's start and last window's end within the row, hashes of the anchor and of
    the context, and whether the context holds its anchor several times."""
    none = (*(np.zeros(0, np.int64) for _ in range(5)), np.zeros(0, bool))
    if len(data) < length:
        return none
    if len(data) > LONGEST:  # one long row: in pieces that share length - 1 symbols, so each window lies in one piece
        parts = [contexts(data[a : a + LONGEST], np.array([0, len(data[a : a + LONGEST])]), length, k, a) for a in range(0, len(data) - length + 1, LONGEST - length + 1)]
        return tuple(np.concatenate(x) for x in zip(*parts))
    symbols = Rolling(data)
    grams = np.arange(len(data) - k + 1)
    g = mix(symbols.span(grams, grams + k))
    # 41 bits of the gram's hash, then its place: the least is the leftmost of those with the least hash.
    where = sliding_least(((g >> U(1)).view(np.int64) & ~np.int64((1 << 23) - 1)) | grams, length - k + 1) & ((1 << 23) - 1)
    starts = np.arange(len(where))
    row = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + length <= offsets[row + 1]
    starts, where, row = starts[inside], where[inside], row[inside]
    if not len(starts):
        return none
    new = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (row[1:] != row[:-1]))))
    a, b = starts[new], np.concatenate((starts[new[1:] - 1], starts[-1:])) + length
    last = joined(g[where[new]], row[new], where[new], a, length - k)
    first = np.concatenate(([0], last[:-1] + 1))
    a, b, new, again = a[first], b[last], new[last], last > first
    at = row[new]
    kind = U(BASE if data.dtype == np.uint8 else BASE2)  # bytes and words never share an anchor
    with np.errstate(over="ignore"):
        # where the anchor lies in the context is part of what tells contexts apart
        h1 = mix(symbols.span(a, b) + mix((where[new] - a).astype(U) * U(BASE2) + (b - a).astype(U)))
    return at, a - offsets[at] + base, b - offsets[at] + base, mix(g[where[new]] ^ kind).view(np.int64), h1.view(np.int64), again


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffixes of data (small non-negative integers, sentinels included) in order.

    Larsson-Sadakane: ranks by h values are refined to 2h by sorting each group of equal ranks by the ranks h further on; suffixes
    alone in their group are finished and never touched again.
    """
    n = len(data)
    shift = int(data.max()).bit_length()
    h = max(1, 62 // shift)
    key = np.zeros(n, np.int64)
    padded = np.concatenate((data, np.zeros(h, data.dtype))).astype(np.int64)
    for j in range(h):
        key = (key << shift) | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    start = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    alone = start & np.concatenate((start[1:], [True]))
    left = np.flatnonzero(~alone)
    while len(left):
        i = order[left]
        key = rank[i] * (n + 2) + rank[np.minimum(i + h, n)] + 1
        by = np.argsort(key)
        i, key = i[by], key[by]
        order[left] = i
        start = np.concatenate(([True], key[1:] != key[:-1]))
        rank[i] = left[np.maximum.accumulate(np.where(start, np.arange(len(left)), 0))]
        alone = start & np.concatenate((start[1:], [True]))
        left = left[~alone]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """For each suffix how far, up to most, it agrees with the one before it in order, by Kasai's rule.

    Within a row the prefix of the next suffix is at most one shorter, so a row's pass goes on from where the last suffix ended. All
    rows advance together, each by its own step: several values further, one value further, or on to the next suffix.
    """
    n = len(data)
    before = np.full(n, n, np.int64)
    before[order[1:]] = order[:-1]
    bits = int(data.max() + 1).bit_length()
    many = max(1, 63 // bits)
    padded = np.concatenate((data, np.full(most + many + 1, -1, np.int64)))
    several = np.zeros(len(padded) - many + 1, np.int64)
    for j in range(many):
        several = (several << bits) | (padded[j : j + len(several)] & ((1 << bits) - 1))
    out = np.zeros(n, np.int64)
    live = starts < ends
    at, end, h = starts[live].astype(np.int64), ends[live].astype(np.int64), np.zeros(int(live.sum()), np.int64)
    while len(at):
        x, y = at + h, before[at] + h
        far = (h + many <= most) & (x + many <= end) & (several[x] == several[y])
        near = ~far & (h < most) & (x < end) & (padded[x] == padded[y])
        h = h + np.where(far, many, near)
        stop = ~(far | near)
        out[at[stop]] = h[stop]
        h[stop] = np.maximum(h[stop] - 1, 0)
        at = at + stop
        going = at < end
        if not going.all():
            at, end, h = at[going], end[going], h[going]
    return out


def repeated_windows(rows: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each row of symbols (bytes or codes) the starts of windows of so many that start somewhere else in these rows too."""
    sizes = np.array([len(x) for x in rows])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
    flat = np.concatenate(rows)
    flat = flat.astype(np.int64) if flat.dtype == np.uint8 else np.unique(flat, return_inverse=True)[1].astype(np.int64)
    data = np.zeros(int(sizes.sum()) + len(rows), np.int64)
    data[np.arange(len(flat)) + np.repeat(np.arange(len(rows)), sizes)] = flat + 1
    order = suffix_array(data)
    equal = common_prefixes(data, order, starts, starts + sizes, length) >= length
    in_order = equal[order]
    twice = in_order | np.concatenate((in_order[1:], [False]))
    marked = np.zeros(len(data), bool)
    marked[order] = twice
    return [np.flatnonzero(marked[s : s + max(0, z - length + 1)]) for s, z in zip(starts, sizes)]


def window_keys(x: np.ndarray, length: int) -> np.ndarray:
    """128-bit hashes of a context's windows, as 16 bytes that compare like numbers."""
    a = np.arange(len(x) - length + 1)
    out = np.empty((len(a), 2), ">u8")
    out[:, 0], out[:, 1] = (mix(Rolling(x, base).span(a, a + length)) for base in (BASE, BASE2))
    return out.view("S16").ravel()


def found_in(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys a sorted table holds, by binary search."""
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys if len(table) else np.zeros(len(keys), bool)


def shared_keys(runs: list[np.ndarray]) -> np.ndarray:
    """The keys that several of the sorted runs of distinct keys hold: runs are merged two by two, by binary search."""
    twice = [np.zeros(0, "S16")]
    while len(runs) > 1:
        after = []
        for x, y in zip(runs[::2], runs[1::2]):
            both = found_in(y, x)
            twice.append(y[both])
            y = y[~both]
            after.append(np.insert(x, np.searchsorted(x, y), y))
        runs = after + runs[len(after) * 2 :]
    return np.unique(np.concatenate(twice))


_FOUND = "key binary, words boolean, lo int, hi int, anchor long, h1 long, again boolean"
_SOLVED = "words boolean, anchor long, shard int, h1 long, a int, b int, part int, keys binary"
_SOLVED_KINDS = [("words", pa.bool_()), ("anchor", pa.int64()), ("shard", pa.int32()), ("h1", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("part", pa.int32()), ("keys", pa.binary())]


def _anchored(length: int, gram: int, words: int, word_gram: int):
    """(key, text) to contexts: of bytes, and of words if words is not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            for x, y in slices(offsets, CHUNK):
                part, at = data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
                found = [(False, contexts(part, at, length, gram))]
                if words:
                    codes, first, _, _ = words_of(part, at)
                    found.append((True, contexts(codes, first, words, word_gram)))
                for kind, (row, lo, hi, anchor, h1, again) in found:
                    if len(row):
                        yield pa.RecordBatch.from_arrays([batch.column(0)[x:y].take(pa.array(row)), pa.array(np.full(len(row), kind)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(anchor), pa.array(h1), pa.array(again)], names=["key", "words", "lo", "hi", "anchor", "h1", "again"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted) to the symbols of each wanted context."""
    names = ("words", "anchor", "shard", "parts", "h1")
    for batch in batches:
        data, offsets = arrow_bytes(batch.column(0))
        wanted = batch.column(1)
        at = np.asarray(wanted.offsets)
        w = wanted.flatten()
        lo, hi, words = (np.asarray(w.field(x)) for x in ("lo", "hi", "words"))
        out, a = [], at[0]
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            mine = slice(at[i] - at[0], at[i + 1] - at[0])
            codes = words_of(text, np.array([0, len(text)]))[0] if words[mine].any() else None
            out += [(codes if k else text)[x:y].tobytes() for x, y, k in zip(lo[mine], hi[mine], words[mine])]
            if i == batch.num_rows - 1 or len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([*(w.field(x)[a - at[0] : at[i + 1] - at[0]] for x in names), pa.array(out, pa.binary())], names=[*names, "bytes"])
                out, a = [], at[i + 1]


def _symbols(blob: bytes, words: bool) -> np.ndarray:
    return np.frombuffer(blob, U if words else np.uint8)


def _shard(length: int, words: int):
    """Rows sorted by words, anchor and shard to the range of each context that other contexts of its shard repeat, a few MB at a
    time; and of each shard of an anchor with several the windows, as sorted runs, one for each range of keys."""
    sizes = {False: length, True: words}

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        by_shard: dict[tuple, list[np.ndarray]] = {}
        strings = [_symbols(r[5], r[0]) for r in rows]
        for (kind, anchor, shard, parts, h1, _), x, s in zip(rows, strings, repeated_windows(strings, sizes[rows[0][0]])):
            if len(s):
                out.append((kind, anchor, shard, h1, int(s[0]), int(s[-1]) + sizes[kind], None, None))
            if parts > 1:
                by_shard.setdefault((kind, anchor, shard, parts), []).append(window_keys(x, sizes[kind]))
        for (kind, anchor, shard, parts), keys in by_shard.items():
            run = np.unique(np.concatenate(keys))
            bounds = np.array([i * (1 << 64) // parts for i in range(1, parts)], ">u8").view("S8").astype("S16")
            cuts = [0, *np.searchsorted(run, bounds).tolist(), len(run)]
            out += [(kind, anchor, shard, None, None, None, i, run[x:y].tobytes()) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(_SOLVED_KINDS)], names=[n for n, _ in _SOLVED_KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[-1][1] == row[1] and group[-1][4] == row[4]:
                    continue  # the same context, of a row that is there twice
                if group and group[0][:3] != row[:3]:
                    held += group
                    size += sum(len(r[5]) for r in group)
                    if held and (size >= SHARD_BYTES or group[0][0] != row[0]):
                        yield solved(held)
                        held, size = [], 0
                    group = []
                group.append(row)
        held += group
        if held:
            yield solved(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (words, anchor, part, shard, keys), sorted, to the keys of each run that another of its anchor and range holds too."""
    names, kinds = ("words", "anchor", "shard", "keys"), (pa.bool_(), pa.int64(), pa.int32(), pa.binary())

    def solved(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        runs = [np.frombuffer(r[4], "S16") for r in group]
        twice = shared_keys(runs)
        for row, run in zip(group, runs):
            again = run[found_in(run, twice)]
            if len(again):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((row[0], row[1], row[3], again.tobytes()), kinds)], names=names)

    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and group[0][:3] != row[:3]:
                yield from solved(group)
                group = []
            group.append(row)
    if group:
        yield from solved(group)


def _returned(length: int, words: int):
    """Rows (words, anchor, shard, h1, bytes, keys), a shard's keys before its contexts, to the range of each context in these keys."""
    sizes = {False: length, True: words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, table = None, [], None
        for batch in batches:
            out = []
            for kind, anchor, shard, h1, blob, keys in zip(*(c.to_pylist() for c in batch.columns)):
                if own != (kind, anchor, shard):
                    own, known, table = (kind, anchor, shard), [], None
                if keys is not None:
                    known.append(np.frombuffer(keys, "S16"))
                elif known:
                    if table is None:
                        table = np.sort(np.concatenate(known))
                    s = np.flatnonzero(found_in(window_keys(_symbols(blob, kind), sizes[kind]), table))
                    if len(s):
                        out.append((anchor, h1, int(s[0]), int(s[-1]) + sizes[kind]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["anchor", "h1", "a", "b"])

    return run


def _context_spans(length: int, words: int, texts: DataFrame, found: DataFrame) -> DataFrame:
    """(anchor, h1, a, b): the repeated range within each context that has one. texts: (key, text); found: its contexts."""
    distinct = found.groupBy("anchor", "h1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "words", "lo", "hi")).alias("at"), F.max("again").alias("again"))
    distinct = saved(distinct, "contexts")
    whole = distinct.where("n > 1").select("anchor", "h1", F.lit(0).alias("a"), (F.col("at.hi") - F.col("at.lo")).alias("b"))
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("again") & (F.col("n") == 1)).alias("alone")).where("m > 1 or alone").select(F.col("anchor").alias("__anchor"), F.ceil(F.col("m") / F.lit(SHARD_CONTEXTS)).cast("int").alias("parts"))
    apart = distinct.join(saved(several, "several").hint("merge"), F.col("anchor") == F.col("__anchor"))
    shard = F.pmod("h1", F.col("parts")).cast("int")
    wanted = apart.groupBy(F.col("at.key").alias("__key")).agg(F.collect_list(F.struct("at.words", "at.lo", "at.hi", "anchor", shard.alias("shard"), "parts", "h1")).alias("wanted"))
    cut = texts.join(wanted.hint("merge"), F.col("key") == F.col("__key")).select("text", "wanted").mapInArrow(_cut_out, "words boolean, anchor long, shard int, parts int, h1 long, bytes binary")
    cut = saved(cut, "cut")
    ordered = cut.repartition("anchor", "shard").sortWithinPartitions("words", "anchor", "shard", "h1")
    solved = saved(ordered.mapInArrow(_shard(length, words), _SOLVED), "shards")
    runs = solved.where("keys is not null").select("words", "anchor", "part", "shard", "keys").repartition("anchor", "part").sortWithinPartitions("words", "anchor", "part", "shard")
    again = runs.mapInArrow(_merge, "words boolean, anchor long, shard int, keys binary")
    again = again.select("words", "anchor", "shard", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("binary").alias("bytes"), "keys")
    asked = again.unionByName(cut.where("parts > 1").select("words", "anchor", "shard", "h1", "bytes", F.lit(None).cast("binary").alias("keys")))
    asked = asked.repartition("anchor", "shard").sortWithinPartitions("words", "anchor", "shard", F.col("keys").isNull())
    across = asked.mapInArrow(_returned(length, words), "anchor long, h1 long, a int, b int")
    spans = whole.unionByName(solved.where("keys is null").select("anchor", "h1", "a", "b")).unionByName(across)
    return spans.groupBy("anchor", "h1").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def _candidates(found: DataFrame) -> DataFrame:
    """The contexts whose anchor occurs more than once, in several contexts or in one; only these can hold equal windows. found is a
    written table, and dropped."""
    again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 or again").select(F.col("anchor").alias("__anchor"))
    # Written first, so that both sides of the join are plain exchanges and a hot anchor's rows can be split.
    again = saved(again, "repeated-anchors")
    out = saved(found.join(again.hint("merge"), F.col("anchor") == F.col("__anchor"), "left_semi"), "candidates")
    dropped(found, again)
    return out


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of a union of ranges; touching ones are one."""
    if not len(lo):
        return lo, hi
    by = np.argsort(lo, kind="stable")
    lo, far = lo[by], np.maximum.accumulate(hi[by])
    new = np.concatenate(([True], lo[1:] > far[:-1]))
    return lo[new], far[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(lo) - 1]))]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, ranges) to what is left without the ranges of bytes, and without the ranges of bytes and of words."""
    for batch in batches:
        data, offsets = arrow_bytes(batch.column(1))
        ranges = batch.column(2)
        at = np.asarray(ranges.offsets)
        at, flat = at - at[0], ranges.flatten()
        lo, hi, words = (np.asarray(flat.field(x)) for x in ("lo", "hi", "words"))
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        out = []
        for i in range(batch.num_rows):
            mine = slice(at[i], at[i + 1])
            text, kind = data[offsets[i] : offsets[i + 1]], words[mine]
            a, b = merged(lo[mine][~kind], hi[mine][~kind])
            kept = lambda x, y: [text[u:v].tobytes() for u, v in np.concatenate(([0], np.stack((x, y), 1).ravel(), [len(text)])).reshape(-1, 2)]  # noqa: E731, B023
            c, d = merged(lo[mine][kind], hi[mine][kind])
            x, y = a, b
            if len(c):
                _, _, begins, ends = words_of(text, np.array([0, len(text)]))
                x, y = merged(np.concatenate((a, begins[c])), np.concatenate((b, ends[d - 1])))
            digest = hashlib.sha256(b"".join(kept(a, b))).hexdigest()
            out.append((int((b - a).sum()), len(a), digest, len(c), int((d - c).sum()), "".join(z.decode("utf-8", "ignore") for z in kept(x, y))))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=["key", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words", "kept_text"])


def _key(sha256: Column) -> Column:
    """128 bits that stand for a doc_id and its text's SHA-256."""
    return F.unhex(F.md5(F.concat_ws("|", sha256, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))


def repeated(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = PASSAGE_WORDS, word_gram: int = PASSAGE_GRAM) -> DataFrame:
    """(key, words, lo, hi): ranges of bytes, or of words, of the texts (key, text) that windows of `length` bytes, or passages of so
    many words, cover which start somewhere else too. words 0: of bytes only."""
    found = _candidates(saved(texts.mapInArrow(_anchored(length, gram, words, word_gram), _FOUND), "anchors"))
    # Written first, so that both sides of the join are plain exchanges and a context of very many texts can be split.
    spans = saved(_context_spans(length, words, texts, found), "spans").select(F.col("anchor").alias("__a"), F.col("h1").alias("__h1"), "a", "b")
    hit = found.join(spans.hint("merge"), (F.col("anchor") == F.col("__a")) & (F.col("h1") == F.col("__h1")))
    return hit.select("key", "words", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"))


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = PASSAGE_WORDS, word_gram: int = PASSAGE_GRAM) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, text): one row (key, doc_id, n_bytes, sha256) per input row, and one row (key, n_removed, n_spans,
    kept_sha256, n_passages, passage_words, kept_text) per key that has a repeated range: bytes removed, maximal runs of them and the
    digest of the rest, all by strings of `length` bytes; maximal ranges of repeated passages and their words; and the text without
    both. key stands for the doc_id and the text's SHA-256."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("sha256", F.sha2(F.encode("text", "utf-8"), 256)).withColumn("key", _key(F.col("sha256")))
    texts = rows.select("key", "text").where(F.octet_length("text") >= (min(length, 2 * words - 1) if words else length))
    ranges = repeated(texts, length, gram, words, word_gram).groupBy("key").agg(F.collect_set(F.struct("words", "lo", "hi")).alias("ranges")).withColumnRenamed("key", "__key")
    changed = texts.join(ranges.hint("merge"), F.col("key") == F.col("__key")).select("key", "text", "ranges")
    changed = changed.mapInArrow(_kept, "key binary, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long, kept_text string")
    return rows.select("key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "sha256"), changed


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = PASSAGE_WORDS, word_gram: int = PASSAGE_GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_words) for each row of docs (doc_id, text).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same or another row; a text that
    occurs in two rows loses all its bytes if it has `length` of them. n_passages counts the maximal ranges of passages of so many
    words (white space between them and marks at their edges do not count) that stand somewhere else too, passage_words their words;
    these are reported, not removed. Matches are judged on the input and never cross rows.
    Nulls: a null text is empty (nothing removed, the digest of no bytes); rows with a null doc_id are rows like others. Repeated
    rows are copies of each other. Texts of any length are judged whole; an empty text has nothing to lose. Other columns of docs,
    whatever their names, are not looked at. Empty tables give an empty result.
    """
    rows, changed = removals(docs, length, gram, words, word_gram)
    changed = changed.drop("kept_text").dropDuplicates(["key"]).withColumnRenamed("key", "__key")
    out = rows.join(changed, F.col("key") == F.col("__key"), "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", count("n_removed"), count("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), count("n_passages"), count("passage_words"))


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row with its repeated passages of over 50 words, and repeated strings of LENGTH bytes, cut out (a
    character that a cut splits goes); n_chars follows the text. A row of which no word would be left stays whole: all it says stands
    in other rows too, which lose it, so it is the place where that stays.

    Nulls: rows with a null or empty text stay as they are, a null doc_id is a row like others; of repeated rows none is lost; columns
    and their order stay; an empty table gives an empty result.
    """
    left, own, of = (unused(x, docs) for x in ("__new", "__k", "__key"))
    changed = removals(docs)[1].where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")).select(F.col("key").alias(of), F.col("kept_text").alias(left)).dropDuplicates([of])
    both = docs.withColumn(own, _key(F.sha2(F.encode(text_or_empty(), "utf-8"), 256))).join(changed, F.col(own) == F.col(of), "left")
    new = {"text": F.coalesce(left, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(left).isNotNull(), F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return both.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
