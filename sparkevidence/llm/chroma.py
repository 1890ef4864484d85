"""Chroma audio fingerprints of media columns (operator 1).

Samples become pitch-class frames (windowed Fourier transform, energy by semitone class, unit length). Rectangle filters over an
integral image of the frames are quantised to two bits each, and sixteen of them pack into one 32-bit integer per frame. Recordings
are found by landmarks (pairs of codes, thinned by winnowing), aligned by a histogram of offsets and measured by bit errors, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkevidence.llm.hashing import BASE, BASE2, U, mix
from sparkevidence.llm.shared import saved, small_batches, text_or_empty

RATE, FRAME, HOP = 8000, 128, 64
#: Frames that a code looks at, codes between a landmark's two, codes among which one landmark is kept.
REACH, APART, KEEP = 4, 1, 4
#: Frames that are transformed, and samples that are fingerprinted at once (or one longer recording).
BLOCK = 1 << 13
SAMPLES = 1 << 20


def _le32(n: Column) -> Column:
    digits = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))


def as_wav(data: Column, rate: int = RATE) -> Column:
    """Bytes taken as unsigned 8-bit mono samples, with a WAV header."""
    n = F.octet_length(data)
    head = [F.lit(b"RIFF"), _le32(n + 36), F.lit(b"WAVEfmt "), _le32(F.lit(16)), F.lit(b"\x01\x00\x01\x00"), _le32(F.lit(rate)), _le32(F.lit(rate)), F.lit(b"\x01\x00\x08\x00data"), _le32(n)]
    return F.concat(*head, data)


def samples(wav: bytes, rate: int = RATE) -> np.ndarray:
    """Mono samples in [-1, 1] of a PCM WAV file (8, 16, 24 or 32 bits), brought to `rate` by linear interpolation; none if it is not
    one."""
    none = np.zeros(0, np.float32)
    if len(wav) < 44 or wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        return none
    at, channels, bits, own = 12, 1, 8, rate
    while at + 8 <= len(wav):
        name, size = wav[at : at + 4], int.from_bytes(wav[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels = int.from_bytes(wav[at + 8 : at + 10], "little"), int.from_bytes(wav[at + 10 : at + 12], "little")
            own, bits = int.from_bytes(wav[at + 12 : at + 16], "little"), int.from_bytes(wav[at + 22 : at + 24], "little")
            if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or not channels or not own:
                return none
        if name == b"data":
            width = bits // 8
            body = np.frombuffer(wav, np.uint8, min(size, len(wav) - at - 8) // (width * channels) * width * channels, at + 8)
            if bits == 8:
                x = body.astype(np.float32) / 128 - 1
            else:
                wide = np.zeros((len(body) // width, 4), np.uint8)
                wide[:, 4 - width :] = body.reshape(-1, width)
                x = (wide.view("<i4").ravel() / float(1 << 31)).astype(np.float32)
            x = x.reshape(-1, channels).mean(1) if channels > 1 else x
            if own != rate and len(x):
                x = np.interp(np.arange(int(len(x) * rate / own)) * (own / rate), np.arange(len(x)), x).astype(np.float32)
            return x
        at += 8 + size + size % 2
    return none


def _pitch_classes(rate: int) -> np.ndarray:
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(f), 12), np.float32)
    use = np.flatnonzero(f >= 100)
    out[use, np.round(12 * np.log2(f[use] / 440)).astype(int) % 12] = 1
    return out


_WINDOW = np.hanning(FRAME).astype(np.float32)
_CLASSES = _pitch_classes(RATE)
#: A frame's unit vector is kept in whole parts, so that sums over any stretch of frames are exact.
SCALE = 1 << 16
_LEAST = FRAME + HOP * (REACH + APART - 1)


def chroma_frames(recordings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of energy by pitch class (12 rows, a column for each frame) of all recordings, one after the other, and where each
    one's frames start (one more for the end); short recordings are followed by silence up to one landmark."""
    full = [np.concatenate((x, np.zeros(_LEAST - len(x), np.float32))) if len(x) < _LEAST else x for x in recordings]
    size = np.array([len(x) for x in full])
    many = (size - FRAME) // HOP + 1
    first = np.concatenate(([0], np.cumsum(many)))
    starts = np.repeat(np.cumsum(size) - size - HOP * first[:-1], many) + HOP * np.arange(first[-1])
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate(full), FRAME)
    out = np.empty((12, first[-1]), np.int64)
    for a in range(0, len(starts), BLOCK):
        s = np.fft.rfft(view[starts[a : a + BLOCK]] * _WINDOW, axis=1)
        c = np.sqrt((s.real**2 + s.imag**2) @ _CLASSES)
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-6)
        out[:, a : a + BLOCK] = np.rint(c.T * SCALE)
    return out, first


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, classes, frames) of the sixteen filters: early less late, low less high, and crossed quarters."""
    return [(i % 3, (5 * i) % (13 - h), h, w) for i in range(16) for h, w in [((4, 6, 12, 8)[i % 4], (4, 2, 4, 2)[i // 4])]]


_FILTERS = _filters()


def codes(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each run of REACH frames."""
    image = np.zeros((13, frames.shape[1] + 1), np.int64)
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    n = frames.shape[1] - REACH + 1

    def box(a: int, b: int, lo: int, hi: int) -> np.ndarray:
        return image[hi, b : b + n] - image[hi, a : a + n] - image[lo, b : b + n] + image[lo, a : a + n]

    out = np.zeros(n, np.uint32)
    for kind, lo, h, w in _FILTERS:
        m, half = lo + h // 2, w // 2
        if kind == 0:
            v = box(0, half, lo, lo + h) - box(half, w, lo, lo + h)
        elif kind == 1:
            v = box(0, w, lo, m) - box(0, w, m, lo + h)
        else:
            v = box(0, half, lo, m) + box(half, w, m, lo + h) - box(0, half, m, lo + h) - box(half, w, lo, m)
        edge = SCALE * h * w // 50
        level = (v > -edge).astype(np.uint32) + (v > 0) + (v > edge)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbours differ in one bit
    return out


def landmarks(c: np.ndarray, first: np.ndarray, sounding: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and place of thinned code pairs of some recordings, whose codes start at first: of each KEEP consecutive pairs the
    least stays, each hash at its first place. Pairs that start after the last sample are silence, alike in all short recordings, and
    no landmarks."""
    size = np.diff(first)
    many = np.minimum(size - APART, np.maximum(1, -(-sounding // HOP)))
    at = np.concatenate(([0], np.cumsum(many)))
    row = np.repeat(np.arange(len(many)), many)
    place = np.arange(at[-1]) - at[row]
    i = first[row] + place
    with np.errstate(over="ignore"):
        h = mix(c[i].astype(U) * U(BASE) + c[i + APART].astype(U) * U(BASE2))
    # Each window of KEEP pairs, shorter at the end of a recording with fewer.
    padded = np.concatenate((h, np.full(KEEP - 1, ~U(0), U)))
    view = np.lib.stride_tricks.sliding_window_view(padded, KEEP)
    inside = place[:, None] + np.arange(KEEP) < many[row][:, None]
    least = np.where(inside, view, ~U(0)).argmin(1) + np.arange(len(h))
    whole = (place + KEEP <= many[row]) | ((place == 0) & (many[row] < KEEP))
    kept = np.unique(least[whole])
    row, h, place = row[kept], h[kept], place[kept]
    order = np.lexsort((place, h, row))
    row, h, place = row[order], h[order], place[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
    return row[new], h[new].view(np.int64), place[new]


_MARK = pa.struct([("h", pa.int64()), ("at", pa.int32())])


def _printed(rows: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
    """rows: (doc_id, phase, samples)."""
    frames, first = chroma_frames([x for _, _, x in rows])
    every = codes(frames)
    size = np.diff(first) - REACH + 1
    at = np.concatenate(([0], np.cumsum(size)))
    row = np.repeat(np.arange(len(rows)), size)
    c = every[np.arange(at[-1]) - at[row] + first[row]]
    place = (np.arange(at[-1]) - at[row] + 1).astype(U)
    with np.errstate(over="ignore"):
        s1, s2 = (np.add.reduceat(x, at[:-1]).view(np.int64) for x in (mix(c.astype(U) + place * U(BASE)), mix(c.astype(U) ^ (place * U(BASE2)))))
    own, h, where = landmarks(c, at, np.array([len(x) for _, _, x in rows]))
    pairs = pa.StructArray.from_arrays([pa.array(h), pa.array(where.astype(np.int32))], fields=list(_MARK))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(c.view(np.int32))),
            pa.ListArray.from_arrays(np.searchsorted(own, np.arange(len(rows) + 1)).astype(np.int32), pairs), pa.array(s1), pa.array(s2),
        ],
        names=["doc_id", "phase", "codes", "marks", "s1", "s2"],
    )


def _fingerprinted(phases: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc_id, wav in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = samples(wav.as_py() or b"")
                for p in range(0, HOP, HOP // phases):
                    if p and len(x) - p < FRAME:
                        break
                    held.append((doc_id, p, x[p:]))
                    size += max(len(x) - p, _LEAST)
                    if size > SAMPLES:
                        yield _printed(held)
                        held, size = [], 0
            if held:
                yield _printed(held)

    return run


def fingerprints(media: DataFrame, phases: int = 1) -> DataFrame:
    """(doc_id, phase, codes array<int>, marks array<struct<h,at>>, s1, s2) for each row of media (doc_id, wav) and each phase, the
    samples left out at the start. Files of other sample rates are brought to RATE. A null, empty or broken file, or one that is not
    PCM, is silence of one landmark; a null doc_id stays; repeated rows give equal rows, an empty table an empty result; other columns
    of media are not looked at. s1 and s2 are equal for equal codes."""
    small_batches(media.sparkSession)
    kind = "doc_id long, phase int, codes array<int>, marks array<struct<h:long,at:int>>, s1 long, s2 long"
    return media.select("doc_id", "wav").mapInArrow(_fingerprinted(phases), kind)


#: A match has landmarks in common for at least one in so many codes of the overlap (there is one to every two or three).
FEWEST = 25


#: Codes of recordings (a block's share) and of queries in one block, pairs of landmarks and compared codes that are worked on at once,
#: recordings that make a block of their own, blocks that are made of few codes, and rows up to which hashes and ids are broadcast.
R_BLOCK, Q_BLOCK, AT_ONCE, R_ROWS, R_BLOCKS, SENT = 1 << 21, 1 << 21, 1 << 21, 256, 12, 1_000_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT else df.hint("merge")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's start (one more for the end)."""
    a = column.combine_chunks()
    size = a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return a.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size)))


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of n items each: every item's row and its number in it."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - (np.cumsum(n) - n)[row]


def _runs(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose n sum up to so much at most, a greater one alone."""
    at, a = np.concatenate(([0], np.cumsum(n))), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, b
        a = b


def _wrong(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Differing bits of n codes each, of x from x_at and of y from y_at."""
    out = np.zeros(len(n), np.int64)
    for a, b in _runs(n, AT_ONCE):
        row, i = _spread(n[a:b])
        out[a:b] = np.bincount(row, np.bitwise_count(x[x_at[a:b][row] + i] ^ y[y_at[a:b][row] + i]), b - a)
    return out


_MATCH = "q long, r long, votes long, offset int, error double"
_BEST = "q long, n long, error double, votes long, r long, offset int"


def _matched(error: float, best: bool):
    """Of one block of queries and one of recordings: the matches, or each query's number of them and best one."""

    def run(asked: pa.Table, media: pa.Table) -> pa.Table:
        asked = asked.sort_by("q")
        q, own, phase, r = (t[c].to_numpy() for t, c in ((asked, "q"), (asked, "own"), (asked, "phase"), (media, "r")))
        (qc, qc_at), (qh, qh_at), (qp, _) = (_lists(asked[c]) for c in ("codes", "h", "at"))
        (rc, rc_at), (rh, rh_at), (rp, _) = (_lists(media[c]) for c in ("codes", "h", "at"))
        qc, rc, q_n, r_n = qc.view(np.uint32), rc.view(np.uint32), np.diff(qc_at), np.diff(rc_at)
        order = np.argsort(rh, kind="stable")
        rh, rp, r_of = rh[order], rp[order].astype(np.int64), np.repeat(np.arange(len(r)), np.diff(rh_at))[order]
        low = np.searchsorted(rh, qh, "left")
        many = np.searchsorted(rh, qh, "right") - low
        q_of = np.repeat(np.arange(len(q)), np.diff(qh_at))
        # All phases of a query are in one run, so that a pair of recordings is told once.
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
        ends = qh_at[np.append(first[1:], len(q))] if len(q) else first
        sums = np.concatenate(([0], np.cumsum(many)))
        parts = []
        for a, b in _runs(np.diff(sums[np.concatenate(([0], ends))]), AT_ONCE):
            s = slice(ends[a - 1] if a else 0, ends[b - 1])
            mark, i = _spread(many[s])
            at = low[s][mark] + i
            x, y = q_of[s][mark], r_of[at]
            step = rp[at] - qp[s][mark]
            keep = own[x] != r[y]
            pair, which = np.unique(x[keep] * len(r) + y[keep], return_inverse=True)
            if not len(pair):
                continue
            low_step, span = step[keep].min(), step[keep].max() - step[keep].min() + 1
            key, votes = np.unique(which * span + (step[keep] - low_step), return_counts=True)
            x, y, step = pair[key // span] // len(r), pair[key // span] % len(r), key % span + low_step
            q_from, r_from = np.maximum(-step, 0), np.maximum(step, 0)
            n = np.minimum(q_n[x] - q_from, r_n[y] - r_from)
            keep = votes * FEWEST >= n
            x, y, step, votes, n, q_from, r_from = (v[keep] for v in (x, y, step, votes, n, q_from, r_from))
            off = _wrong(qc, qc_at[x] + q_from, rc, rc_at[y] + r_from, n) / (32 * n)
            keep = off <= error
            x, y, votes, off = x[keep], y[keep], votes[keep], off[keep]
            offset = step[keep] * HOP - phase[x]
            x, y = q[x], r[y]
            inner = np.lexsort((offset, -votes, off, y, x))
            x, y, votes, offset, off = (v[inner] for v in (x, y, votes, offset, off))
            new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, bool)
            x, y, votes, offset, off = (v[new] for v in (x, y, votes, offset, off))
            if best:
                inner = np.lexsort((offset, y, -votes, off, x))
                x, y, votes, offset, off = (v[inner] for v in (x, y, votes, offset, off))
                x, one, n = np.unique(x, return_index=True, return_counts=True)
                parts.append((x, n, off[one], votes[one], y[one], offset[one]))
            else:
                parts.append((x, y, votes, offset, off))
        names = ["q", "n", "error", "votes", "r", "offset"] if best else ["q", "r", "votes", "offset", "error"]
        kinds = {"error": pa.float64(), "offset": pa.int32()}
        return pa.table({c: pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kinds.get(c, pa.int64())) for k, c in enumerate(names)})

    return run


def _near(places: DataFrame, *by: str) -> DataFrame:
    """The nearest start and end that each hash has in places (row, n_codes, h, at), or in each part of them."""
    return _few(places.groupBy("h", *by).agg(F.min("at").alias("start"), F.min(F.col("n_codes") - F.col("at")).alias("end")))


def _overlap() -> Column:
    """Codes that rows have in common at least if they meet at this place: as many before and after it as the nearer ends allow."""
    return F.least("at", "start") + F.least(F.col("n_codes") - F.col("at"), F.col("end"))


def _able(own: DataFrame, other: DataFrame) -> DataFrame:
    """Places of rows of own that may have landmarks enough in common with a row of other: all that they share are enough for the
    shortest overlap that one of them allows."""
    rows = own.join(_near(other), "h").groupBy("row").agg(F.count(F.lit(1)).alias("most"), F.min(_overlap()).alias("least")).where(F.col("least") <= FEWEST * F.col("most"))
    return saved(own.join(rows.select("row").hint("merge"), "row"), "able")


def _homes(places: DataFrame) -> DataFrame:
    """places (row, r, n_codes, h, at) with r's block i. Recordings go by the hash that most recordings have, so those that queries
    reach by the same hashes are together; where more have it than a block's share, they are dealt to several blocks."""
    count, size = places.select("row", "n_codes").distinct().agg(F.count(F.lit(1)), F.coalesce(F.sum("n_codes"), F.lit(0))).first()
    n = max(1, -(-size // R_BLOCK), min(R_BLOCKS, -(-count // R_ROWS)))
    often = places.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    keys = places.join(_few(often), "h").groupBy("r").agg(F.max_by("h", F.struct("often", "h")).alias("key"), F.max("n_codes").alias("size"))
    keys = saved(keys, "keys")
    parts = keys.groupBy("key").agg(F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(F.sum("size") / max(1, -(-size // n))))).alias("parts"))
    block = F.pmod(F.pmod(F.xxhash64("key"), F.lit(n)) + F.pmod(F.xxhash64("r"), "parts"), F.lit(n)).cast("int")
    return saved(places.join(keys.join(_few(parts), "key").select("r", block.alias("i")).hint("merge"), "r"), "homes")


def _searched(media: DataFrame, every: int, error: float, best: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints, classes and matches (q, r, votes, offset, error) of the queries among all classes but their own: of each pair the
    offset with the fewest errors among all that have landmarks enough; or, of each block of recordings, each query's number of
    matches and best one.

    Hashes that a query shares with another class are told from one row for each hash. Only recordings and phases of queries whose
    shared hashes may be enough are compared. Recordings that have their commonest shared hash in common are in one block, so that a
    phase of a query goes to few blocks, with the landmarks that they hold; no pair of landmarks or of recordings is a row.
    """
    prints = fingerprints(media.where("doc_id is not null")).withColumns({"n_codes": F.size("codes"), "row": F.monotonically_increasing_id()})
    prints = saved(prints, "prints")
    asking = F.pmod("doc_id", F.lit(every)) == 0
    classes = prints.groupBy("s1", "s2", "n_codes").agg(F.min("doc_id").alias("class_id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("n"), F.min(F.when(asking, F.col("doc_id"))).alias("asker"))
    classes = saved(classes, "classes")
    askers = classes.where("asker is not null").select(F.col("asker").alias("doc_id"), F.col("class_id").alias("own"), F.col("s1").alias("own_s1"))
    # A query takes HOP times as long as another recording, so queries are dealt out by number and not by bytes.
    asked = media.where(asking).join(askers.select("doc_id"), "doc_id", "left_semi").repartition(int(media.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    queries = fingerprints(asked, HOP).join(askers, "doc_id")
    queries = queries.select(F.col("doc_id").alias("q"), "own", "own_s1", "phase", "codes", "marks", F.size("codes").alias("n_codes"), F.monotonically_increasing_id().alias("row"))
    queries = saved(queries, "queries")
    ends = lambda df, c: df.select(F.explode("marks.h").alias("h"), F.col(c).alias("c")).groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    a, b = ends(prints, "s1").alias("a"), ends(queries, "own_s1").alias("b")
    shared = a.join(b, "h").where("not (a.low = a.high and b.low = b.high and a.low = b.low)").select("h")
    shared = _few(saved(shared, "shared"))
    # Where shared hashes stand in queries, and in one recording of each class.
    places = lambda df: df.select("row", "n_codes", F.explode("marks").alias("m")).select("row", "n_codes", "m.h", "m.at").join(shared, "h")
    left = saved(places(queries), "places")
    right = saved(places(prints).join(classes.select("row", F.col("class_id").alias("r")).hint("merge"), "row"), "places")
    left = _able(left, right)
    right = _able(right, left)
    home = _homes(right)
    held = F.collect_list(F.struct("h", "at")).alias("m")
    sent = left.join(_near(home, "i"), "h").groupBy("row", "n_codes", "i").agg(held, F.min(_overlap()).alias("least"))
    sent = saved(sent.where(F.col("least") <= FEWEST * F.size("m")), "sent")
    deals = F.broadcast(sent.groupBy("i").agg(F.ceil(F.sum("n_codes") / Q_BLOCK).cast("int").alias("deals")))
    marks = [F.col("m.h").alias("h"), F.col("m.at").alias("at")]
    sent = sent.join(deals, "i").select("row", "i", "deals", *marks)
    home = home.groupBy("row", "r", "i").agg(held).join(deals, "i").select("row", "r", "i", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("j"), *marks)

    def coded(df: DataFrame, rows: DataFrame, to: DataFrame) -> DataFrame:
        """to with the columns of df's rows; df's other rows are left out first."""
        return df.join(_few(rows.select("row").distinct()), "row", "left_semi").join(to.hint("merge"), "row")

    asked = coded(queries.select("row", "q", "own", "phase", "codes"), left, sent).withColumn("j", F.pmod(F.xxhash64("q"), "deals").cast("int"))
    found = coded(prints.select("row", "codes"), right, home)
    return prints, classes, asked.groupBy("i", "j").cogroup(found.groupBy("i", "j")).applyInArrow(_matched(error, best), _BEST if best else _MATCH)


def matches(media: DataFrame, every: int = 50, error: float = 0.25) -> DataFrame:
    """(query, match, votes, offset, error): all matches of one query of each class, as search counts them; match is a class."""
    return _searched(media, every, error, False)[2].withColumnsRenamed({"q": "query", "r": "match"})


def search(media: DataFrame, every: int = 50, error: float = 0.25) -> DataFrame:
    """One row for each recording of media (doc_id, wav) whose doc_id is divisible by `every`, searched among all others:
    (doc_id, n_codes, class_id, n_copies, n_matches, best_id, best_offset, best_votes, best_error).

    Recordings with equal codes are one class, known by its least doc_id; n_copies counts the others in it. One of a class's queries
    is fingerprinted at every phase of the hop, so that a copy that starts between two frames is found too. A match is another class
    that, aligned at some offset (in samples), shares landmarks, one to FEWEST codes of the overlap at least and one in any case, and
    differs in at most `error` of the bits of the overlapping codes. Every offset with so many landmarks is measured, so an alignment
    counts whatever other passages the two share (recordings that have nothing in common differ in about 0.34 of the bits, in 0.29 at their best
    offset). best is the match with the fewest errors (then most votes, least id). Rows with a null doc_id are no queries and are not
    found; rows that repeat a doc_id count as copies, as do all null, empty or broken files among themselves. Recordings of any length
    are searched whole. Empty tables give an empty result.
    """
    prints, classes, matched = _searched(media, every, error, True)
    asking = F.pmod("doc_id", F.lit(every)) == 0
    top = matched.groupBy("q").agg(F.sum("n").alias("n_matches"), F.min(F.struct("error", (-F.col("votes")).alias("v"), "r", "offset")).alias("b"))
    out = prints.where(asking).select("doc_id", "n_codes", "s1", "s2").join(classes, ["s1", "s2", "n_codes"]).join(top, F.col("asker") == F.col("q"), "left")
    return out.select(
        "doc_id", "n_codes", "class_id", (F.col("n") - 1).alias("n_copies"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.col("b.r").alias("best_id"), F.col("b.offset").alias("best_offset"), (-F.col("b.v")).alias("best_votes"), F.round("b.error", 6).alias("best_error"),
    )


def recordings(docs: DataFrame) -> DataFrame:
    """(doc_id, wav): each whole text's UTF-8 bytes as samples; a media column for tables that have none."""
    return docs.select("doc_id", as_wav(F.encode(text_or_empty(), "utf-8")).alias("wav"))
