"""SentencePiece BPE with seeded merge-dropout (operator 3)."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkevidence.llm.hashing import BASE, BASE2, U, mix
from sparkevidence.llm.shared import arrow_bytes, slices, small_batches, text_or_empty

DROPOUT = 0.1
SEED = 17
#: Chunks that a worker keeps at hand as cut without a skip.
KEPT_CHUNKS = 600_000
#: Characters from which a chunk has an agenda of its own, a heap, whose time is nearly in proportion to its length.
LONG_CHUNK = 512
_SPACE = "▁"
_M = (1 << 64) - 1
_NONE = 1 << 40


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mixed(x: int) -> int:
    """hashing.mix of one number."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


class DropoutEncoder:
    """Merge-type segmentation of texts by a BPE model's pieces, with each candidate merge skipped by a hash that is keyed by seed,
    document, the chunk's place in it and the pair's places in the chunk.

    Pieces never hold a space mark after another character, nor a line feed, so a text falls into chunks (a run of spaces and what
    follows it) that are cut independently; this is checked when the model is loaded. Of each distinct chunk the cut without skips and
    the candidates met on the way are kept: an occurrence whose hashes skip none of them is cut that way, every other one by itself.
    Chunks are cut together: each has an agenda of its adjacent pairs, a row of scores, and each step carries out the best merge of each.
    Long chunks are cut one by one, with a heap as agenda.
    """

    def __init__(self, path: str, dropout: float) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        usable = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        # Pieces are kept with plain spaces, so a space mark in a text is no piece; it goes out as bytes and comes back as itself.
        ids = {self.sp.id_to_piece(i).replace(_SPACE, " "): i for i in usable}
        if any(" " in p.lstrip(" ") or "\n" in p for p in ids):
            raise ValueError("pieces of this model cross the chunks that the encoder cuts")
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.base = n
        single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
        self.points, self.point_ids = (np.array(x, np.int64) for x in zip(*single))
        merges = sorted((ids[p[:k]] * n + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.pairs, self.merged = (np.array(x, np.int64) for x in zip(*merges))
        # Rank of each piece by score, the best first.
        scores = np.array([self.sp.get_score(i) for i in range(n)])
        self.rank = np.empty(n, np.int64)
        self.rank[np.argsort(-scores, kind="stable")] = np.arange(n)
        self.threshold = int(dropout * (1 << 32))
        self.pair_of: dict[int, int] = {}
        self._forget()
        self.chunk = re.compile(" +[^ \n]*|[^ \n]+|\n")

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.plain: list[bytes] = []
        # Candidates of the known chunks, and where each chunk's start.
        self.met, self.met_at = np.zeros(1 << 16, U), np.zeros(1, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        ids, row, pair = self.segment(chunks, None)
        self.known.update(zip(chunks, range(len(self.plain), len(self.plain) + len(chunks))))
        self.plain += ids
        at = self.met_at[-1] + np.cumsum(np.bincount(row, minlength=len(chunks)))
        if at[-1] > len(self.met):
            self.met = np.concatenate((self.met, np.zeros(max(len(self.met), at[-1] - len(self.met)), U)))
        self.met[self.met_at[-1] : at[-1]] = pair[np.argsort(row, kind="stable")]
        self.met_at = np.concatenate((self.met_at, at))

    def _skips(self, keys: np.ndarray, pair: np.ndarray) -> np.ndarray:
        return (mix(keys ^ pair) >> U(32)) < U(self.threshold)

    def _candidates(self, a: np.ndarray, b: np.ndarray, keys: np.ndarray | None, met: list, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece and rank of each pair of symbols at two places; _NONE for pairs that no piece joins or that the hash skips.
        Without keys none is skipped, and the candidates go to met."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = (self.pairs[at] == key) & (a >= 0) & (b >= 0)
        piece = np.where(found, self.merged[at], 0)
        if self.threshold:
            with np.errstate(over="ignore"):
                pair = left.astype(U) * U(BASE) + right.astype(U) * U(BASE2)
            if keys is None:
                met.append((row[found], pair[found]))
            else:
                found &= ~self._skips(keys[row], pair)
        return piece, np.where(found, self.rank[piece], _NONE)

    def segment(self, chunks: list[str], keys: np.ndarray | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Little-endian 32-bit ids of each chunk with its key; without keys of each without skips, then also the chunk's number and
        the places' hash of each candidate."""
        out: list[bytes] = [b""] * len(chunks)
        rows, pairs = [np.zeros(0, np.int64)], [np.zeros(0, U)]
        by_size: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            by_size.setdefault(max(8, 1 << (len(c) - 1).bit_length()), []).append(i)
        for width, places in by_size.items():
            if width > LONG_CHUNK:
                for i in places:
                    out[i], seen = self._cut_long(chunks[i], None if keys is None else int(keys[i]))
                    rows.append(np.full(len(seen), i, np.int64))
                    pairs.append(seen)
                continue
            step = max(1, (1 << 19) // width)
            for a in range(0, len(places), step):
                part = np.array(places[a : a + step])
                met: list[tuple[np.ndarray, np.ndarray]] = []
                for i, ids in zip(part.tolist(), self._cut([chunks[i] for i in part.tolist()], None if keys is None else keys[part], width, met)):
                    out[i] = ids
                rows += [part[r] for r, _ in met]
                pairs += [p for _, p in met]
        return out, np.concatenate(rows), np.concatenate(pairs)

    def _cut(self, texts: list[str], keys: np.ndarray | None, width: int, met: list) -> list[bytes]:
        n, size = len(texts), np.array([len(c) for c in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(n), size)
        column = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.full((n, width + 1), -1, np.int64)
        symbols[row, column] = np.where(self.points[at] == points, self.point_ids[at], -1)
        alive = np.zeros((n, width + 1), bool)
        alive[row, column] = True
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        rank = np.full((n, width + 1), _NONE, np.int64)
        piece = np.zeros((n, width + 1), np.int64)
        inner = column + 1 < size[row]
        r, c = row[inner], column[inner]
        piece[r, c], rank[r, c] = self._candidates(symbols[r, c], symbols[r, c + 1], keys, met, r, c, c + 1)
        live = np.arange(n)
        while len(live):
            j = rank[live].argmin(1)
            go = rank[live, j] < _NONE
            live, j = live[go], j[go]
            if not len(live):
                break
            right = after[live, j]
            symbols[live, j] = piece[live, j]
            alive[live, right] = False
            rank[live, right] = _NONE
            beyond = after[live, right]
            after[live, j] = beyond
            has = beyond < size[live]
            before[live[has], beyond[has]] = j[has]
            rank[live, j] = _NONE
            x, y, z = live[has], j[has], beyond[has]
            piece[x, y], rank[x, y] = self._candidates(symbols[x, y], symbols[x, z], keys, met, x, y, z)
            prior = before[live, j]
            has = prior >= 0
            x, y, z = live[has], prior[has], j[has]
            piece[x, y], rank[x, y] = self._candidates(symbols[x, y], symbols[x, z], keys, met, x, y, z)
        flat = symbols[alive]
        counts = alive.sum(1)
        ends = np.cumsum(counts)
        raw = flat.astype("<u4").tobytes()
        out = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), counts.tolist())]
        for i in np.flatnonzero((alive & (symbols < 0)).any(1)).tolist():  # characters that are no piece go out as bytes
            ids: list[int] = []
            for c in np.flatnonzero(alive[i]).tolist():
                s = int(symbols[i, c])
                ids += [s] if s >= 0 else [self.bytes[b] for b in texts[i][c].encode()]
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def _cut_long(self, text: str, key: int | None) -> tuple[bytes, np.ndarray]:
        """Ids of one chunk, and without a key the places' hash of each candidate."""
        if not self.pair_of:
            self.pair_of = dict(zip(self.pairs.tolist(), self.merged.tolist()))
        n = len(text)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.where(self.points[at] == points, self.point_ids[at], -1).tolist()
        after, before, seen = list(range(1, n + 1)), list(range(-1, n - 1)), []
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            piece = self.pair_of.get(symbols[left] * self.base + symbols[right]) if symbols[left] >= 0 <= symbols[right] else None
            if piece is None:
                return
            if self.threshold:
                pair = (left * BASE + right * BASE2) & _M
                if key is None:
                    seen.append(pair)
                elif _mixed(key ^ pair) >> 32 < self.threshold:
                    return
            heapq.heappush(agenda, (int(self.rank[piece]), left, right, symbols[left], symbols[right]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, a, b = heapq.heappop(agenda)
            if after[left] != right or symbols[left] != a or symbols[right] != b:
                continue  # one of the two has been merged with another since
            symbols[left] = self.pair_of[a * self.base + b]
            symbols[right], after[right], after[left] = -2, -1, after[right]
            if after[left] < n:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        ids: list[int] = []
        for c, s in zip(text, symbols):
            if s != -2:
                ids += [s] if s >= 0 else [self.bytes[x] for x in c.encode()]
        return np.array(ids, "<u4").tobytes(), np.array(seen, U)

    def encode(self, texts: list[str], doc_keys: list[int]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. The model puts a space mark before a text; an empty text has no ids."""
        cut = [self.chunk.findall(" " + text) if text else [] for text in texts]
        chunks = [c for part in cut for c in part]
        size = np.array([len(part) for part in cut], np.int64)
        if not chunks:
            return [b""] * len(texts)
        missing = list({c for c in chunks if c not in self.known})
        if len(self.plain) + len(missing) > KEPT_CHUNKS:
            self._forget()
            missing = list(set(chunks))
        if missing:
            self._learn(missing)
        number = [self.known[c] for c in chunks]
        out = [self.plain[i] for i in number]
        if self.threshold:
            ends = np.cumsum(size)
            place = np.arange(len(chunks)) - np.repeat(ends - size, size)
            with np.errstate(over="ignore"):
                keys = mix(np.repeat(np.array([k & _M for k in doc_keys], U), size) + place.astype(U) * U(BASE))
            for a in range(0, len(chunks), 1 << 17):
                own = np.array(number[a : a + (1 << 17)])
                n = self.met_at[own + 1] - self.met_at[own]
                row = np.repeat(np.arange(len(own)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.met_at[own][row]
                apart = np.unique(row[self._skips(keys[a + row], self.met[at])]) + a
                for i, ids in zip(apart.tolist(), self.segment([chunks[i] for i in apart.tolist()], keys[apart])[0]):
                    out[i] = ids
        edges = np.concatenate(([0], np.cumsum(size))).tolist()
        return [b"".join(out[a:b]) for a, b in zip(edges, edges[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


_encoders: dict[tuple, DropoutEncoder] = {}


def _segmented(path: str, dropout: float, seed: int, digest: bool, check: bool = False):
    """(doc_id, text) and perhaps the number of a row among copies to ids, or to digests of them; check: ids have to give the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (path, dropout)
        if name not in _encoders:
            _encoders[name] = DropoutEncoder(*name)
        encoder = _encoders[name]
        for batch in batches:
            _, offsets = arrow_bytes(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(1).to_pylist()]
                copies = part.column(2).to_pylist() if part.num_columns > 2 else [0] * len(texts)
                raw = encoder.encode(texts, [hash_id(i, seed, c) for i, c in zip(part.column(0).to_pylist(), copies)])
                decoded = []
                if digest or check:
                    for ids, text in zip(raw, texts):
                        back = encoder.decode(np.frombuffer(ids, "<u4").tolist())
                        if check:
                            if back != text:
                                raise ValueError("ids do not give back the text they were made from")
                            continue
                        decoded.append((zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text))
                n = [len(x) // 4 for x in raw]
                if digest:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *(pa.array([d[i] for d in decoded], t) for i, t in enumerate((pa.int64(), pa.string(), pa.bool_())))], names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])
                else:
                    at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(raw), "<i4")))], names=["doc_id", "ids"])

    return run


def hash_id(doc_id: int | None, seed: int, copy: int = 0) -> int:
    return int(mix(np.array([((doc_id if doc_id is not None else -1) * 2 + 1 + seed * BASE + copy * BASE2) & _M], U))[0])


def encode(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs (doc_id, text); with dropout 0 the model's own segmentation.

    The same seed gives the same ids in any run and partitioning. A null or empty text has no ids; a null doc_id is a key of its
    own; repeated rows give equal rows; texts of any length are encoded whole; an empty table gives an empty result. Other columns of
    docs, whatever their names, are not looked at.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_segmented(model or piece_model(), dropout, seed, False), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). Null or no ids give an empty text; null ids of documents and repeated rows stay; an empty
    table gives an empty result."""
    path = model or piece_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sp.decode(x) if x else "" for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, lossless): digests of each text's ids and of the text decoded from them. Nulls,
    empty and long texts, repeats, other columns and empty tables as in encode; a null text comes back as an empty one."""
    small_batches(docs.sparkSession)
    kind = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean"
    return docs.select("doc_id", "text").mapInArrow(_segmented(model or piece_model(), dropout, seed, True), kind)


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: (doc_id, ids). Copies of a row are numbered and cut in ways of their own; all ids are decoded again
    and a row that does not come back as its text fails the run. Nulls, empty and long texts, other columns and empty tables as in
    encode."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    alike = Window.partitionBy("doc_id", F.sha2(F.encode(text_or_empty(), "utf-8"), 256)).orderBy("doc_id")
    rows = rows.withColumn("copy", F.row_number().over(alike) - 1)
    return rows.mapInArrow(_segmented(piece_model(), DROPOUT, SEED, False, True), "doc_id long, ids array<int>")
