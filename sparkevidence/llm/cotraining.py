"""Quality classifier by co-training (operator 6): page text and page metadata teach each other, calibrated views score all documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkevidence.llm.hashing import U, mix, word_hashes
from sparkevidence.llm.shared import arrow_bytes, saved, slices, small_batches, text_or_empty, unit_interval

#: Bound of the labelled sample that models are fitted on; rows are taken in order of a keyed hash. Pseudo-labels come from all others.
LABELLED = 9_000
ROUNDS = 2
#: A view hands a pseudo-label on when it is this sure of it; so many of either kind are needed for them to count.
CONFIDENT = 0.97
LEAST = 20
#: Every so-manieth labelled document is kept for calibration.
HELD_OUT = 4
WORDS, NAMES = 1 << 15, 1 << 9
TEXT_SIZE, META_SIZE = WORDS + 4, 2 * NAMES + 4
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LINE_FEED = np.zeros(256, bool)
_LINE_FEED[10] = True
_UPPER, _DIGIT, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[33:127] = _NOT_ALNUM[33:127]
_SYMBOL[[44, 46]] = False


class Rows:
    """Sparse rows of features: where each starts, and index and value of each entry."""

    def __init__(self, at: np.ndarray, index: np.ndarray, value: np.ndarray, width: int) -> None:
        self.at, self.width = at, width
        self.index, self.value = index.astype(np.int32, copy=False), value.astype(np.float32, copy=False)

    def __len__(self) -> int:
        return len(self.at) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(w[self.index] * self.value)))
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, np.repeat(r, np.diff(self.at)) * self.value, self.width)

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.at)[rows]
        at = np.concatenate(([0], np.cumsum(n)))
        pick = np.repeat(self.at[rows] - at[:-1], n) + np.arange(at[-1])
        return Rows(at, self.index[pick], self.value[pick], self.width)


def _counted(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def views(data: np.ndarray, offsets: np.ndarray, sources: list, langs: list) -> tuple[Rows, Rows]:
    """The two views of some documents: hashed words and make-up of the text; source, language and layout of the page."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    words, first = word_hashes(data, offsets, _NOT_ALNUM)
    slot = (words & U(WORDS - 1)).astype(np.int64)
    index, value, fresh = [], [], np.ones(n)
    for i in range(n):
        own = np.unique(slot[first[i] : first[i + 1]])
        if len(own):
            fresh[i] = len(own) / min(first[i + 1] - first[i], WORDS)
        index.append(own)
        value.append(np.full(len(own), 1 / math.sqrt(max(len(own), 1))))
    made = np.stack((4 * _counted(_UPPER[data], offsets) / size, 8 * _counted(_SYMBOL[data], offsets) / size, 4 * _counted(_DIGIT[data], offsets) / size, 2 * fresh), 1)
    at = np.concatenate(([0], np.cumsum([len(x) + 4 for x in index])))
    extra = np.arange(WORDS, TEXT_SIZE)
    text = Rows(at, np.concatenate([y for x in index for y in (x, extra)]), np.concatenate([y for i, x in enumerate(value) for y in (x, made[i])]), TEXT_SIZE)
    lines, first = word_hashes(data, offsets, _LINE_FEED)
    count = np.diff(first)
    same = np.array([1 - len(np.unique(lines[a:b])) / max(b - a, 1) if b > a else 0.0 for a, b in zip(first[:-1], first[1:])])
    layout = np.stack((np.log1p(size) / 10, np.log1p(count) / 5, np.log1p(size / np.maximum(count, 1)) / 10, same), 1)
    name = lambda x, start: start + hash_name(x)
    index = np.concatenate((np.array([[name(s, 0), name(x, NAMES)] for s, x in zip(sources, langs)], np.int64), np.tile(np.arange(2 * NAMES, META_SIZE), (n, 1))), 1)
    return text, Rows(np.arange(n + 1) * 6, index.ravel(), np.concatenate((np.ones((n, 2)), layout), 1).ravel(), META_SIZE)


def hash_name(x: str | None) -> int:
    import zlib

    return zlib.crc32((x if x is not None else "\0none").encode()) % NAMES


def fit(rows: Rows, label: np.ndarray, reg: float, steps: int = 60) -> np.ndarray:
    """Logistic regression with a bias (the last weight) by L-BFGS: the mean loss plus reg / 2 times the squared weights."""

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows.dot(w[:-1]) + w[-1]
        p = 1 / (1 + np.exp(-z))
        r = (p - label) / len(label)
        g = np.append(rows.back(r) + reg * w[:-1], r.sum())
        return float(np.mean(np.logaddexp(0, z) - label * z) + reg / 2 * (w[:-1] @ w[:-1])), g

    w = np.zeros(rows.width + 1)
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, a = -g, []
        for s, y, r in reversed(past):
            a.append(r * (s @ d))
            d = d - a[-1] * y
        if past:
            s, y, _ = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y, r), x in zip(past, reversed(a)):
            d = d + (x - r * (y @ d)) * s
        step = 1.0 if past else 1 / max(np.linalg.norm(g), 1e-12)
        slope = g @ d
        while step > 1e-10:
            after, h = loss(w + step * d)
            if after <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, h - g
        done = value - after < 1e-7
        w, value, g = w + s, after, h
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y, 1 / (s @ y))]
        if done:
            break
    return w


def logit(rows: Rows, w: np.ndarray) -> np.ndarray:
    return np.clip(rows.dot(w[:-1]) + w[-1], -30, 30)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def platt(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that calibrate logits; a view that the held-out rows contradict says nothing, so the slope is not below 0."""
    w = fit(Rows(np.arange(len(z) + 1), np.zeros(len(z), np.int64), z, 1), label, 1e-3)
    if w[0] >= 0:
        return float(w[0]), float(w[1])
    p = (label.sum() + 1) / (len(label) + 2)
    return 0.0, math.log(p / (1 - p))


def odds(counts: np.ndarray, size: int) -> np.ndarray | None:
    """Log odds of label 1 by feature, smoothed, from counts (feature or -1, documents of label 0, of label 1); -1 has all documents.
    None for features that are no names, and where too few documents have either label."""
    total = counts[counts[:, 0] == -1][:, 1:].sum(0)
    if total.min() < LEAST:
        return None
    n = np.zeros((size, 2))
    own = counts[counts[:, 0] >= 0]
    n[own[:, 0]] = own[:, 1:]
    p = (n + 0.5) / (total + 1)
    out = np.log(p[:, 1] / (1 - p[:, 1])) - np.log(p[:, 0] / (1 - p[:, 0]))
    out[n.sum(1) == 0] = 0
    return out


def taught(rows: Rows, label: np.ndarray, reg: float, lesson: np.ndarray | None) -> np.ndarray:
    """A view's model. What the pseudo-labels say of each feature (lesson) is one more feature of the labelled rows, so how far it is
    to be trusted is fitted too; it then melts into the weights."""
    if lesson is None:
        return fit(rows, label, reg)
    told = rows.dot(lesson)
    scale = max(float(told.std()), 1e-9)
    n = len(rows)
    at = rows.at + np.arange(n + 1)
    index, value = np.empty(at[-1], np.int32), np.empty(at[-1], np.float32)
    old = np.ones(at[-1], bool)
    old[at[1:] - 1] = False
    index[old], value[old] = rows.index, rows.value
    index[~old], value[~old] = rows.width, told / scale
    w = fit(Rows(at, index, value, rows.width + 1), label, reg)
    return np.append(w[:-2] + lesson * (w[-2] / scale), w[-1])


class Pupil:
    """The two views' models of one label. Rows that are held out calibrate the views at the end (Platt scaling)."""

    REG = {"text": 1e-4, "meta": 1e-3}

    def __init__(self, text: Rows, meta: Rows, label: np.ndarray, held: np.ndarray) -> None:
        train = np.flatnonzero(~held)
        self.label, self.held, self.views = label, held, {"text": text, "meta": meta}
        self.base = {k: (x.take(train), label[train], self.REG[k]) for k, x in self.views.items()}
        self.w = {k: taught(*x, None) for k, x in self.base.items()}

    def learn(self, counts: dict[str, np.ndarray]) -> None:
        self.w = {k: taught(*x, odds(counts[k], x[0].width)) for k, x in self.base.items()}

    def model(self) -> dict:
        own = self.label[self.held]
        check = np.flatnonzero(self.held) if min(own.sum(), (1 - own).sum()) >= 2 else np.flatnonzero(~self.held)
        prior = (self.label.sum() + 1) / (len(self.label) + 2)
        scale = {f"{k}_scale": platt(logit(x.take(check), self.w[k]), self.label[check]) for k, x in self.views.items()}
        return dict(self.w) | scale | {"prior": math.log(prior / (1 - prior))}


def lessons(text: Rows, meta: Rows, w: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray]]:
    """(view, counts) of some documents for each view: how many of which the other view is sure have a feature, by pseudo-label."""
    p = {"text": probability(logit(text, w["text"])), "meta": probability(logit(meta, w["meta"]))}
    for mine, rows, names, other in (("text", text, WORDS, "meta"), ("meta", meta, 2 * NAMES, "text")):
        sure = np.abs(p[other] - 0.5) >= CONFIDENT - 0.5
        out = np.zeros((names + 1, 2), np.int64)
        row = np.repeat(np.arange(len(rows)), np.diff(rows.at))
        for kind in (0, 1):
            said = sure & ((p[other] >= 0.5) == bool(kind))
            out[:names, kind] = np.bincount(rows.index[said[row] & (rows.index < names)], minlength=names)
            out[names, kind] = said.sum()
        yield mine, out


def combined(text: Rows, meta: Rows, model: dict) -> np.ndarray:
    """Probability of label 1: the views' calibrated logits add up, less the prior's, as for independent evidence."""
    z = sum(logit(rows, model[k]) * model[f"{k}_scale"][0] + model[f"{k}_scale"][1] for k, rows in (("text", text), ("meta", meta)))
    return probability(np.clip(z - model["prior"], -30, 30))


def _viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = arrow_bytes(batch.column(3))
        for a, b in slices(offsets, 2 << 20):
            part = views(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch.column(4)[a:b].to_pylist(), batch.column(5)[a:b].to_pylist())
            lists = [pa.ListArray.from_arrays(x.at.astype(np.int32), pa.array(y)) for x in part for y in (x.index.astype(np.int32), x.value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:3]), *lists, batch.column(6)[a:b]], names=["quality", "toxic", "held", "ti", "tv", "mi", "mv", "id"])


def _rows(table: pa.Table, index: str, value: str, width: int) -> Rows:
    i, v = table[index].combine_chunks(), table[value].combine_chunks()
    return Rows(np.asarray(i.offsets).astype(np.int64), np.asarray(i.values), np.asarray(v.values), width)


def _taught_by(models: dict[str, dict[str, np.ndarray]]):
    """(text, source, lang) to the counts of pseudo-labels by target, view and feature, summed up in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(0))
            for a, b in slices(offsets, 2 << 20):
                text, meta = views(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch.column(1)[a:b].to_pylist(), batch.column(2)[a:b].to_pylist())
                for target, w in models.items():
                    for view, counts in lessons(text, meta, w):
                        sums[target, view] = sums.get((target, view), 0) + counts
        for (target, view), counts in sums.items():
            at = np.flatnonzero(counts.sum(1))
            n = len(at)
            at_or_all = np.where(at == len(counts) - 1, -1, at)
            yield pa.RecordBatch.from_arrays([pa.array([target] * n, pa.string()), pa.array([view] * n, pa.string()), pa.array(at_or_all, pa.int64()), pa.array(counts[at, 0]), pa.array(counts[at, 1])], names=["target", "view", "index", "n0", "n1"])

    return run


def trained(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict[str, dict | None]:
    """Models of good quality and of toxicity.

    The views are fitted on at most `labelled` labelled documents. In each round both views judge all other rows of docs, and what
    each is sure of goes to the other as counts of features by pseudo-label: whole numbers, summed in the tasks, of which the driver
    sees one row for each feature. Repeats of a labelled id are one example (its least text).
    """
    by_hash = F.md5(F.concat(F.lit("sample|"), F.col("doc_id").cast("string")))
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    given = known.join(docs.select("doc_id").where("doc_id is not null"), "doc_id", "left_semi").orderBy(by_hash, "doc_id").limit(labelled)
    chosen = saved(given, "sample").withColumnRenamed("doc_id", "__id")
    held = F.floor(unit_interval(F.md5(F.concat(F.lit("fold|"), F.col("__id").cast("string")))) * HELD_OUT) == 0
    rows = docs.select("doc_id", "text", "source", "lang").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("__id", "quality", "toxic").agg(F.min(F.struct(text_or_empty().alias("text"), "source", "lang")).alias("d"))
    rows = rows.select(F.col("quality").cast("int"), F.col("toxic").cast("int"), held.alias("held"), "d.text", "d.source", "d.lang", "__id")
    # The sample has a bound: it is fitted on the driver.
    table = rows.mapInArrow(_viewed, "quality int, toxic int, held boolean, ti array<int>, tv array<float>, mi array<int>, mv array<float>, id long").toArrow()
    out: dict[str, dict | None] = {"quality": None, "toxic": None}
    if not table.num_rows:
        return out
    table = table.sort_by("id")
    text, meta = _rows(table, "ti", "tv", TEXT_SIZE), _rows(table, "mi", "mv", META_SIZE)
    pupils = {}
    for name in out:
        label = np.asarray(table[name].to_pylist(), float)
        if min(label.sum(), (1 - label).sum()) >= 4:
            pupils[name] = Pupil(text, meta, label, np.asarray(table["held"].to_pylist(), bool))
    rest = docs.join(F.broadcast(chosen.select("__id")), F.col("doc_id") == F.col("__id"), "left_anti").select(text_or_empty().alias("text"), "source", "lang")
    for _ in range(rounds if pupils else 0):
        sums = rest.mapInArrow(_taught_by({k: x.w for k, x in pupils.items()}), "target string, view string, index long, n0 long, n1 long")
        sums = sums.groupBy("target", "view", "index").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
        target, view, counts = np.asarray(sums["target"].to_pylist()), np.asarray(sums["view"].to_pylist()), np.stack([sums[c].to_numpy() for c in ("index", "n0", "n1")], 1)
        for name, pupil in pupils.items():
            pupil.learn({k: counts[(target == name) & (view == k)] for k in pupil.views})
    return out | {k: x.model() for k, x in pupils.items()}


def _scored(models: dict[str, dict | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(0))
            for a, b in slices(offsets, 2 << 20):
                text, meta = views(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch.column(1)[a:b].to_pylist(), batch.column(2)[a:b].to_pylist())
                p = [combined(text, meta, models[k]) if models[k] else np.full(b - a, 1.0 if k == "quality" else 0.0) for k in ("quality", "toxic")]
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[3:]), *(pa.array(np.round(x, 6)) for x in p)], names=[*batch.schema.names[3:], "__quality", "__toxic"])

    return run


def scored(docs: DataFrame, labels: DataFrame, carried: list[str], **options) -> DataFrame:
    """The carried columns of docs with __quality and __toxic, the probabilities that a document is good and that it is toxic.

    All rows are scored whole, by models fitted on a bounded labelled sample and taught by all other rows (see trained). Labels of an id that occur twice are joined (worst
    quality, toxic if any). Without labels of both kinds a document counts as good, or as not toxic. Null texts are empty, null
    sources and languages are names of their own; null ids are scored like others; empty tables give an empty result.
    """
    small_batches(docs.sparkSession)
    models = trained(docs, labels, **options)
    rows = docs.select(text_or_empty().alias("__text"), F.col("source").alias("__source"), F.col("lang").alias("__lang"), *[F.col(f"`{c}`") for c in carried])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    return rows.mapInArrow(_scored(models), f"{kinds}, __quality double, __toxic double")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, quality, toxic, kept) for each row of docs: probabilities, and whether the document is good and not toxic. Nulls, empty
    texts, repeats and empty tables as in scored; other columns of docs are not looked at."""
    out = scored(docs, labels, ["doc_id"], **options)
    return out.select("doc_id", F.col("__quality").alias("quality"), F.col("__toxic").alias("toxic"), ((F.col("__quality") >= 0.5) & (F.col("__toxic") < 0.5)).alias("kept"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go. Nulls, empty texts, repeats and empty tables as in scored; without
    labels of both kinds all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, labels, docs.columns).where("__quality >= 0.5 and __toxic < 0.5").drop("__quality", "__toxic")
