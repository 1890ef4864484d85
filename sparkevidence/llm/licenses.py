"""License scans with fuzzy search for short notices (operator 8).

Base places are exact: words of a phrase that stand consecutively. Notices may differ from their pattern by up to `edits` edits: by
the pigeonhole principle one of edits + 1 pieces then stands unchanged, so exact pieces find candidate places, and the regex
library's bounded-error matching around each place verifies the edits and gives the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkevidence.llm.shared import small_batches, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase to label. Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The short notices that are looked for unless a caller names another table: text to (label, edits allowed). Fixed values.
NOTICES = {
    "gnu general public license": ("gpl", 2),
    "gnu gpl version 2": ("gpl", 1),
    "gnu gpl version 3": ("gpl", 1),
    "this program is free software you can redistribute it and or modify it": ("gpl", 4),
    "gnu lesser general public license": ("lgpl", 2),
    "gnu library general public license": ("lgpl", 2),
    "gnu affero general public license": ("agpl", 2),
    "gnu free documentation license": ("gfdl", 2),
    "apache license version 2.0": ("apache", 2),
    "licensed under the apache license": ("apache", 2),
    "permission is hereby granted free of charge": ("mit", 4),
    "released under the mit license": ("mit", 2),
    "licensed under the mit license": ("mit", 2),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 4),
    "released under the isc license": ("isc", 2),
    "redistribution and use in source and binary forms": ("bsd", 4),
    "released under the bsd license": ("bsd", 2),
    "neither the name of the copyright holder nor the names of its contributors": ("bsd", 4),
    "mozilla public license": ("mpl", 2),
    "eclipse public license": ("epl", 2),
    "common development and distribution license": ("cddl", 3),
    "common public license version 1.0": ("cpl", 2),
    "european union public licence": ("eupl", 2),
    "boost software license": ("boost", 2),
    "academic free license": ("afl", 2),
    "open software license": ("osl", 2),
    "artistic license 2.0": ("artistic", 1),
    "python software foundation license": ("psf", 2),
    "sil open font license": ("ofl", 2),
    "server side public license": ("sspl", 2),
    "business source license": ("busl", 2),
    "microsoft public license": ("ms-pl", 2),
    "this is free and unencumbered software released into the public domain": ("unlicense", 4),
    "dedicated to the public domain": ("public-domain", 2),
    "creative commons zero": ("cc0", 2),
    "cc0 1.0 universal": ("cc0", 1),
    "creative commons attribution": ("cc-by", 2),
    "creative commons attribution sharealike": ("cc-by-sa", 3),
    "creative commons attribution share alike": ("cc-by-sa", 3),
    "creative commons attribution noncommercial": ("cc-by-nc", 3),
    "creative commons attribution non commercial": ("cc-by-nc", 3),
    "creative commons attribution noderivatives": ("cc-by-nd", 3),
    "open database license": ("odbl", 2),
    "community data license agreement": ("cdla", 3),
    "this software is provided as is without warranty of any kind": ("no-warranty", 4),
    "all rights reserved": ("proprietary", 1),
}
#: A table of notices is a rule table: it goes to every task, so it is refused above so many rows.
MOST_NOTICES = 10_000
_SEPARATORS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 pieces of near equal length, and where each starts."""
    n, m = len(notice), edits + 1
    cuts = [i * n // m for i in range(m + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Notice:
    """One notice's pattern: places with up to `edits` edits that don't overlap, from left to right."""

    def __init__(self, text: str, label: str, edits: int) -> None:
        import regex

        self.label, self.edits, self.length = label, edits, len(text)
        pattern = f"(?:{regex.escape(text)}){{e<={edits}}}"
        self.any, self.best = regex.compile(pattern), regex.compile(pattern, regex.BESTMATCH)
        # A better match that overlaps the first one ends within so many characters of its start.
        self.reach = 2 * (len(text) + edits)

    def _nearest(self, text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """The best match of a stretch, and those that fit before it, which a search for the best passes over."""
        m = self.best.search(text, lo, hi)
        return [*self._nearest(text, lo, m.start()), (m.start(), m.end(), sum(m.fuzzy_counts))] if m and m.end() > m.start() else []

    def places(self, text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) in text[lo:hi], in time in proportion to its length: the first match shows where to look for the best."""
        out: list[tuple[int, int, int]] = []
        while m := self.any.search(text, lo, hi):
            found = self._nearest(text, m.start(), min(hi, m.start() + self.reach))
            if not found:
                break
            out += found
            lo = found[-1][1]
        return out


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, tuple[str, int]]) -> None:
        import ahocorasick

        self.phrases = [(p.split(" "), label) for p, label in phrases.items()]
        self.fuzzy = [Notice(p, label, e) for p, (label, e) in notices.items()]
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for i, (p, (_, e)) in enumerate(notices.items()):
            for at, piece in pieces(p, e):
                seeds.setdefault(piece, []).append((i, at, len(piece)))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, uses)
        self.seeds.make_automaton()

    def base(self, words: list[str]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a base phrase."""
        out = []
        for phrase, label in self.phrases:
            at = -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(phrase)] == phrase:
                    out.append((at, label))
        return out

    def notices(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of notices in a text of single-spaced words."""
        places: dict[int, list[tuple[int, int]]] = {}
        for end, uses in self.seeds.iter(text):
            for i, at, n in uses:
                notice = self.fuzzy[i]
                a = max(0, end + 1 - n - at - notice.edits)
                places.setdefault(i, []).append((a, min(len(text), a + notice.length + 3 * notice.edits)))
        out = []
        for i, found in places.items():
            notice = self.fuzzy[i]
            found.sort()
            lo, hi = found[0]
            for a, b in [*found[1:], (len(text) + 1, 0)]:
                if a <= hi:
                    hi = max(hi, b)
                    continue
                out += [(x, y, notice.label, e) for x, y, e in notice.places(text, lo, hi)]
                lo, hi = a, b
        return sorted(out)


def normal(text: str) -> list[str]:
    low = text.encode().lower().decode()  # bytes.lower changes A-Z only
    return [w for w in _SEPARATORS.split(low) if w]


def _scanned(phrases: dict[str, str], notices: dict[str, tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in batches:
            ids, rows = batch.column(0), []
            for text in batch.column(1).to_pylist():
                words = normal(text or "")
                base = scanner.base(words)
                spans = scanner.notices(" ".join(words)) if words else []
                least, most = min((a for a, _ in base), default=None), max((a for a, _ in base), default=None)
                labels = {x for _, x in base}
                score = 1.0 if base else max((1 - e / max(1, b - a) for a, b, _, e in spans), default=0.0)
                rows.append((len(words), len(base), least, most, ",".join(sorted(labels)), ",".join(sorted(labels | {x[2] for x in spans})), score, [{"start": a, "end": b, "label": x, "edits": e} for a, b, x, e in spans]))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("edits", pa.int32())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def notice_table(spark: SparkSession, notices: dict[str, tuple[str, int]] = NOTICES) -> DataFrame:
    """The table (text, label, edits) of short notices."""
    return spark.createDataFrame([(text, *rest) for text, rest in notices.items()], "text string, label string, edits int")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of docs (doc_id, text).

    notices: a table (text, label, edits); rows that lack one of them, or a word, are no notices, of rows with one text the one with most
    edits counts. A-Z are lower-cased; words are runs of letters a-z, digits and characters beyond ASCII. spans are character ranges in
    the words joined by single spaces, with their label and edits. score is 1 with a base phrase, else one less the best notice's edits
    per character, else 0.
    Nulls: a null text is empty (no words, no labels, score 0), a null doc_id stays. Repeated rows give equal rows; texts of any
    length are scanned whole; an empty table gives an empty result; other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = (notice_table(spark) if notices is None else notices).select("text", "label", "edits").dropna().orderBy("edits", "label", "text").limit(MOST_NOTICES + 1).collect()
    if len(rows) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_NOTICES} notices")
    wanted = {" ".join(words): (r["label"], r["edits"]) for r in rows if (words := normal(r["text"]))}
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string,edits:int>>"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_scanned(phrases, wanted), kind)
