import collections
import random
import re
import zlib

import numpy as np
import pytest

from sparkevidence.llm import spelling
from sparkevidence.llm.hashing import U

ALPHABET = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]


def around(word):
    """All strings one code point away."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in ALPHABET}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in ALPHABET}
    return out - {word}


def plain(rows, least=3):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= least}
    near = {w: sorted((-n[x], x) for x in around(w) if x in n) for w in n}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 2 * n[w] else None for w in n}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def ordered(df):
    return sorted(map(tuple, df.collect()))


def some(seed, docs=150):
    """Words of a small alphabet with typing errors of them, and of those, so that chains of forms occur."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abcßéÿx") for _ in range(r.randint(4, 9))) for _ in range(25)]
    words = []
    for s in stems:
        a = s
        for k in (40, 15, 6, 3, 2):
            words += [a] * k
            i = r.randrange(len(a))
            a = r.choice([a[:i] + a[i + 1 :], a[:i] + r.choice("abcßéÿx") + a[i + 1 :], a[:i] + r.choice("abcßéÿx") + a[i:]])
    return [(i, r.choice([" ", "-", "7"]).join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in r.choices(words, k=25))) for i in range(docs)]


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 100])
def test_against_brute_force(docs, filter_bytes):
    rows = some(7) + [(3, "again again again"), (3, "again again again"), (None, "nulls nulls nulls null"), (901, None), (902, "")]
    want = plain(rows)
    assert any(w[2] not in (w[0], w[1]) for w in want) and any(w[4] == 0 for w in want)
    assert ordered(spelling.variants(docs(rows), filter_bytes=filter_bytes)) == want


def test_hard_tables(docs, hard):
    letters = "abcdefghij" * 300
    rows = [(x[0], x[1]) for x in hard] + [(50 + i, f"{letters} {letters}x ſtraße {letters[1:]}") for i in range(4)]
    assert ordered(spelling.variants(docs(rows))) == plain([(i, t) for i, t in rows])
    assert spelling.variants(docs(hard).where("false")).count() == 0


def test_hashes_of_edits():
    """Each generated hash is that of the edited word itself, and each filter holds all its words."""
    for word in ("aaaaa", "straße", "xyÿzé"):
        letters = np.frombuffer(word.encode("latin-1"), np.uint8)[None, :]
        made = set()
        for row, at, letter, key, length in spelling.edits(letters):
            for p, c, k in zip(at, letter, key):
                edited = word[:p] + (chr(c) if c else "") + word[p + 1 :]
                own = np.frombuffer(edited.encode("latin-1"), np.uint8)[None, :]
                assert length == len(edited) and spelling._finished(spelling.hashes(own), length)[0] == k
                made.add(edited)
        assert made == {x for x in around(word) if len(x) < len(word) or len(x) == len(word) and x > word}


def test_filters_miss_nothing(spark):
    words = spark.createDataFrame([(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}", i) for i in range(600)], "word string, n long").mapInArrow(spelling._hashed, "word string, n long, key long, length int")
    bloom = spelling._filter(words, {6: 600}, 1, 0)
    keys = np.array([r["key"] for r in words.collect()], np.int64).view(U)
    assert len(bloom.holds(keys, 6)) == 600
    other = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(U)
    assert len(bloom.holds(other, 6)) < 200 and len(bloom.holds(other, 7)) == 0
