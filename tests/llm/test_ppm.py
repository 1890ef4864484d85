import collections
import math
import random
import zlib

import pytest

from sparkevidence.llm import ppm


def learns(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


def parts(text):
    return (text or "").encode().lower().split()


class Trie:
    """Prediction by partial matching, symbol by symbol, with sets and loops."""

    def __init__(self, texts, order):
        self.order, self.seen = order, collections.defaultdict(collections.Counter)
        for text in texts:
            data = self.data(text)
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.seen[data[i - k : i]][data[i]] += 1

    def data(self, text):
        return b"\n" * self.order + b"".join(p + b" " for p in parts(text)) + b"\n"

    def symbol(self, context, s):
        out, left_out = 0.0, set()
        for k in range(self.order, -1, -1):
            here = {t: n for t, n in self.seen.get(context[len(context) - k :], {}).items() if t not in left_out}
            if not here:
                continue
            total = sum(here.values()) + len(here)
            if s in here:
                return out + math.log10(here[s] / total)
            out += math.log10(len(here) / total)
            left_out |= set(here)
        return out - math.log10(252 - len(left_out))

    def score(self, text):
        data = self.data(text)
        return sum(self.symbol(data[i - self.order : i], data[i]) for i in range(self.order, len(data)))


def plain(rows, order):
    train = [parts(t) + [b"\n"] for i, t in rows if learns(i)]
    c = collections.Counter(w for p in train for w in p)
    n, v = sum(c.values()), len(c)
    trie = Trie([t for i, t in rows if learns(i)], order)
    for i, t in rows:
        p = parts(t) + [b"\n"]
        yield i, not learns(i), len(p), sum(w in c for w in p), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in p), trie.score(t)


def some(r, n):
    vocabulary = ["".join(r.choice("abcdeÄöß.") for _ in range(r.randint(1, 7))) for _ in range(60)]
    return [(i, r.choice([" ", "\n ", " "]).join(r.choices(vocabulary, k=r.randint(0, 40)))) for i in range(n)]


def same(got, want):
    key = lambda x: (str(x[0]), x[2], x[6], x[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-12) and a[6] == pytest.approx(b[6], rel=1e-12)


@pytest.mark.parametrize(("order", "block", "trie_rows"), [(4, 1 << 20, 1 << 18), (2, 300, 40), (5, 1, 100)])
def test_against_loops(docs, order, block, trie_rows):
    rows = some(random.Random(order), 120) + [(7, "again seven"), (7, "again seven"), (None, "no id 漢字   here"), (900, None), (901, " \t\n"), (902, "ABC abc Abc")]
    same(ppm.score(docs(rows), order, block, trie_rows).collect(), list(plain(rows, order)))


def test_hard_tables(docs, hard, spark):
    rows = [(x[0], x[1]) for x in hard]
    got = ppm.score(docs(hard)).collect()
    assert len(got) == len(rows)
    by_id = {x["doc_id"]: x for x in got}
    assert by_id[5]["score"] == pytest.approx(by_id[6]["score"]) and by_id[5]["n_tokens"] == 40_001
    assert ppm.score(docs(hard).where("false")).count() == 0
    held = [(i, "only held out") for i in range(40) if not learns(i)]
    same(ppm.score(docs(held)).collect(), list(plain(held, ppm.ORDER)))


def test_probabilities_add_up(docs):
    """The probabilities of all symbols in a context are one: nothing is lost to symbols that longer contexts have seen."""
    trie = Trie([t for _, t in some(random.Random(9), 30)], 3)
    symbols = [s for s in range(256) if s not in (9, 11, 12, 13)]
    for context in [b"\n\n\n", b"ab ", b"zzz", b"e. "]:
        assert sum(10 ** trie.symbol(context, s) for s in symbols) == pytest.approx(1)


def test_learned_text_is_likelier(docs):
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["the", "house", "stands", "there", "still"], k=30))) for i in range(200)] + [(1000 + i, "".join(r.choice("qxzjkv ") for _ in range(150))) for i in range(50)]
    got = [x for x in ppm.score(docs(rows)).collect() if x["held_out"]]
    a = [x["score"] / x["n_tokens"] for x in got if x["doc_id"] < 1000]
    b = [x["score"] / x["n_tokens"] for x in got if x["doc_id"] >= 1000]
    assert a and b and min(a) > max(b)
