import collections
import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkevidence.llm import minhash, suffix_dedup
from sparkevidence.llm.hashing import U


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(seed, n):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(1, 90))) for _ in range(8)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = f"x{r.randint(0, 30)}"
        out.append((i, " ".join(w).upper() if r.random() < 0.1 else " ".join(w)))
    return out


def test_near_duplicates_against_brute_force(docs, monkeypatch):
    rows = near_rows(1, 160)
    for block in (minhash.BLOCK, 16):  # one block, and hot buckets dealt out as pairs of blocks
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(rows)).collect()}
        assert got == brute_components(rows, 4)


def test_near_duplicates_hard_rows(docs, hard):
    got = collections.defaultdict(list)
    for r in minhash.near_duplicates(docs(hard)).collect():
        got[r["doc_id"]].append((r["component_id"], r["kept"]))
    assert sum(map(len, got.values())) == len(hard)
    assert got[2] == [(2, True)] and got[3] == [(3, True)] and got[4] == [(4, True)] and got[None] == [(None, True)]
    assert got[5] == [(5, True)] and got[6] == [(5, False)] and got[1] == [(1, True)] * 3
    assert minhash.near_duplicates(docs([(1, "a")]).where("false")).count() == 0
    kept = minhash.dedup_stage(None, docs(hard), "")
    assert kept.columns == docs(hard).columns and 6 not in {r["doc_id"] for r in kept.collect()}


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(0)
    for n in (1, 2, 5, 40, 400, 5000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(U))
        assert (minhash.sketch(a, 240) != ~U(0)).all()
        b = np.unique(np.concatenate((a[: int(len(a) * 0.8)], r.integers(0, 1 << 63, n - int(n * 0.8)).astype(U))))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.sketch(a, 240) == minhash.sketch(b, 240)).mean() - true) < 0.17


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=12), min_size=2, max_size=14))
def test_links_connect_as_all_pairs_do(sets):
    ids = np.arange(len(sets))
    found = minhash.links(ids, [np.array(sorted(s), U).tobytes() for s in sets])

    def groups(pairs):
        top = list(ids)
        for _ in ids:
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top

    every = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert groups(found) == groups(every) and set(map(tuple, map(sorted, found))) <= set(every)


def brute_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    c = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def brute_passages(texts, many):
    rows = [[re.sub("^[!-/:-@[-`{-~]*(.*?)[!-/:-@[-`{-~]*$", r"\1", w) or w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    c = collections.Counter(tuple(w[i : i + many]) for w in rows for i in range(len(w) - many + 1))
    out = []
    for w in rows:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - many + 1):
            if c[tuple(w[i : i + many])] > 1:
                gone[i : i + many] = True
        out.append((int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), int(gone.sum())))
    return out


def removal_rows(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    shared = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(6)]
    return [(i, " ".join(r.choice(shared)[r.randint(0, 20) :] if r.random() < 0.4 else word() for _ in range(r.randint(0, 25)))) for i in range(n)]


def test_suffix_dedup_against_brute_force(docs, monkeypatch):
    rows = removal_rows(3, 90)
    rows += [(100, rows[5][1]), (101, "ab" * 200), (102, "z" * 150), (103, "zz abc " * 40 + rows[7][1]), (104, rows[8][1] + " abc zz" * 30), (105, "z" * 59), (106, "q " + "z" * 61)]
    want = brute_removal([t for _, t in rows], 60)
    for most in (suffix_dedup.SHARD_CONTEXTS, 3):  # anchors of one shard, and anchors whose shards are merged
        monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", most)
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup(docs(rows), 60, 16, 6, 2).collect()}
        assert [got[i][:4] for i, _ in rows] == want
        assert [got[i][4:] for i, _ in rows] == brute_passages([t for _, t in rows], 6)


def test_suffix_dedup_hard_rows(docs, hard):
    want = brute_removal([r[1] for r in hard], 400)
    got = collections.Counter(tuple(r)[:5] for r in suffix_dedup.dedup(docs(hard)).collect())
    assert got == collections.Counter((h[0], *w) for h, w in zip(hard, want))
    assert suffix_dedup.dedup(docs(hard).where("false")).count() == 0
    out = suffix_dedup.dedup_stage(None, docs(hard), "")
    assert out.columns == docs(hard).columns
    # Two rows with equal texts lose nothing here: the stage before leaves one of them, and no text may be lost wholly.
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted((str(h[0]), str(h[1])) for h in hard)


def test_many_rows_of_one_id_and_text(docs):
    """Their common ranges are united before they meet the rows."""
    text = " ".join(f"word{i}" for i in range(200))
    got = suffix_dedup.dedup(docs([(1, text)] * 30 + [(2, "own " * 20 + text), (3, "short")])).collect()
    assert [(r["doc_id"], r["n_removed"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(1, len(text))] * 30 + [(2, len(text)), (3, 0)]


def test_stage_cuts_passages_of_over_50_words(docs, monkeypatch):
    r = random.Random(21)
    fresh = iter(range(10**6))
    own = lambda n: " ".join(f"{r.choice('pqrs')}{next(fresh)}" for _ in range(n))
    short = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 3))) for _ in range(n))
    over, under, tiny, first, second, dense = short(51), short(50), " ".join(r.choice("abcdefgh") for _ in range(51)), short(45), short(45), "".join(r.choice("abcdefgh") for _ in range(420))
    assert len(over) < 200 and len(tiny) == 101
    rows = [(10 + i, f'{own(30)} "{over}," {own(20)}') if i else (10, f"{own(30)} {over} {own(20)}") for i in range(3)]
    rows += [(20 + i, f"{own(30)} {under} {own(20)}") for i in range(2)]
    rows += [(30 + i, f"{own(3)} {tiny}") for i in range(2)]
    rows += [(40, f"{own(5)} {first} {second} {own(5)}"), (41, f"{own(5)} {first} {own(9)}"), (42, f"{own(9)} {second} {own(5)}")]
    rows += [(50 + i, f"{own(5)} {dense} {own(5)}") for i in range(2)]
    text = dict(rows)
    for most in (suffix_dedup.SHARD_CONTEXTS, 2):
        monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", most)
        got = {x["doc_id"]: x["text"] for x in suffix_dedup.dedup_stage(None, docs(rows), "").collect()}
        assert len(got) == len(rows)
        for i, passage in [(10, over), (11, over), (12, over), (30, tiny), (31, tiny), (50, dense), (51, dense)]:
            assert passage not in got[i] and len(got[i]) >= len(text[i]) - len(passage) - 5, i
        assert all(got[i] == text[i] for i in (20, 21, 40, 41, 42))


def test_text_that_repeats_only_itself(docs):
    r = random.Random(3)
    units = ["".join(r.choices("abcdefgh klm", k=p)) for p in (1, 2, 30, 30, 200, 200, 352, 352, 353, 399)]
    texts = [f"{i} head " + (u * 500)[: len(u) + 399 + i % 3 * 25] + f" tail {i}" for i, u in enumerate(units)] + ["\0" * 401, "\1" * 400, "é" * 201]
    words = " ".join(["one two three"] * 18)
    got = sorted(suffix_dedup.dedup(docs([*enumerate(texts), (99, words)])).collect())
    assert [tuple(x)[1:5] for x in got[:-1]] == brute_removal(texts, 400) and got[-1][5:] == (1, 54)


def test_long_rows_are_anchored_in_pieces(monkeypatch):
    r = np.random.default_rng(2)
    data = r.integers(97, 123, 9000).astype(np.uint8)
    whole = suffix_dedup.contexts(data, np.array([0, 9000]), 100, 16)
    monkeypatch.setattr(suffix_dedup, "LONGEST", 1000)
    parts = suffix_dedup.contexts(data, np.array([0, 9000]), 100, 16)
    windows = lambda c: sorted((int(s), int(a)) for lo, hi, a in zip(c[1], c[2], c[3]) for s in range(lo, hi - 99))
    assert windows(whole) == windows(parts) and len(windows(whole)) == 8901


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=8, unique=True), st.integers(2, 9))
def test_repeated_windows(texts, length):
    raw = [t.encode() for t in texts]
    c = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for kind in (np.uint8, U):  # bytes, and codes of words
        for b, found in zip(raw, suffix_dedup.repeated_windows([np.frombuffer(b, np.uint8).astype(kind) for b in raw], length)):
            assert found.tolist() == [i for i in range(len(b) - length + 1) if c[b[i : i + length]] > 1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), max_size=20), min_size=1, max_size=9))
def test_shared_keys(runs):
    c = collections.Counter(x for r in runs for x in r)
    key = lambda x: x.to_bytes(16, "big")
    assert suffix_dedup.shared_keys([np.array(sorted(map(key, r)), "S16") for r in runs]).tolist() == np.array(sorted(key(x) for x, n in c.items() if n > 1), "S16").tolist()
