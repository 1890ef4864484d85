import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from sparkevidence.llm import chroma, cotraining, kdtree, licenses, mixing, multiset_hash


def test_mix_follows_the_contract(docs, hard):
    r = random.Random(5)
    rows = hard + [(100 + i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 60))), "en", r.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows = [x for x in rows if x[0] not in (5, 6)]  # documents of a size far above the targets' granularity
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter(x["size"] for x in got) == collections.Counter(size(x[1]) for x in rows)
    per = collections.Counter()
    for x in rows:
        per[x[3]] += size(x[1])
    names = sorted(x for x in per if x is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(per.values())
    while True:  # share out, fix those above their limit, share the rest again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * per[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * per[s]
            left -= target[s]
        free -= over
    taken = collections.Counter()
    for x in got:
        assert x["source_size"] == per[x["source"]] and abs(x["target"] - target[x["source"]]) < 1e-6
        assert 0 <= x["taken"] <= 3 * x["size"] and (x["size"] == 0 or x["taken"] % x["size"] == 0)
        taken[x["source"]] += x["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 130, (s, taken[s], target[s])
    again = mixing.mix(docs(rows).repartition(7)).collect()
    key = lambda x: (str(x["doc_id"]), str(x["source"]), x["size"], x["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs(rows).where("false")).count() == 0


def test_mix_stage_repeats_documents(docs, hard):
    d = docs(hard)
    out = mixing.mix_stage(None, d, "")
    assert out.columns == d.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(size(r["text"]) for r in out.collect()) == sum(r["taken"] for r in mixing.mix(d).collect())


def test_multiset_hash(docs, hard, spark):
    rows = [(i, "\n".join(f"line {j} of {i % 3}." for j in range(i % 7))) for i in range(40)] + [(90, hard[6][1]), (95, None), (96, "äöü😀 x. y! z")]
    got = {r["doc_id"]: r for r in multiset_hash.fingerprints(docs(rows)).collect()}
    ids, text = sorted(got), {i: t or "" for i, t in rows}
    for a, i in enumerate(ids):
        t, nxt = text[i], text[ids[(a + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and (edited != t or got[i]["near_edited"] == 1)
        assert (got[i]["fingerprint"] == got[ids[(a + 1) % len(ids)]]["fingerprint"]) == (got[i]["near_next"] == 1)
    assert got[3]["fingerprint"] == got[24]["fingerprint"] and got[3]["fingerprint"] != got[4]["fingerprint"]
    assert multiset_hash.fingerprints(docs(hard)).count() == len(hard)
    assert multiset_hash.fingerprints(docs(hard).where("false")).count() == 0


def test_multiset_hash_is_homomorphic(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("one.\ntwo.\nthree.", "three.\none.\ntwo.", "two.", "one.\nthree.")], "a string, b string, c string, d string")
    f = {x: multiset_hash.fingerprint(F.col(x)) for x in "abcd"}
    r = d.select((f["a"] == f["b"]).alias("order"), (multiset_hash.plus(f["d"], f["c"]) == f["a"]).alias("insert"), (multiset_hash.minus(f["a"], f["c"]) == f["d"]).alias("delete")).first()
    assert r["order"] and r["insert"] and r["delete"]


def test_multiset_likeness_holds_for_long_texts(docs):
    rows = [(k, "\n".join(f"text {k} line {j:04d}." for j in range(400))) for k in range(3)] + [(3, "a.\na.\na.\nb."), (4, "a.\nb.\nb.")]
    got = {x["doc_id"]: x for x in multiset_hash.fingerprints(docs(rows)).collect()}
    parts = lambda t: collections.Counter(x for x in re.split(r"\n+|(?<=[.!?])[ \t]+", t) if x)
    inner = lambda x, y: sum(n * parts(y)[p] for p, n in parts(x).items())
    # Common paragraphs by all; where paragraphs are repeated, their numbers are multiplied.
    share = lambda x, y: inner(x, y) / (inner(x, x) + inner(y, y) - inner(x, y))
    for k, t in rows:
        nxt = rows[(k + 1) % len(rows)][1]
        # Estimated from the fingerprints alone, so near the share and not equal to it.
        assert abs(got[k]["near_next"] - share(t, nxt)) < 0.15
        assert abs(got[k]["near_edited"] - share(t, t[: len(t) - len(t) // 4] + nxt[: len(t) // 4])) < 0.15
    assert got[0]["near_edited"] > 0.55 and got[0]["near_next"] == 0
    one = multiset_hash.fingerprints(docs([(1, "one paragraph")])).first()["fingerprint"]
    one, sketch = one.split("-")
    assert all(int(one[i : i + 12], 16) for i in range(0, len(one), 12)) and len(one) == 12 * multiset_hash.WIDTH and len(sketch) == 16


def test_multiset_hash_against_brute_force(docs):
    """Fingerprints are equal for equal multisets of paragraphs, and order, ranges and outlying ids as sorted."""
    r = random.Random(6)
    ids = [*range(20), 10**15, -(10**12), *[10**9 + 3 * i for i in range(40)]]
    rows = [(i, "\n".join(r.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(r.randint(0, 6)))) for i in ids] + [(None, f"row {i}.") for i in range(30)]
    r.shuffle(rows)
    got = multiset_hash.fingerprints(docs(rows)).collect()
    by = collections.defaultdict(set)
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest()))
    bag = lambda t: tuple(sorted(x for x in re.split(r"\n+|(?<=[.!?])[ \t]+", t) if x))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        q = len(t) // 4
        edited = t[: len(t) - q] + order[(k + 1) % len(order)][1][:q]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in got) == want
    text = {i: t for i, t in rows if i is not None}
    for x in got:
        if x["doc_id"] is not None:
            by[bag(text[x["doc_id"]])].add(x["fingerprint"])
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def brute_tree(rows, count):
    """The same law with plain sorted lists: rows (key of each dimension, size) to shards."""
    out, todo = {}, [(list(range(len(rows))), 0, count)]
    extent = [max(1, (max(k[d] for k, _ in rows) >> kdtree.TIE_BITS) - (min(k[d] for k, _ in rows) >> kdtree.TIE_BITS)) for d in range(3)]
    while todo:
        own, a, b = todo.pop()
        if b - a == 1 or not own:
            out |= {i: a for i in own}
            continue
        wide = [((max(rows[i][0][d] for i in own) >> kdtree.TIE_BITS) - (min(rows[i][0][d] for i in own) >> kdtree.TIE_BITS)) / extent[d] for d in range(3)]
        d = wide.index(max(wide))
        goal, total, at = max(1, sum(rows[i][1] for i in own) * ((b - a) // 2) // (b - a)), 0, 0
        own.sort(key=lambda i: rows[i][0][d])  # noqa: B023
        while total < goal:
            total += rows[own[at]][1]
            at += 1
        while at < len(own) and rows[own[at]][0][d] == rows[own[at - 1]][0][d]:
            at += 1
        middle = a + (b - a) // 2
        todo += [(own[:at], a, middle), (own[at:], middle, b)]
    return out


def test_kd_tree_against_plain_lists(docs):
    r = random.Random(12)
    rows = [(i, "same text" if i % 3 == 0 else "t" * r.randint(0, 200), r.choice(["en", "de", "fr", None]), "hot" if r.random() < 0.4 else f"s{r.randint(0, 30)}") for i in range(400)]
    keyed = kdtree._keyed(docs(rows)).collect()
    want = brute_tree([((x["k0"], x["k1"], x["k2"]), x["size"]) for x in keyed], 7)
    got = {x["doc_id"]: x["shard"] for x in kdtree.shards(docs(rows), 7).collect()}
    assert got == {keyed[i]["doc_id"]: s for i, s in want.items()}


def test_kd_tree(docs, hard):
    r = random.Random(7)
    rows = [(i, "same text" if i < 500 else "t" * r.randint(0, 300), r.choice(["en", "de", None]), "hot" if i % 3 == 0 else f"s{i % 40}") for i in range(1500)]
    got = kdtree.shards(docs(rows)).collect()
    text = dict((i, t) for i, t, *_ in rows)
    by = collections.defaultdict(list)
    for x in got:
        assert x["size"] == len(text[x["doc_id"]].encode()) + 8 and x["text_crc32"] == zlib.crc32(text[x["doc_id"]].encode()) and x["law"] == "bytes" and x["grown_shard"] is None
        by[x["shard"]].append(x)
    assert sorted(by) == list(range(24)) and all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    mean = sum(x["size"] for x in got) / 24
    assert all(abs(sum(x["size"] for x in v) - mean) <= 700 for v in by.values())
    assert kdtree.shards(docs(hard)).count() == len(hard) and kdtree.shards(docs(hard).where("false")).count() == 0


def test_license_base_against_brute_force(docs, hard):
    rows = [*hard, (60, "Released under the MIT License. mit-license; CC BY! Apache  LICENSE"), (61, "gnu general public license " * 3), (62, "cc by cc by"), (63, "mit licenses")]
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(docs(rows)).collect()}
    for i, t, *_ in rows:
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or "")) if x]
        places = [(a, label) for p, label in licenses.PHRASES.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        r = got[(i, len(w))]
        assert r["n_base"] == len(places) and r["first_word"] == min((a for a, _ in places), default=None) and r["last_word"] == max((a for a, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licenses.scan(docs(rows).where("false")).count() == 0


def test_license_notices_within_edits(docs):
    rows = [(1, "Permision is hereby grantd, free of charge to"), (2, "Redistribution and use in source or binary forms"), (3, "All rights reservd"), (4, "all lights deserve"), (5, "Mozila Public Licence"), (6, "permission is granted")]
    got = {r["doc_id"]: r for r in licenses.scan(docs(rows)).collect()}
    assert [got[i]["labels"] for i in range(1, 7)] == ["mit", "bsd", "proprietary", "", "mpl", ""]
    assert 0.9 < got[1]["score"] < 1 and got[4]["score"] == 0
    s = got[1]["spans"][0]
    assert " ".join(licenses.normal(rows[0][1]))[s["start"] : s["end"]].startswith("permision is hereby") and s["edits"] == 2


def test_license_notices_against_search_without_seeds():
    import regex

    r = random.Random(3)
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    for _ in range(60):
        p, (label, e) = r.choice(list(licenses.NOTICES.items()))
        x = list(p)
        for _ in range(r.randint(0, e + 1)):
            x[r.randrange(len(x))] = r.choice("xyz ")
        text = "some words before " + "".join(x) + " and after it"
        every = regex.search(f"(?:{regex.escape(p)}){{e<={e}}}", text) is not None
        assert (label in {n[2] for n in scanner.notices(text)}) >= every


def test_license_spans_of_neighbouring_notices():
    r = random.Random(8)
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    assert [x[:3] for x in scanner.notices("all rights reservd all rights reserved")] == [(0, 18, "proprietary"), (19, 38, "proprietary")]
    assert [x[:2] for x in scanner.notices("mozila public license and mozilla public license here")] == [(0, 21), (26, 48)]
    for _ in range(120):
        text, planted = "", []
        for _ in range(r.randint(1, 6)):
            text += r.choice(["", "and ", "some other words ", "the "])
            p, (label, e) = r.choice(list(licenses.NOTICES.items()))
            x = list(p)
            n = r.randint(0, e)
            for at in r.sample(range(1, len(x) - 1), n):
                x[at] = r.choice(["", "q", x[at] + "q"])
            planted.append((len(text), len(text) + len("".join(x)), label, n))
            text += "".join(x) + " "
        found = scanner.notices(text)
        every = sorted((a, b, n.label, e) for n in scanner.fuzzy for a, b, e in n.places(text, 0, len(text)))
        assert found == every  # as without seeds
        for a, b, label, n in planted:  # none is lost
            assert any(x[2] == label and x[0] < b and a < x[1] for x in found), (text, a, b, label)


def test_chroma_search_finds_shifted_copies(docs):
    r = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(4000)]
    text = lambda n: " ".join(r.choice(words, n))
    rows = [(i, text(700)) for i in range(1, 50)]
    queries = [(50 * (k + 1), rows[k][1][37 + 13 * k :]) for k in range(10)] + [(600, rows[20][1]), (650, text(700)), (700, ""), (750, None)]
    got = {x["doc_id"]: x for x in chroma.search(chroma.recordings(docs(rows + queries + [(None, "x")]))).collect()}
    assert sorted(got) == [i for i, _ in queries]
    for k in range(10):
        x = got[50 * (k + 1)]
        assert (x["best_id"], x["best_offset"], x["best_error"]) == (k + 1, 37 + 13 * k, 0.0) and x["n_matches"] == 1
    assert got[600]["class_id"] == 21 and got[600]["n_copies"] == 1
    assert got[650]["n_matches"] == 0 and got[700]["n_copies"] == 1 == got[750]["n_copies"]
    assert chroma.search(chroma.recordings(docs(rows).where("false"))).count() == 0


def prints_of(text, phase=0):
    x = np.frombuffer(text.encode(), np.uint8).astype(np.float32) / 128 - 1
    frames, _ = chroma.chroma_frames([x[phase:]])
    return chroma.codes(frames)


def test_chroma_recall_against_all_offsets(docs):
    """Matches by landmarks against bit errors at every offset of every pair, for several kinds of edited copies."""
    r = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(3000)]
    base = [list(r.choice(words, 700)) for _ in range(15)]
    rows = [(i + 1, " ".join(b)) for i, b in enumerate(base)]
    queries = []
    for i, b in enumerate(base):
        q = list(b)
        if i % 5 == 0:  # one word changed
            q[int(r.integers(50, 600))] = "edited"
        elif i % 5 == 1:  # several letters changed in place
            for at in r.integers(0, 700, 4):
                q[at] = q[at][:-1] + "z"
        elif i % 5 == 2:  # cut at both ends, not between frames
            q = q[60:-80]
            q[0] = q[0][1:]
        elif i % 5 == 3:  # new words before
            q = [*r.choice(words, 40), *q]
        else:  # a word left out near the end
            del q[640]
        queries.append((50 * (i + 1), " ".join(q)))
    wanted = set()
    for q, text in queries:
        phases = [prints_of(text, p) for p in range(chroma.HOP)]
        for i, other in rows + [x for x in queries if x[0] != q]:
            b, best = prints_of(other), 1.0
            for a in phases:
                for s in range(-len(a) + 30, len(b) - 30):
                    x, y = a[max(0, -s) :], b[max(0, s) :]
                    n = min(len(x), len(y))
                    best = min(best, np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n))
            if best <= 0.25:
                wanted.add((q, i))
    got = chroma.search(chroma.recordings(docs(rows + queries))).collect()
    assert {(q, i) for q, i in wanted if i < 50} == {(50 * i, i) for i in range(1, 16)}
    assert np.mean([x["best_id"] == x["doc_id"] // 50 for x in got]) >= 0.9
    n = collections.Counter(q for q, _ in wanted)
    assert all(x["n_matches"] <= n[x["doc_id"]] for x in got)


def test_chroma_finds_all_wanted_pairs(docs):
    """The set of found pairs against bit errors at every offset, where recordings share heads and tails beside longer passages that stand
    elsewhere in both, and passages that are repeated: recall 0.9 at least, and nothing is found that is not wanted."""
    r = np.random.default_rng(9)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(3000)]
    some = lambda n: list(r.choice(words, n))
    rows, queries = [], []
    for i in range(8):
        head, middle = some(420), some(300)
        rows.append((i + 1, " ".join([*head, *some(60), *middle, *some(200)])))
        queries.append((50 * (i + 1), " ".join([*middle, *some(150 + 10 * i), *head])))  # its tail is the other's head
    for i in range(8, 12):
        b = some(350)
        rows.append((i + 1, " ".join([*b, *b, *some(40)])))  # the passage twice
        queries.append((50 * (i + 1), " ".join(b)))
    wanted = set()
    for q, text in queries:
        phases = [prints_of(text, p) for p in range(chroma.HOP)]
        for i, other in rows + [x for x in queries if x[0] != q]:
            b = prints_of(other)
            for a in phases:
                for s in range(-len(a) + 30, len(b) - 30):
                    x, y = a[max(0, -s) :], b[max(0, s) :]
                    n = min(len(x), len(y))
                    if np.bitwise_count(x[:n] ^ y[:n]).sum() <= 0.25 * 32 * n:
                        wanted.add((q, i))
    assert {(50 * i, i) for i in range(1, 13)} <= wanted
    found = {(x["query"], x["match"]) for x in chroma.matches(chroma.recordings(docs(rows + queries))).collect()}
    assert len(found & wanted) >= 0.9 * len(wanted) and found <= wanted


def test_chroma_errors_and_blocks(docs, monkeypatch):
    """Errors of matches against all 32 bits of each code, for groups of near copies; results are the same however blocks are cut."""
    r = np.random.default_rng(12)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(3000)]
    base, rows = list(r.choice(words, 120)), []
    for i in range(1, 20):
        near = list(base)
        for at in r.integers(0, 120, 4):
            near[at] = near[at][:-1] + "z"
        rows.append((i if i < 12 else 50 * (i - 11), " ".join(near)))
    rows += [(i, " ".join(r.choice(words, 90))) for i in range(20, 40)] + [(20, rows[0][1])]
    found = {(x["query"], x["match"]): x for x in chroma.matches(chroma.recordings(docs(rows))).collect()}
    texts, wanted = dict(rows), 0
    marks = lambda c, t: dict(zip(*(v.tolist() for v in chroma.landmarks(c, np.array([0, len(c)]), np.array([len(t)]))[1:])))
    for q, i in ((q, i) for q in texts if q >= 50 for i in texts if q != i and (i < 12 or i >= 50)):
        a, b = prints_of(texts[q]), prints_of(texts[i])
        votes, n = len(marks(a, texts[q]).items() & marks(b, texts[i]).items()), min(len(a), len(b))
        off = np.bitwise_count(a[:n] ^ b[:n]).sum() / (32 * n)
        least = min(k for k, t in texts.items() if prints_of(t).tolist() == b.tolist())  # equal codes are one class
        if off <= 0.25 and votes * chroma.FEWEST >= n and i == least:
            wanted += 1
            assert found[q, i]["error"] <= off
    assert wanted >= 20
    for (q, i), x in found.items():
        if i != 20:
            step = -(-x["offset"] // 64)
            a, b = prints_of(texts[q], -x["offset"] % 64)[max(0, -step) :], prints_of(texts[i])[max(0, step) :]
            n = min(len(a), len(b))
            assert x["error"] == np.bitwise_count(a[:n] ^ b[:n]).sum() / (32 * n)
    key = lambda df: sorted(map(str, df.collect()))
    whole = key(chroma.search(chroma.recordings(docs(rows))))
    for name, value in (("R_BLOCK", 200), ("Q_BLOCK", 300), ("AT_ONCE", 50), ("R_ROWS", 3), ("SENT", 5)):
        monkeypatch.setattr(chroma, name, value)
    assert key(chroma.search(chroma.recordings(docs(rows)))) == whole


def test_chroma_sends_rows_to_few_blocks(docs, monkeypatch):
    """Near copies are together however small blocks are, and rows that cannot have landmarks enough in common are not sent at all."""
    r = np.random.default_rng(21)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(3000)]
    rows, common = [], list(r.choice(words, 60))
    for g in range(24):
        base = list(r.choice(words, 500))
        for k in range(10):
            near = list(base)
            at = int(r.integers(20, 480))
            near[at] = near[at][:-1] + "z"
            rows.append((len(rows) + 1, " ".join(near)))
    many = lambda n: " ".join(r.choice(words, n))
    long = [(1000 + 50 * k, " ".join([many(1500), *common, many(1500)])) for k in range(4)]  # a short passage far from both ends
    key = lambda df: sorted(map(str, df.collect()))
    found = key(chroma.matches(chroma.recordings(docs(rows + long))))
    assert len(found) >= 20
    for name, value in (("R_BLOCK", 1), ("R_ROWS", 1), ("R_BLOCKS", 24)):
        monkeypatch.setattr(chroma, name, value)
    assert key(chroma.matches(chroma.recordings(docs(rows + long)))) == found

    def counted(error, best):  # a row for each row sent
        def run(asked, media):
            q, phase, i = (asked[c].to_numpy() for c in ("q", "phase", "i"))
            return pa.table({"q": q, "r": q, "votes": phase.astype(np.int64), "offset": i, "error": i.astype(float)})

        return run

    monkeypatch.setattr(chroma, "_matched", counted)
    sent = chroma.matches(chroma.recordings(docs(rows + long))).collect()
    queries = {x["query"] for x in sent}
    assert queries == {50, 100, 150, 200}
    assert len(sent) <= 6 * len({(x["query"], x["votes"]) for x in sent})


def test_chroma_takes_hard_rows(docs, hard):
    got = chroma.search(chroma.recordings(docs([*hard, (50, hard[6][1]), (100, None), (150, "some other words of its own")]))).collect()
    assert {(x["doc_id"], x["class_id"], x["n_copies"]) for x in got} == {(50, 5, 2), (100, 2, 2), (150, 150, 0)}


def test_chroma_batches_do_not_change_prints(docs, monkeypatch):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcdef ") for _ in range(r.choice([0, 3, 130, 400, 2000])))) for i in range(40)]
    media = chroma.recordings(docs(rows))
    key = lambda df: sorted((x["doc_id"], x["codes"], sorted(map(tuple, x["marks"]))) for x in df.collect())
    whole = key(chroma.fingerprints(media))
    for i, c, marks in whole:
        own = prints_of(rows[i][1]).view(np.int32).tolist()
        assert c == own
        h = chroma.landmarks(np.array(own, np.int32).view(np.uint32), np.array([0, len(own)]), np.array([len(rows[i][1])]))[1].tolist()
        assert sorted(h) == [m[0] for m in marks]


def test_wav_samples(spark, docs):
    row = chroma.recordings(docs([(1, "hello")])).first()
    assert bytes(row["wav"])[:4] == b"RIFF" and np.allclose(chroma.samples(bytes(row["wav"])), np.frombuffer(b"hello", np.uint8) / 128 - 1)
    import io
    import wave

    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([100, 300, -200, 0], "<i2").tobytes())
    assert np.allclose(chroma.samples(buf.getvalue()), np.array([200, -100]) / 32768)
    tone = lambda rate: np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    for rate, width in ((16000, 3), (44100, 4), (8000, 2)):
        buf = io.BytesIO()
        with wave.open(buf, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(rate)
            w.writeframes((tone(rate) * ((1 << (8 * width - 1)) - 1)).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
        assert np.abs(chroma.samples(buf.getvalue()) - tone(8000)).max() < 0.01
    assert len(chroma.samples(buf.getvalue().replace(b"fmt \x10\0\0\0\1", b"fmt \x10\0\0\0\3"))) == 0


def test_cotraining_held_out_accuracy(docs, spark, hard):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(600)]
    rows, labels = list(hard), []
    for i in range(1000, 1900):
        w, kind = [r.choice(words) for _ in range(r.randint(20, 90))], r.choice(["good", "good", "shout", "symbols", "toxic"])
        if kind == "toxic":
            w = [x if r.random() > 0.12 else r.choice(["idiot", "trash", "moron"]) for x in w]
        text = " ".join(w)
        text = text.upper() if kind == "shout" else text.replace(" ", "### ") if kind == "symbols" else text
        rows.append((i, text, "en", f"s{i % 5}"))
        labels.append((i, int(kind in ("good", "toxic")), int(kind == "toxic")))
    known = spark.createDataFrame(labels[:500] + [(None, 1, 0), (1000, None, 0), (5, 1, None)], "doc_id long, quality long, toxic long")
    got = {x["doc_id"]: x for x in cotraining.classify(docs(rows), known).collect() if x["doc_id"] and x["doc_id"] >= 1500}
    right = [got[i]["kept"] == (q == 1 and t == 0) for i, q, t in labels[500:]]
    assert np.mean(right) >= 0.95
    assert cotraining.classify(docs(hard), known.where("false")).where("kept").count() == len(hard)
    assert cotraining.classify(docs(hard).where("false"), known).count() == 0


def test_fit_against_a_plain_solver():
    r = np.random.default_rng(3)
    x, label = r.normal(size=(80, 5)), (r.random(80) < 0.4).astype(float)
    rows = cotraining.Rows(np.arange(81) * 5, np.tile(np.arange(5), 80), x.ravel(), 5)
    x, w = x.astype(np.float32).astype(float), np.zeros(6)
    for _ in range(20000):  # plain gradient descent
        p = 1 / (1 + np.exp(-(x @ w[:5] + w[5])))
        w -= 0.5 * np.append(x.T @ (p - label) / 80 + 0.01 * w[:5], (p - label).mean())
    assert np.abs(cotraining.fit(rows, label, 0.01, 500) - w).max() < 5e-3


def test_cotraining_against_a_plain_loop(docs, spark, monkeypatch):
    """The rounds as a loop over dense rows of the whole table, without Spark."""
    monkeypatch.setattr(cotraining, "LEAST", 3)
    monkeypatch.setattr(cotraining, "CONFIDENT", 0.8)
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["good", "fine", "nice", "plain"] if i % 2 else ["bad", "poor", "plain"]) for _ in range(r.randint(3, 12))), "en", r.choice("ab" if i % 2 else "bc")) for i in range(160)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(60)]
    got = {x["doc_id"]: x for x in cotraining.classify(docs(rows), spark.createDataFrame(labels, "doc_id long, quality long, toxic long")).collect()}
    data = "".join(t for _, t, *_ in rows).encode()
    at = np.concatenate(([0], np.cumsum([len(t.encode()) for _, t, *_ in rows])))
    views = dict(zip(("text", "meta"), cotraining.views(np.frombuffer(data, np.uint8), at, [x[3] for x in rows], ["en"] * len(rows))))
    held = np.array([int(hashlib.md5(f"fold|{i}".encode()).hexdigest()[:13], 16) / (1 << 52) * cotraining.HELD_OUT < 1 for i in range(60)])
    names, reg = {"text": cotraining.WORDS, "meta": 2 * cotraining.NAMES}, {"text": 1e-4, "meta": 1e-3}
    p = {}
    for target, column in (("quality", 1), ("toxic", 2)):
        label = np.array([x[column] for x in labels], float)
        train = np.flatnonzero(~held)
        w = {k: cotraining.fit(v.take(train), label[train], reg[k]) for k, v in views.items()}
        for _ in range(cotraining.ROUNDS):
            sure = {k: 1 / (1 + np.exp(-cotraining.logit(v, w[k]))) for k, v in views.items()}
            after = {}
            for mine, other in (("text", "meta"), ("meta", "text")):
                has, total = np.zeros((names[mine], 2)), np.zeros(2)
                for i in range(60, len(rows)):
                    if abs(sure[other][i] - 0.5) >= 0.3:
                        kind = int(sure[other][i] >= 0.5)
                        total[kind] += 1
                        for j in views[mine].index[views[mine].at[i] : views[mine].at[i + 1]]:
                            if j < names[mine]:
                                has[j, kind] += 1
                if total.min() < 3:
                    after[mine] = cotraining.fit(views[mine].take(train), label[train], reg[mine])
                    continue
                share = (has + 0.5) / (total + 1)
                lesson = np.zeros(views[mine].width)
                lesson[: names[mine]] = np.where(has.sum(1) > 0, np.log(share[:, 1] / (1 - share[:, 1])) - np.log(share[:, 0] / (1 - share[:, 0])), 0)
                after[mine] = cotraining.taught(views[mine].take(train), label[train], reg[mine], lesson)
            w = after
        check = np.flatnonzero(held)
        z = 0
        for k, v in views.items():
            slope, shift = cotraining.platt(cotraining.logit(v.take(check), w[k]), label[check])
            z = z + slope * cotraining.logit(v, w[k]) + shift
        prior = (label.sum() + 1) / 62
        p[target] = 1 / (1 + np.exp(-np.clip(z - np.log(prior / (1 - prior)), -30, 30)))
    assert max(abs(got[i]["quality"] - p["quality"][i]) for i in got) < 1e-3
    assert max(abs(got[i]["toxic"] - p["toxic"][i]) for i in got) < 1e-3


def test_notices_come_from_a_table(docs, spark):
    table = spark.createDataFrame([("Example Public Licence, 1.1", "epl-1", 2), ("example public licence 1.1", "epl-1", 1), (None, "x", 1), ("no label", None, 1), ("...", "y", 1)], "text string, label string, edits int")
    got = {r["doc_id"]: r for r in licenses.scan(docs([(1, "under the exampel Public licence 1.1 here"), (2, "mozilla public license")]), notices=table).collect()}
    assert got[1]["labels"] == "epl-1" and [s.asDict() for s in got[1]["spans"]] == [{"start": 10, "end": 36, "label": "epl-1", "edits": 2}] and got[2]["labels"] == ""
    usual = {r["doc_id"]: r["labels"] for r in licenses.scan(docs([(1, "GNU Affero General Public Licence v3"), (2, "Creative Commons Attribution-ShareAlike 4.0"), (3, "Boost Software Licence"), (4, "nothing of the kind")])).collect()}
    assert "agpl" in usual[1] and "cc-by-sa" in usual[2] and usual[3] == "boost" and usual[4] == ""


def test_likeness_follows_from_fingerprints(docs, spark):
    """Likeness needs nothing but two fingerprints, those made by adding and deleting too, and is near the share of common paragraphs."""
    from pyspark.sql import functions as F

    lines = lambda a, b: "\n".join(f"line {i}" for i in range(a, b))
    rows = [(lines(0, n), lines(0, n * 3 // 4), lines(n * 3 // 4, n), lines(n, 2 * n)) for n in (4, 40, 400, 4000)]
    d = spark.createDataFrame([*rows, ("", "", "", "x")], "a string, b string, c string, d string")
    f = {x: multiset_hash.fingerprint(F.col(x)) for x in "abcd"}
    near = multiset_hash.likeness
    got = d.select(near(f["a"], f["b"]).alias("part"), near(f["a"], f["d"]).alias("other"), near(f["a"], multiset_hash.plus(f["c"], f["b"])).alias("sum"), near(f["b"], multiset_hash.minus(f["a"], f["c"])).alias("rest"), (multiset_hash.as_text(f["a"]) == multiset_hash.as_text(multiset_hash.plus(f["b"], f["c"]))).alias("text")).collect()
    for r, n in zip(got, (4, 40, 400, 4000)):
        assert abs(r["part"] - 3 / 4) < 0.15 and r["other"] < 0.2 and r["sum"] == r["rest"] == 1 and r["text"]
    assert got[4]["part"] == 1 and got[4]["other"] == 0
