import os
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkevidence.llm import merge_dropout, orc_tokens
from sparkevidence.llm.hashing import BASE, BASE2, U, mix
from sparkevidence.llm.shared import new_path

pytest.importorskip("public_tokenizers")


def reference_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(orc_tokens.word_tokenizer()).encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = ["Hello World's THE-end 12", None, "", "a<|endoftext|>b and <|ENDOFTEXT|>", "É café ﬁ ΣΑΣ İstanbul", "tabs\tand\x0bfeeds\x1cgo  on", "漢字 かな 😀", "don't I'LL we've x's't ÉCOLE Œuvre ß Ǆ ª² ¼ ÷× e\u0301 A\u030a", " ".join(f"word{i}" for i in range(5000))]


def test_word_ids_are_those_of_the_whole_text():
    encoder = orc_tokens.WordEncoder(orc_tokens.word_tokenizer())
    assert [np.frombuffer(encoder.encode((t or "").encode()), "<u4").tolist() for t in TEXTS] == [reference_ids(t)[:-1] for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aZ09'’.,!?<|>_-éÉßİıÅ\u0301\u030a\u200d漢か😀 \t\n\x1c\x85\xa0")), max_size=40))
def test_any_text_has_the_ids_of_the_whole_text(text):
    global _encoder
    _encoder = globals().get("_encoder") or orc_tokens.WordEncoder(orc_tokens.word_tokenizer())
    assert np.frombuffer(_encoder.encode(text.encode()), "<u4").tolist() == _encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_stripes_and_bloom_filters(spark, tmp_path, monkeypatch):
    """A file of several stripes is read by several tasks, and a read for ids that no stripe has reads no row."""
    from pyarrow import orc
    from pyspark.sql import functions as F

    monkeypatch.setitem(orc_tokens.ORC_OPTIONS, "orc.stripe.size", str(1 << 16))
    rows = spark.range(0, 40000, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha1(F.concat(F.col("id").cast("string"), F.lit(str(i)))) for i in range(3)]).alias("text"))
    orc_tokens.write_tokens(rows.coalesce(1), str(tmp_path / "t"))
    files = list((tmp_path / "t").glob("*.orc"))
    assert max(orc.ORCFile(str(f)).nstripes for f in files) > 1
    raw = b"".join(f.read_bytes() for f in files)
    assert orc.ORCFile(str(files[0])).compression == "ZSTD" and len(raw) > 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(f.stat().st_size for f in files) // 2))
    try:
        assert orc_tokens.read_tokens(spark, str(tmp_path / "t")).rdd.getNumPartitions() > len(files)
        assert orc_tokens.read_tokens(spark, str(tmp_path / "t")).count() == 20000
        for ids, scanned in (([1001], 0), ([1002], 1)):  # an odd id lies within a stripe's least and greatest, only its filter says no
            df = orc_tokens.read_tokens(spark, str(tmp_path / "t"), doc_ids=ids)
            assert df.count() == scanned
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tokens_take_hard_rows(docs, hard):
    got = orc_tokens.tokenized(docs(hard)).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(reference_ids(h[1])) for h in hard)


def test_report_from_files(docs):
    rows = list(enumerate(TEXTS, 10)) + [(10, TEXTS[0]), (None, "first of all")]
    got = orc_tokens.tokenized(docs(rows)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 10, 10, *range(11, 19)]
    at = 0
    for r in got:
        text = "first of all" if r["doc_id"] is None else TEXTS[r["doc_id"] - 10]
        ids = reference_ids(text)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert orc_tokens.tokenized(docs(rows).where("false")).count() == 0


def test_start_is_the_place_in_the_files(spark, docs):
    """Rows of one id with texts of many lengths, over several files: each row's ids are found at its start."""
    from pyarrow import orc

    rows = [(7, "word " * n) for n in (98, 18, 59, 7, 27, 35, 35)] + [(i, f"row {i}") for i in range(20)]
    path = new_path(spark, "t")
    orc_tokens.write_tokens(docs(rows), path, file_rows=3)
    folder = path.removeprefix("file:")
    files = sorted(x for x in os.listdir(folder) if x.endswith(".orc"))
    read = [r for f in files for r in orc.ORCFile(f"{folder}/{f}").read().to_pylist()]
    flat = [t for r in read for t in r["ids"]]
    assert [r["doc_id"] for r in read] == sorted(r[0] for r in rows) and len({f for f in files}) > 7
    got = orc_tokens.token_report(spark, path).orderBy("start").collect()
    assert [(x["doc_id"], x["n_tokens"]) for x in got] == [(r["doc_id"], len(r["ids"])) for r in read]
    for x in got:
        ids = np.array(flat[x["start"] : x["start"] + x["n_tokens"]], "<u4")
        assert ids[-1] == 1 and (ids[:-1] != 1).all() and zlib.crc32(ids.tobytes()) == x["ids_crc32"]


def test_reads_are_pruned(spark, docs):
    path = new_path(spark, "t")
    orc_tokens.write_tokens(docs([(i, f"text {i}") for i in range(50)]), path)
    one = orc_tokens.read_tokens(spark, path, doc_ids=[7])
    assert [r["doc_id"] for r in one.collect()] == [7]
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()
    assert orc_tokens.read_tokens(spark, path, least=10, most=12).count() == 3


def test_without_dropout_ids_are_the_models(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.piece_model())
    texts = ["Hello  world", " leading and trailing ", "tabs\tand\nlines\n\n", "naïve café 漢字 😀 \u0000x", "aaaaaaaaaaaaaaaaaaaa", "", "x" * 3000]
    got = {r["doc_id"]: r["ids"] for r in merge_dropout.encode(docs(list(enumerate(texts))), dropout=0).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sp.encode(t), t


def test_dropout_varies_and_decodes_losslessly(docs, hard, spark):
    text = "an unbelievably interesting sentence about international organisations " * 40
    rows = [*hard, (50, text), (51, text)]
    encoded = merge_dropout.encode(docs(rows)).collect()
    plain = {r["doc_id"]: len(r["ids"]) for r in merge_dropout.encode(docs(rows), dropout=0).collect()}
    a, b = (next(r["ids"] for r in encoded if r["doc_id"] == i) for i in (50, 51))
    assert a != b and len(a) > plain[50]
    again = merge_dropout.encode(docs(rows).repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in encoded) == sorted((str(r["doc_id"]), r["ids"]) for r in again)
    back = merge_dropout.decode(merge_dropout.encode(docs(rows))).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows)
    report = merge_dropout.round_trip(docs(rows)).collect()
    assert all(r["lossless"] for r in report)
    assert next(r for r in report if r["doc_id"] == 50)["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert merge_dropout.encode(docs(rows).where("false")).count() == 0


def test_every_occurrence_skips_by_itself(docs):
    encoder = merge_dropout.DropoutEncoder(merge_dropout.piece_model(), 0.1)
    one = encoder.encode([" ".join(["a"] * 6000)], [5])[0]
    plain = merge_dropout.DropoutEncoder(merge_dropout.piece_model(), 0).encode(["a"], [5])[0]
    assert len(plain) == 4
    assert 0.08 < len(one) / 4 / 6000 - 1 < 0.12  # one merge each: a skip makes two pieces of one
    word = " internationally"
    with np.errstate(over="ignore"):
        keys = mix(U(9) + np.arange(3000, dtype=U) * U(BASE))
    alone = encoder.segment([word] * 3000, keys)[0]
    assert len(set(alone)) > 4
    assert encoder.encode([(word * 3000)[1:]], [9])[0] == b"".join(alone)  # the kept cut is that of an occurrence without skips
    assert encoder.decode(np.frombuffer(b"".join(alone), "<u4").tolist()) == (word * 3000)[1:]


def test_stage_cuts_copies_apart(docs, spark):
    text = "an unbelievably interesting sentence about international organisations " * 20
    rows = merge_dropout.encode_stage(spark, docs([(1, text)] * 3 + [(2, None)]), "").collect()
    assert len({tuple(r["ids"]) for r in rows if r["doc_id"] == 1}) == 3 and len(rows) == 4
    assert {r["text"] for r in merge_dropout.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()} == {text, ""}


def naive_cut(encoder, chunk, key):
    """Merges one by one over a plain list: the best rank first, the leftmost on ties; a skipped pair is looked at again when its
    symbols change."""
    sp, n = encoder.sp, encoder.base
    ids = {sp.id_to_piece(i).replace("▁", " "): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    rank = {i: k for k, i in enumerate(sorted(range(n), key=lambda i: (-sp.get_score(i), i)))}
    parts = [(i, c) for i, c in enumerate(chunk)]
    while True:
        best = None
        for k in range(len(parts) - 1):
            (a, x), (b, y) = parts[k], parts[k + 1]
            skipped = int(mix(np.array([key ^ ((a * BASE + b * BASE2) & ((1 << 64) - 1))], U))[0]) >> 32 < encoder.threshold
            if x in ids and y in ids and x + y in ids and not skipped and (best is None or rank[ids[x + y]] < best[0]):
                best = (rank[ids[x + y]], k)
        if best is None:
            return [j for _, x in parts for j in ([ids[x]] if x in ids else [encoder.bytes[b] for b in x.encode()])]
        k = best[1]
        parts[k : k + 2] = [(parts[k][0], parts[k][1] + parts[k + 1][1])]


def test_dropout_against_naive_merges(monkeypatch):
    import random

    r = random.Random(2)
    for dropout in (0.1, 0.5):
        encoder = merge_dropout.DropoutEncoder(merge_dropout.piece_model(), dropout)
        chunks = [" internationally", "  unbelievable", "naïve漢字", "a", " aaaaaaaaaaaa", "x" * 40] + ["".join(r.choice("etaoinshr é") for _ in range(r.randint(1, 30))).replace("  ", " ") for _ in range(40)]
        chunks = [c.replace(" ", "") or "q" for c in chunks] + chunks[:2]
        keys = np.array([r.getrandbits(64) for _ in chunks], U)
        got = encoder.segment(chunks, keys)[0]
        for c, k, g in zip(chunks, keys.tolist(), got):
            assert np.frombuffer(g, "<u4").tolist() == naive_cut(encoder, c, k), c
        # Long chunks have an agenda of their own, with the same cuts and the same candidates.
        both = [encoder._cut_long(c, k)[0] for c, k in zip(chunks, keys.tolist())]
        assert both == got
        plain, row, pair = encoder.segment(chunks, None)
        for i, c in enumerate(chunks):
            ids, seen = encoder._cut_long(c, None)
            assert ids == plain[i] and sorted(seen.tolist()) == sorted(pair[row == i].tolist())


def test_a_very_long_chunk_takes_time_in_proportion():
    import time

    encoder = merge_dropout.DropoutEncoder(merge_dropout.piece_model(), 0.1)
    text = "thequickbrownfoxjumpsoverthelazydog" * 6000
    began = time.time()
    ids = encoder.encode([text], [3])[0]
    assert time.time() - began < 30
    assert encoder.decode(np.frombuffer(ids, "<u4").tolist()) == text
