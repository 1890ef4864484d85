import functools
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkevidence.operators import repair


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


CASES = [
    ("a line that goes on\nin the next one\nand ends. \nA new one", "a line that goes on in the next one and ends.\nA new one"),
    ("# heading\ntext below\nit goes on\n\nafter a blank", "# heading\ntext below it goes on\n\nafter a blank"),
    ("- first item\n- second item\nmore", "- first item\n- second item\nmore"),
    ("1. one\n2) two\n| a | b |\n| c | d |\nword\nword", "1. one\n2) two\n| a | b |\n| c | d |\nword word"),
    ("see https://example.org/x\nnext line\ngoes on", "see https://example.org/x\nnext line goes on"),
    ("run this:\npip list\nprose here\nand here", "run this:\npip list\nprose here and here"),
    ("prose\n```\ncode line\ncode line\n```\nprose\nprose", "prose\n```\ncode line\ncode line\n```\nprose prose"),
    ("key = value\nother text\nmore", "key = value\nother text more"),
    ("", ""), (None, None), ("   \n  ", "\n"), ("one", "one"), ("Page 3\ntext\ntext", "Page 3\ntext text"),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_wrapped_lines(spark, text, want):
    assert one(spark, repair.join_wrapped_lines, text) == want


def test_many_lines(spark):
    assert one(spark, repair.join_wrapped_lines, "\n".join(["word"] * 20_000)) == " ".join(["word"] * 20_000)


def fewest(word, known):
    """Fewest parts, longest first, by trying all."""

    @functools.cache
    def best(i):
        found = [(1 + rest[0], [word[i : i + n], *rest[1]]) for n in range(len(word) - i, 1, -1) if word[i : i + n].lower() in known and (rest := best(i + n))]
        return min(found, key=lambda x: x[0]) if found else None if i < len(word) else (0, [])

    got = best(0)
    return " ".join(got[1]) if got and got[0] >= 2 else None


def test_segments_are_the_fewest(spark):
    r = random.Random(2)
    known = {"".join(r.choice("abé") for _ in range(r.randint(1, 5))) for _ in range(60)}
    words = sorted({"".join(r.choice(sorted(known)) for _ in range(r.randint(2, 9))) for _ in range(120)} | {"ABab" * 5, "zzzz" * 6, "a" * 900})
    got = {x["word"]: x["repaired"] for x in repair.segmented(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(k,) for k in known], "word string")).collect()}
    assert got == {w: f for w in words if (f := fewest(w, known))}


def test_texts_are_repaired(spark):
    known = ["Attention", "please", "read", "this", "everything", "read this"]
    text = "Attentionpleasereadthis, said X.\nhttps://example.org/attentionpleasereadthis\n```\nattentionpleasereadthis\n```\nAttentionpleasereadthis, nosuchwordsknownhere everythingeverything"
    want = "Attention please read this, said X.\nhttps://example.org/attentionpleasereadthis\n```\nattentionpleasereadthis\n```\nAttention please read this, nosuchwordsknownhere everything everything"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "short words only"), (5, text)], "doc_id long, text string")
    got = {x["doc_id"]: (x["text"], x["n_glued"]) for x in repair.repair_glued_words(rows, spark.createDataFrame([(k,) for k in known], "word string"), "doc_id", "text").collect()}
    assert got == {1: (want, 2), 2: (None, 0), 3: ("", 0), 4: ("short words only", 0), 5: (want, 2)}
    assert re.sub(r"\s", "", got[1][0]) == re.sub(r"\s", "", text)


def test_known_long_words_stay(spark):
    rows = spark.createDataFrame([(1, "internationalization international ization")], "doc_id long, text string")
    known = spark.createDataFrame([("internationalization",), ("international",), ("ization",)], "word string")
    assert repair.repair_glued_words(rows, known, "doc_id", "text").first()["n_glued"] == 0
