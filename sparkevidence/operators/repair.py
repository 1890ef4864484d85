"""Repair of extracted text: soft-wrapped lines become paragraphs again, words that were glued together come apart."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkevidence.sources.cuts import cut

#: Lines that are never joined with others: headings, list items, table rows, page marks. Fixed values.
APART = (r"^#{1,6}[ \t]", r"^[-*•][ \t]+[^ \t]", r"^[0-9]+[.)][ \t]+[^ \t]", r"^\|.*\|$", r"^\[?[Pp]age [0-9]+\]?$")
#: Lines that look like code: addresses and paths, names of command-line tools, brackets and assignments. Fixed values.
CODE = (r"https?://|[A-Za-z]:\\|/[A-Za-z0-9_.-]+/", r"\b(curl|docker|npm|npx|python|pip|git|psql)\b", r"[{}\[\];]|^[ \t]*[A-Za-z_][A-Za-z0-9_]*[ \t]*[:=]")
#: Ends after which a new paragraph begins. Fixed values.
ENDS = r"[.!?:;]$"
#: Letters from which a word may be several, and letters of the longest dictionary word that is tried.
GLUED, LONGEST = 16, 32


def _any(line: Column, shapes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for shape in shapes:
        out = out | line.rlike(shape)
    return out


def looks_like_code(line: Column) -> Column:
    return _any(line, CODE)


def stays_apart(line: Column) -> Column:
    """Blank lines, and those that are never joined."""
    return (line == "") | _any(line, APART) | looks_like_code(line)


def _outside_fences(text: Column, prose) -> Column:
    parts = F.split(text, "```")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, prose(x)).otherwise(x)), "```")


def join_wrapped_lines(text: Column) -> Column:
    """The text with each line that goes on in the next joined to it by a space, outside code fences.

    A line is joined to the one before if neither stays apart and the one before has no end mark. Whether it is depends on these two
    lines alone, so lines are taken as an array and joined in one pass, whatever their number. Lines lose white space at their ends.
    """

    def prose(part: Column) -> Column:
        described = F.transform(F.split(part, "\n"), lambda x: F.struct(F.btrim(x, F.lit(" \t\r")).alias("x"), stays_apart(F.btrim(x, F.lit(" \t\r"))).alias("apart"), F.btrim(x, F.lit(" \t\r")).rlike(ENDS).alias("ends")))

        def joined(lines: Column) -> Column:
            before = lambda i: F.get(lines, i - 1)
            goes_on = lambda x, i: (i > 0) & ~x["apart"] & ~before(i)["apart"] & ~before(i)["ends"]
            return F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(i == 0, "").when(goes_on(x, i), " ").otherwise("\n"), x["x"])), "")

        return F.element_at(F.transform(F.array(described), joined), 1)

    return _outside_fences(text, prose)


def words_apart(text: Column) -> Column:
    """Runs of letters and of other characters, in turn; together they are the text."""
    return F.split(text, r"(?<=\p{L})(?=[^\p{L}])|(?<=[^\p{L}])(?=\p{L})")


def _prose_lines(text: Column) -> Column:
    """Lines outside fences that do not look like code."""
    parts = F.filter(F.transform(F.split(text, "```"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: p["i"] % 2 == 0)
    return F.filter(F.flatten(F.transform(parts, lambda p: F.split(p["x"], "\n"))), lambda x: ~looks_like_code(x))


def long_words(text: Column, least: int = GLUED) -> Column:
    """Distinct words of so many letters and more, in prose lines."""
    words = F.flatten(F.transform(_prose_lines(text), lambda x: F.regexp_extract_all(x, F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))))
    return F.array_distinct(words)


def _fewest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, size, pieces array<struct<at, n>>) to (word, parts): the fewest pieces that make up the word, the longest first on ties."""
    for batch in batches:
        out = []
        for size, pieces in zip(batch["size"].to_pylist(), batch["pieces"].to_pylist()):
            starts: list[list[int]] = [[] for _ in range(size)]
            for p in pieces:
                starts[p["at"]].append(p["n"])
            # From the end: how many pieces the rest takes, and how long its first one is.
            best: list[tuple[int, int] | None] = [None] * size + [(0, 0)]
            for i in range(size - 1, -1, -1):
                best[i] = min(((best[i + n][0] + 1, -n) for n in starts[i] if best[i + n]), default=None)
            parts, i = [], 0
            if best[0]:
                while i < size:
                    parts.append(-best[i][1])
                    i += parts[-1]
            out.append(parts)
        yield pa.RecordBatch.from_arrays([batch["word"], pa.array(out, pa.list_(pa.int32()))], names=["word", "parts"])


def segmented(words: DataFrame, dictionary: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, repaired): of distinct words (word), those that two or more words of the dictionary (word) make up, with spaces between.

    Every stretch of two to `longest` letters meets the dictionary by a join, so the dictionary may have any size; the stretches that
    are words of it are gathered for each word, which bounds a group by its length. Case does not matter and is kept.
    """
    low = F.lower("word")
    stretches = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    sizes = F.sequence(F.lit(2), F.least(F.lit(longest), F.length("word") - F.col("at") + 1))
    stretches = stretches.select("word", "at", F.explode(sizes).alias("n")).withColumn("piece", F.substring(low, F.col("at"), F.col("n")))
    known = dictionary.select(F.lower("word").alias("piece")).where(F.length("piece").between(2, longest)).distinct()
    # Stretches are many times the words whose size Spark knows, so they are never to be broadcast.
    pieces = stretches.hint("merge").join(known, "piece").groupBy("word").agg(F.collect_list(F.struct((F.col("at") - 1).alias("at"), "n")).alias("pieces"))
    parts = pieces.select("word", F.length("word").alias("size"), "pieces").mapInArrow(_fewest, "word string, parts array<int>").where(F.size("parts") >= 2)
    before = lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda s, n: s + n)
    return parts.select("word", F.array_join(F.transform("parts", lambda n, i: F.substring("word", before(i) + 1, n)), " ").alias("repaired"))


def repair_glued_words(rows: DataFrame, dictionary: DataFrame, key: str, text: str, least: int = GLUED, longest: int = LONGEST) -> DataFrame:
    """(key, text, n_glued): rows with glued words taken apart, and how many distinct ones they had.

    A word of `least` letters or more is glued if it is not in the dictionary itself and two or more of its words make it up; fewest words win. Each *distinct* word
    is looked at once, however often it occurs, and what was found is joined back. Lines that look like code and code fences stay. A
    null text stays null; key has to be unique.
    """
    seen = rows.select(key, F.explode(long_words(F.col(text), least)).alias("word"))
    known = dictionary.select(F.lower("word").alias("lower")).distinct()
    words = cut(seen.select("word").distinct().join(known, F.lower("word") == F.col("lower"), "left_anti"), "long-words")
    found = cut(segmented(words, dictionary, longest), "segmented")
    fixes = seen.join(found, "word").groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "repaired")))).alias("fixes"))
    line = lambda x: F.when(looks_like_code(x), x).otherwise(F.array_join(F.transform(words_apart(x), lambda w: F.coalesce(F.element_at("fixes", w), w)), ""))
    fixed = _outside_fences(F.col(text), lambda part: F.array_join(F.transform(F.split(part, "\n"), line), "\n"))
    both = rows.select(key, text).join(fixes, key, "left")
    return both.select(key, F.when(F.col("fixes").isNull(), F.col(text)).otherwise(fixed).alias(text), F.coalesce(F.size("fixes"), F.lit(0)).alias("n_glued"))
