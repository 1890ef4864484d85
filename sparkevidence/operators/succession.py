"""What became of keys that are no longer found: successor candidates by blocks of equal features, and reconciliation into five classes
with blockers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators.reviews import reasons
from sparkevidence.sources.cuts import cut

#: Points of each sign that a key succeeds another, and points from which it is a candidate. Fixed values.
SAME_TITLE, SAME_LAST, SAME_SUFFIX, ALIKE_TITLE, CANDIDATE = 2, 1, 1, 1, 2
#: Share of common title tokens from which titles are alike. Fixed value.
ALIKE = 0.67
#: Pairs of classes of one last path part up to which all of them are compared. Fixed value.
FEW = 1024


def features(rows: DataFrame, key: str = "document_key", title: str = "title") -> DataFrame:
    """(key, title, last, suffix, class, tokens): title is 128 bits of a hash of the normalised title, last and suffix are the last and
    last two parts of the key's path, class 128 bits of a hash of last and the title's distinct tokens; empty ones are null."""
    path = F.filter(F.split(F.lower(F.col(key)), "/"), lambda x: x != "")
    told = rows.select(key, T.tokens(F.coalesce(F.col(title), F.lit(""))).alias("words"), path.alias("path"))
    last = F.try_element_at("path", F.lit(-1))
    suffix = F.when(F.size("path") >= 2, F.concat_ws("/", F.try_element_at("path", F.lit(-2)), last))
    tokens = F.when(last.isNotNull() & (F.size("words") > 0), F.array_sort(F.array_distinct("words")))
    told = told.select(key, F.unhex(F.md5(F.nullif(F.array_join("words", " "), F.lit("")))).alias("title"), last.alias("last"), suffix.alias("suffix"), tokens.alias("tokens"))
    return told.withColumn("class", F.unhex(F.md5(F.concat("last", F.lit("/"), F.array_join("tokens", " "))))).distinct()


def _alike(m: str, f: str) -> Column:
    return F.size(F.array_intersect(m, f)) >= F.lit(ALIKE) * F.size(F.array_union(m, f)) - 1e-9


def _by_rare_tokens(missing: DataFrame, found: DataFrame) -> DataFrame:
    """(m, f): classes (m, last, m_t) and (f, last, f_t) with alike tokens: of tokens in order of their frequency, the first size - least
    + 1 have one in common. Tokens travel with a class once, not with each token of it."""
    words = lambda df, name: df.select(name, "last", F.size(f"{name}_t").alias(f"{name}_n"), F.explode(f"{name}_t").alias("t"))
    freq = words(missing, "m").select("t").unionAll(words(found, "f").select("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        size = F.col(f"{name}_n")
        rank = F.row_number().over(Window.partitionBy(name).orderBy("n", "t"))
        return words(df, name).join(freq, "t").withColumn("_r", rank).where(F.col("_r") <= size - F.ceil(size * F.lit(ALIKE) - 1e-9) + 1).drop("_r", "n")

    both = prefix(missing, "m").join(prefix(found, "f"), ["last", "t"]).where(F.least("m_n", "f_n") >= F.lit(ALIKE) * F.greatest("m_n", "f_n") - 1e-9).select("m", "f").distinct()
    return both.join(missing.select("m", "m_t"), "m").join(found.select("f", "f_t"), "f").where(_alike("m_t", "f_t")).select("m", "f")


def _alike_titles(missing: DataFrame, found: DataFrame) -> DataFrame:
    """(m, f): classes of both sides' rows whose last path parts are equal and whose title tokens are alike. Where a last part has FEW
    pairs of classes all are compared, else those that share a rare token."""
    classes = lambda df, *more: df.where(F.col("class").isNotNull()).select("class", "last", *more).distinct()
    number = lambda df, name: classes(df).groupBy("last").agg(F.count(F.lit(1)).alias(name))
    lasts = cut(number(missing, "nm").join(number(found, "nf"), "last").select("last", (F.col("nm") * F.col("nf")).alias("pairs")), "lasts")
    side = lambda df, name, of: classes(df, "tokens").join(of, "last", "left_semi").select(F.col("class").alias(name), "last", F.col("tokens").alias(f"{name}_t"))
    few, many = lasts.where(F.col("pairs") <= FEW), lasts.where(F.col("pairs") > FEW)
    alike = side(missing, "m", few).join(side(found, "f", few), "last").where(_alike("m_t", "f_t")).select("m", "f")
    if many.isEmpty():
        return alike
    return alike.unionByName(_by_rare_tokens(side(missing, "m", many), side(found, "f", many)))


def successor_candidates(missing: DataFrame, discovered: DataFrame, key: str = "document_key", most: int = 5) -> DataFrame:
    """(key, successor, signals, rank): the best candidates of each missing key (key, title) among discovered ones (key, title).

    Two keys make a pair with CANDIDATE points: equal titles, or two of equal last path parts, equal suffixes and alike titles. Rows meet
    in blocks of equal features only, and as a block's rows are all alike in what it is made of, of its discovered keys the least `most`
    are enough for the best of everyone; a title that thousands share pairs each missing key with a few of them. Each set of signs that
    makes a candidate has its own blocks, so a block gives its pairs the points of its signs, and a pair's most are right for all that can be
    among the best: neither titles nor tokens go with pairs. Alike titles are looked for between classes of equal last part and title
    tokens, not between rows. Ties: the least key. Null titles and keys match nothing.
    """
    a, b = cut(features(missing, key).where(F.col(key).isNotNull()), "missing"), cut(features(discovered, key).where(F.col(key).isNotNull()), "discovered")

    def least(df: DataFrame, by: list[str], name: str = key) -> DataFrame:
        """(successor, by): the least keys of each block, one more than are asked for, as a key may meet itself."""
        rows = df.select(F.col(name).alias("successor"), *by).where(reduce(Column.__and__, [F.col(c).isNotNull() for c in by]))
        return rows.withColumn("_r", F.dense_rank().over(Window.partitionBy(*by).orderBy("successor"))).where(F.col("_r") <= most + 1).drop("_r").distinct()

    def meet(left: DataFrame, block: DataFrame, by: list[str], points: int) -> DataFrame:
        return left.select(key, *by).join(block, by).select(key, "successor", F.lit(points).alias("signals"))

    same = ((["title"], SAME_TITLE), (["title", "last"], SAME_TITLE + SAME_LAST), (["title", "suffix"], SAME_TITLE + SAME_LAST + SAME_SUFFIX), (["suffix"], SAME_LAST + SAME_SUFFIX))
    pairs = [meet(a, least(b, by), by, points) for by, points in same]
    alike = cut(_alike_titles(a, b), "alike").select(F.col("m"), F.col("f").alias("class"))
    for by, points in (([], SAME_LAST + ALIKE_TITLE), (["suffix"], SAME_LAST + SAME_SUFFIX + ALIKE_TITLE)):
        found = alike.join(least(b, ["class", *by]), "class").drop("class").withColumnRenamed("m", "class")
        pairs.append(meet(a, least(found, ["class", *by], "successor"), ["class", *by], points))
    # By key alone, so that neither the pairs' most nor the ranks send them again.
    met = reduce(DataFrame.unionByName, pairs).where(F.col(key) != F.col("successor")).repartition(F.col(key))
    scored = met.groupBy(key, "successor").agg(F.max("signals").alias("signals")).where(F.col("signals") >= CANDIDATE)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("signals"), "successor"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def reconciliation(active: DataFrame, discovered: DataFrame, key: str = "document_key", most: int = 5) -> DataFrame:
    """(key, class, successor, signals, blockers) of both sides' keys (key, title, content_hash): unchanged, changed, added, missing, or
    replaced where a missing key has a best successor that was added.

    Blockers: a key that either side has twice, keys that differ in case or a final slash only, a missing content hash, an
    address as a successor that several missing keys want.
    """
    counted = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"_n{name}"), F.max("content_hash").alias(name), F.bool_or(F.col("content_hash").isNull()).alias(f"_h{name}"))
    both = cut(counted(active, "old").join(counted(discovered, "new"), key, "full_outer"), "both")
    gone, came = both.where("_nnew is null").select(key), both.where("_nold is null").select(key)
    titled = lambda df, keys: df.select(key, "title").join(keys, key, "left_semi")
    best = successor_candidates(titled(active, gone), titled(discovered, came), key, most).where("rank = 1").select(key, "successor", "signals")
    best = cut(best, "best")
    wanted = best.groupBy("successor").agg(F.count(F.lit(1)).alias("_wanted"))
    plain = F.regexp_replace(F.lower(F.col(key)), "/+$", "")
    twins = both.groupBy(plain.alias("_plain")).agg(F.count(F.lit(1)).alias("_twins"))
    rows = both.withColumn("_plain", plain).join(twins, "_plain").join(best.join(wanted, "successor"), key, "left")
    kind = (
        F.when(F.col("_nold").isNull(), "added").when(F.col("_nnew").isNull() & F.col("successor").isNotNull(), "replaced").when(F.col("_nnew").isNull(), "missing").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    )
    why = reasons((F.col("_nold") > 1, "duplicate_active_key"), (F.col("_nnew") > 1, "duplicate_discovered_key"), (F.col("_twins") > 1, "key_collision"), (F.coalesce("_hold", F.lit(False)) | F.coalesce("_hnew", F.lit(False)), "no_content_hash"), (F.col("_wanted") > 1, "successor_wanted_twice"))
    return rows.select(key, kind.alias("class"), "successor", "signals", why.alias("blockers"))
