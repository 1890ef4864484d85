"""Baseline manifests: rows without secrets, counts and Merkle digests by source and key range, so that drift is found by descending from
the roots instead of by joining all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from sparkevidence.operators.reviews import reasons
from sparkevidence.sources.cuts import cut

#: Names, or parts of them, of fields that a manifest never holds. Fixed values.
SECRET = ("password", "passwd", "secret", "token", "api_key", "apikey", "credential", "private_key", "authorization")
#: Rows that a leaf of the tree holds about.
LEAF_ROWS = 1000


def _is_secret(name: Column) -> Column:
    return F.exists(F.array(*[F.lit(s) for s in SECRET]), lambda s: F.contains(F.regexp_replace(F.lower(name), "-", "_"), s))


def _clean(value: Column, kind: K.DataType) -> Column:
    if isinstance(kind, K.StructType):
        kept = [f for f in kind.fields if not any(s in f.name.lower().replace("-", "_") for s in SECRET)]
        if not kept:
            return F.lit(None).cast("string")
        return F.when(value.isNotNull(), F.struct(*[_clean(value[f.name], f.dataType).alias(f.name) for f in kept]))
    if isinstance(kind, K.ArrayType):
        return F.transform(value, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, K.MapType):
        kept = F.map_filter(value, lambda k, _: ~_is_secret(k.cast("string")))
        return F.transform_values(kept, lambda _, v: _clean(v, kind.valueType))
    return value


def without_secrets(df: DataFrame) -> DataFrame:
    """df without columns, struct fields and map entries of secret names, at any depth."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if not any(s in f.name.lower().replace("-", "_") for s in SECRET)])


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over all columns in order of their names; null is told from empty, nested values are taken as JSON."""
    nested = (K.StructType, K.ArrayType, K.MapType)
    text = lambda f: F.to_json(F.col(f"`{f.name}`"), {"ignoreNullFields": "false"}) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string")
    parts = [F.coalesce(text(f), F.lit("\0")) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def depth_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Levels of 16 children below the root, so that a leaf holds about so many rows of a table's."""
    depth = 0
    while rows > leaf_rows * 16**depth:
        depth += 1
    return depth


def leaves(df: DataFrame, by: str, key: str, depth: int) -> DataFrame:
    """(by, node, key, digest) of each row; node: the first digits of the key's SHA-256, so a leaf is a range of keys' hashes."""
    return df.select(F.col(by), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, depth).alias("node"), F.col(key), row_digest(df).alias("digest"))


def tree(rows: DataFrame, by: str, depth: int) -> DataFrame:
    """(by, level, node, rows, digest) of all nodes above leaves (by, node, key, digest): a leaf's digest is that of its rows' in order, an
    inner one's that of its children's. A group is a leaf's rows, or 16 children."""
    level = rows.groupBy(by, "node").agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest")).withColumn("level", F.lit(depth))
    level = cut(level, "leaves")
    every = level
    for d in range(depth - 1, -1, -1):
        up = level.groupBy(by, F.substring("node", 1, d).alias("up")).agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("c"))
        level = up.select(by, F.col("up").alias("node"), "rows", F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["node"], x["digest"])), ""), 256).alias("digest"), F.lit(d).alias("level"))
        every = every.unionByName(level)
    return every.select(by, "level", "node", "rows", "digest")


def manifest(df: DataFrame, by: str, key: str, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and leaf rows of a table as it is without its secrets. key has to be unique; a null source is one of its own."""
    clean = without_secrets(df)
    depth = depth_for(clean.count()) if depth is None else depth
    rows = cut(leaves(clean, by, key, depth), "rows")
    return cut(tree(rows, by, depth), "tree"), rows


def verified(nodes: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """(by, rows, reasons) of a manifest against what is expected (by, rows, digest): sources that lack one, others, counts and digests that differ,
    and inner nodes whose rows are not those of their children."""
    roots = nodes.where("level = 0").select(by, F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    sums = nodes.groupBy(by, "level").agg(F.sum("rows").alias("n")).groupBy(by).agg((F.min("n") != F.max("n")).alias("_torn"))
    both = expected.select(by, F.col("rows").alias("_want"), F.col("digest").alias("_due")).join(roots, by, "full_outer").join(sums, by, "left")
    why = reasons((F.col("_rows").isNull(), "no_manifest"), (F.col("_want").isNull(), "not_expected"), (F.col("_rows") != F.col("_want"), "count_differs"), (F.col("_digest") != F.col("_due"), "checksum_differs"), (F.col("_torn"), "torn_tree"))
    return both.select(by, F.coalesce("_rows", F.lit(0)).alias("rows"), why.alias("reasons"))


def drifted_leaves(old: DataFrame, new: DataFrame, by: str, depth: int) -> DataFrame:
    """(by, node) of leaves that differ between two trees of one depth: from the roots down, only children of nodes that differ are looked at."""
    side = lambda nodes, d, name: nodes.where(F.col("level") == d).select(by, "node", F.col("digest").alias(name))
    found = None
    for d in range(depth + 1):
        a, b = side(old, d, "a"), side(new, d, "b")
        if found is not None:
            up = found.select(F.col(by).alias("_by"), F.col("node").alias("_parent"))
            under = lambda x: x.join(up, F.col(by).eqNullSafe(F.col("_by")) & (F.substring("node", 1, d - 1) == F.col("_parent")), "left_semi")  # noqa: B023, E731
            a, b = under(a), under(b)
        b = b.select(F.col(by).alias("_b"), F.col("node").alias("_n"), "b")
        both = a.join(b, F.col(by).eqNullSafe(F.col("_b")) & (F.col("node") == F.col("_n")), "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        found = cut(both.select(F.when(F.col("a").isNull(), F.col("_b")).otherwise(F.col(by)).alias(by), F.coalesce("node", "_n").alias("node")), "differ")
    return found


def drift(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], by: str, key: str, depth: int) -> DataFrame:
    """(by, key, drift) of rows added, removed or modified between two manifests (nodes, rows) of one depth. Only rows of leaves that
    differ are joined."""
    differ = drifted_leaves(old[0], new[0], by, depth).select(F.col(by).alias("_by"), F.col("node").alias("_node"))
    pick = lambda rows, name: rows.join(differ, F.col(by).eqNullSafe(F.col("_by")) & (F.col("node") == F.col("_node")), "left_semi").select(F.col(by).alias(f"_{name}by"), F.col(key).alias(f"_{name}key"), F.col("digest").alias(name))
    both = pick(old[1], "a").join(pick(new[1], "b"), F.col("_aby").eqNullSafe(F.col("_bby")) & (F.col("_akey") == F.col("_bkey")), "full_outer")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    changed = both.where(~F.col("a").eqNullSafe(F.col("b")))
    return changed.select(F.when(F.col("a").isNull(), F.col("_bby")).otherwise(F.col("_aby")).alias(by), F.coalesce("_akey", "_bkey").alias(key), kind.alias("drift"))


def execution_gates(plan: DataFrame, checked: DataFrame, drift: DataFrame, by: str) -> DataFrame:
    """(by, actions, reasons, ready) of planned rows (by, action): a source may be worked on if its manifest was found in order (checked), none of its rows has
    drifted since, and there is something to do."""
    n = plan.groupBy(by).agg(F.count_if(F.col("action") != "skip").alias("actions"))
    bad = checked.select(by, F.col("reasons").alias("_why"))
    moved = drift.groupBy(by).agg(F.count(F.lit(1)).alias("_moved"))
    rows = n.join(bad, by, "left").join(moved, by, "left")
    why = reasons((F.col("_why").isNull(), "no_manifest"), (F.size("_why") > 0, "manifest_invalid"), (F.col("_moved") > 0, "drifted"), (F.col("actions") == 0, "nothing_to_do"))
    return rows.select(by, "actions", why.alias("reasons"), (F.size(why) == 0).alias("ready"))


def exported(df: DataFrame, path: str, by: str, key: str) -> None:
    """Writes a baseline: rows without secrets and the tree, whose roots hold counts and checksums."""
    nodes, _ = manifest(df, by, key)
    without_secrets(df).write.mode("overwrite").parquet(f"{path}/rows")
    nodes.write.mode("overwrite").parquet(f"{path}/tree")
