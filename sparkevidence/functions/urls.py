"""References resolved against the page they stand on (RFC 3986, section 5), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, authority, path, query and fragment, each with its mark. Fixed value (RFC 3986, appendix B).
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
#: References that lead to no page. Fixed values.
NO_PAGE = r"(?i)^(mailto|tel|javascript|data):"


def _parts(url: Column) -> Column:
    get = lambda i: F.regexp_extract(url, f"(?s){PARTS}", i)
    return F.struct(F.lower(get(1)).alias("scheme"), get(2).alias("authority"), get(3).alias("path"), get(4).alias("query"), get(5).alias("fragment"))


def without_dot_segments(path: Column) -> Column:
    """A path with its "." segments taken out, and its ".." segments with those before them."""
    segments = F.split(path, "/")
    root = path.startswith("/")
    last = F.element_at(segments, -1).isin(".", "..")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(F.when(root, F.slice(segments, F.lit(2), F.size(segments))).otherwise(segments), F.array().cast("array<string>"), step)
    ended = F.when(last, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.contains("."), F.concat(F.when(root, "/").otherwise(""), F.array_join(ended, "/"))).otherwise(path)


def resolved(base: Column, reference: Column) -> Column:
    """The absolute address of a reference on a page; null if either is null. Scheme and fragment rules are those of the standard."""

    def target(b: Column, r: Column) -> Column:
        folder = F.regexp_extract(b["path"], "(?s)^(.*/)?", 0)
        merged = F.when((b["authority"] != "") & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(folder, r["path"]))
        path = F.when(r["path"] == "", b["path"]).otherwise(without_dot_segments(F.when(r["path"].startswith("/"), r["path"]).otherwise(merged)))
        query = F.when((r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
        own = F.concat(r["authority"], without_dot_segments(r["path"]), r["query"])
        rest = F.when(r["authority"] != "", own).otherwise(F.concat(b["authority"], path, query))
        return F.concat(F.when(r["scheme"] != "", F.concat(r["scheme"], own)).otherwise(F.concat(b["scheme"], rest)), r["fragment"])

    both = F.array(F.struct(_parts(base).alias("b"), _parts(F.btrim(reference, F.lit(" \t\r\n\f"))).alias("r")))
    return F.when(base.isNotNull() & reference.isNotNull(), F.element_at(F.transform(both, lambda x: target(x["b"], x["r"])), 1))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")
