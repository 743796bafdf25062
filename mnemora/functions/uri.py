"""URI functions: `scheme://dimension/category/...`. Columns in, columns out, any scheme."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Known dimensions (fixed values).
DIMENSIONS = ("resources", "user", "agent", "session")


def segments(uri: Column) -> Column:
    """Non-empty path segments, the query string left out; null for a null URI, empty without a scheme."""
    return F.filter(F.split(F.regexp_extract(uri, r"^\w+://([^?]*)", 1), "/"), lambda x: x != "")


def is_valid(uri: Column) -> Column:
    """A scheme, at least one segment and a known dimension."""
    return F.coalesce(F.get(segments(uri), 0).isin(*DIMENSIONS), F.lit(False))


def parse(uri: Column) -> Column:
    """Struct of dimension, category, subcategory, resource.

    With three segments the third is the resource if it holds a dot, else the subcategory; with more the
    third is the subcategory and the rest is the resource.
    """
    s = segments(uri)
    third = F.get(s, 2)
    dotted = third.contains(".")
    return F.struct(
        F.get(s, 0).alias("dimension"),
        F.get(s, 1).alias("category"),
        F.when((F.size(s) > 3) | ((F.size(s) == 3) & ~dotted), third).alias("subcategory"),
        F.when(F.size(s) > 3, F.array_join(F.slice(s, 4, F.greatest(F.size(s) - 3, F.lit(1))), "/")).when((F.size(s) == 3) & dotted, third).alias("resource"),
    )


def params(uri: Column) -> Column:
    """Query parameters as a map; parts without `=` are dropped, the last of a repeated key wins."""
    parts = F.filter(F.split(F.regexp_extract(uri, r"\?(.*)$", 1), "&"), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.split_part(p, F.lit("="), F.lit(2)).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def parent(uri: Column) -> Column:
    """The URI without its last segment."""
    return F.regexp_replace(uri, r"/[^/]*$", "")


def name(uri: Column) -> Column:
    """The last segment."""
    return F.regexp_extract(uri, r"([^/]*)$", 1)


def owner(uri: Column) -> Column:
    """Struct of scope, owner_id and memory_id (the file's stem); null with fewer than three segments."""
    s = segments(uri)
    return F.when(F.size(s) >= 3, F.struct(F.get(s, 0).alias("scope"), F.get(s, 1).alias("owner_id"), F.regexp_replace(F.element_at(s, -1), r"\.md$", "").alias("memory_id")))


def canonical(uri: Column) -> Column:
    """Layer files stand for their directory."""
    return F.regexp_replace(uri, r"/\.(abstract|overview)\.md$", "")


def is_summary(uri: Column) -> Column:
    return uri.rlike(r"/\.(abstract|overview)\.md$")


def is_leaf(uri: Column) -> Column:
    return uri.endswith(".md") & ~is_summary(uri)


def layer(uri: Column, which: str) -> Column:
    """URI of the L0 or L1 file that sums up a file's directory, or a directory."""
    directory = F.when(uri.endswith(".md"), parent(uri)).otherwise(uri)
    return F.concat(directory, F.lit("/.abstract.md" if which == "L0" else "/.overview.md"))


def directory_of_summary(uri: Column) -> Column:
    """Directory of a layer hit: summaries stand for their directory, other files lie in it, all else is itself."""
    return F.when(is_summary(uri), canonical(uri)).when(uri.endswith(".md"), parent(uri)).otherwise(uri)


def ancestors(uri: Column) -> Column:
    """All directories above a URI, the nearest last: an equi-join on these replaces a prefix join."""
    s = segments(uri)
    root = F.regexp_extract(uri, r"^(\w+://)", 1)
    return F.when(F.size(s) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda n: F.concat(root, F.array_join(F.slice(s, 1, n), "/")))
    )


def normal_scope(scope: Column, scheme: str = "mem://") -> Column:
    """A search scope as a URI prefix: null is the session root, older names move below it, bare names are sessions."""
    rest = F.regexp_extract(scope, r"^\w+://(.*)$", 1)
    head = F.split_part(rest, F.lit("/"), F.lit(1))
    return (
        F.when(scope.isNull(), F.lit(scheme + "session"))
        .when(scope.rlike(r"^\w+://") & head.isin(*DIMENSIONS), F.concat(F.lit(scheme), rest))
        .when(scope.rlike(r"^\w+://") & head.isin("threads", "agents", "users", "global"), F.concat(F.lit(scheme + "session"), F.substr(rest, F.length(head) + 1)))
        .when(scope.rlike(r"^\w+://"), F.lit(scheme + "session"))
        .otherwise(F.concat(F.lit(scheme + "session/"), F.regexp_replace(scope, "^/+", "")))
    )
