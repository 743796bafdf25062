"""Layer maintenance: abstracts and overviews of every directory, rebuilt level by level from the leaves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import text as t
from mnemora.functions import uri as u
from mnemora.operators import tree
from mnemora.session import cut

#: Characters of a directory's text that the abstract and the overview are made from.
ABSTRACT_INPUT, OVERVIEW_INPUT = 8_000, 16_000


def first_sentences(text: Column, n: int = 2) -> Column:
    """The deterministic summariser: the first sentences of the text, within the abstract's limit."""
    body = F.regexp_replace(F.left(text, F.lit(ABSTRACT_INPUT)), r"\s+", " ")
    return t.limited_abstract(F.regexp_extract(body, rf"^((?:.*?[。.?!！？]){{1,{n}}}|.*)", 1))


def overview(text: Column) -> Column:
    """The deterministic overview: the beginning of the text, within the overview's limit."""
    return t.limited_overview(F.left(text, F.lit(OVERVIEW_INPUT)))


def changed(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """The rebuilt directories whose content no longer has the stored hash, so only these are written. stored: dir, source_hash."""
    return fresh.join(stored.select("dir", F.col("source_hash").alias("_old")), "dir", "left").where(~F.col("source_hash").eqNullSafe(F.col("_old"))).drop("_old")


def bundle(memories: DataFrame) -> DataFrame:
    """The three layers of each directory side by side: dir, abstract, overview, n_files.

    memories: uri, layer, content. Of several abstracts the smallest URI's counts; a missing layer is null.
    """
    layer = F.coalesce("layer", F.lit("L2"))
    pick = lambda which: F.min_by(F.when(layer == which, F.col("content")), F.when((layer == which) & F.col("content").isNotNull(), F.col("uri")))
    return (
        memories.where("uri IS NOT NULL")
        .groupBy(u.directory_of_summary(F.col("uri")).alias("dir"))
        .agg(pick("L0").alias("abstract"), pick("L1").alias("overview"), F.count_if(layer == "L2").alias("n_files"))
    )


def child_abstracts(abstracts: DataFrame, most: int = 10_000) -> DataFrame:
    """Text of each directory from its children's abstracts, each under the child's name: dir, content. abstracts: dir, abstract."""
    name = u.name(F.col("dir"))
    part = F.concat(F.lit("\n\n## "), name, F.lit("\n\n"), t.without_metadata_lines(F.col("abstract")))
    own = abstracts.where(F.size(u.segments(F.col("dir"))) > 1).select(u.parent(F.col("dir")).alias("parent"), name.alias("name"), F.left(part, F.lit(most)).alias("part"))
    # A part has seven characters at least, so only so many can be within the limit; Spark applies this before the shuffle.
    some = own.withColumn("n", F.row_number().over(Window.partitionBy("parent").orderBy("name"))).where(F.col("n") <= most // 7 + 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "part"))), lambda x: x["part"]), "")
    return some.groupBy(F.col("parent").alias("dir")).agg(F.left(joined, F.lit(most)).alias("content"))


def rebuilt(files: DataFrame, summarise: Callable[[Column], Column] = first_sentences) -> DataFrame:
    """Abstract and overview of every directory above a file: dir, depth, abstract, overview, source_hash.

    files: uri, text. A directory with own files is summed up from them, any other from its children's
    abstracts; one pass per level, the deepest first. The number of levels is bounded by the URIs' depth.
    """
    direct = tree.combined(files)
    depth = F.size(u.segments(F.col("dir"))).cast("long")
    every = files.select(F.explode(u.ancestors(F.col("uri"))).alias("dir")).distinct().withColumn("depth", depth)
    deepest = every.agg(F.max("depth")).first()[0] or 0
    done = None
    level_above = None
    for d in range(deepest, 0, -1):
        here = every.where(F.col("depth") == d).join(direct.withColumnRenamed("content", "own"), "dir", "left")
        if level_above is not None:
            here = here.join(child_abstracts(level_above).withColumnRenamed("content", "sub"), "dir", "left")
        else:
            here = here.withColumn("sub", F.lit(None).cast("string"))
        content = F.coalesce("own", "sub", F.lit(""))
        # Cut, or each level's plan would hold those of all deeper ones, once in itself and once in the union.
        now = cut(here.select("dir", "depth", summarise(content).alias("abstract"), overview(content).alias("overview"), F.sha2(content, 256).alias("source_hash")))
        done = now if done is None else done.unionByName(now)
        level_above = now.select("dir", "abstract")
    return done if done is not None else every.select("dir", "depth", F.lit("").alias("abstract"), F.lit("").alias("overview"), F.lit("").alias("source_hash"))


def stale(files: DataFrame, layers: DataFrame) -> DataFrame:
    """Directories whose layer is missing or older than their newest file: dir, newest. files: uri, at; layers: dir, at."""
    newest = files.groupBy(u.parent(F.col("uri")).alias("dir")).agg(F.max("at").alias("newest"))
    made = layers.groupBy("dir").agg(F.max("at").alias("made"))
    return newest.join(made, "dir", "left").where("made IS NULL OR newest > made").select("dir", "newest")


def without_subtree(files: DataFrame, directory: str) -> DataFrame:
    """The files but one, or all below a directory."""
    return files.where(~((F.col("uri") == directory) | F.col("uri").startswith(directory.rstrip("/") + "/")))
