"""The directory tree of URI-addressed files, derived by exploding each file's ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import text as t
from mnemora.functions import uri as u


def visible(name: Column) -> Column:
    """Dot files are hidden but for the layer files."""
    return ~name.startswith(".") | name.isin(".abstract.md", ".overview.md")


def below(files: DataFrame) -> DataFrame:
    """Every file once for each directory above it: dir, uri, and the other columns."""
    return files.withColumn("dir", F.explode(u.ancestors(F.col("uri"))))


def listing(files: DataFrame) -> DataFrame:
    """Children of every directory: dir, child, is_directory, child_count (a directory's visible children; 0 for a file)."""
    direct = files.select(u.parent(F.col("uri")).alias("dir"), F.col("uri").alias("child")).where(visible(u.name(F.col("child")))).distinct()
    dirs = below(files.select("uri")).select("dir").distinct().where(F.size(u.segments(F.col("dir"))) > 1)
    folders = dirs.select(u.parent(F.col("dir")).alias("dir"), F.col("dir").alias("child"))
    counts = direct.unionByName(folders).groupBy(F.col("dir").alias("child")).agg(F.count("*").alias("n"))
    held = folders.join(counts, "child", "left").select("dir", "child", F.lit(True).alias("is_directory"), F.coalesce("n", F.lit(0)).alias("child_count"))
    return direct.select("dir", "child", F.lit(False).alias("is_directory"), F.lit(0).cast("long").alias("child_count")).unionByName(held)


def recursive(files: DataFrame, abstracts: DataFrame) -> DataFrame:
    """All visible files with the abstract of their directory, null where there is none: uri, dir, abstract. abstracts: dir (once), abstract."""
    return files.where(visible(u.name(F.col("uri")))).select("uri", u.parent(F.col("uri")).alias("dir")).join(abstracts.select("dir", "abstract"), "dir", "left").select("uri", "dir", "abstract")


def coverage_totals(directories: DataFrame, layers: DataFrame) -> DataFrame:
    """One row: n_dirs, n_complete (with both layers), n_missing, percent (whole; 100 without directories). directories: dir (once); layers: dir, layer."""
    ok = layers.groupBy("dir").agg((F.bool_or(F.col("layer") == "L0") & F.bool_or(F.col("layer") == "L1")).alias("ok"))
    complete = F.count_if(F.coalesce("ok", F.lit(False)))
    return directories.join(ok, "dir", "left").agg(F.count("*").alias("n_dirs"), complete.alias("n_complete")).select(
        "n_dirs", "n_complete", (F.col("n_dirs") - F.col("n_complete")).alias("n_missing"), F.when(F.col("n_dirs") == 0, 100).otherwise(F.expr("n_complete * 100 div n_dirs")).alias("percent")
    )


def dimensions(files: DataFrame) -> DataFrame:
    """Directories with files, files, messages at any depth and directly below a timeline, of every dimension: dimension, n_dirs, n_files, n_messages, n_direct."""
    uri = F.col("uri")
    return files.groupBy(F.get(u.segments(uri), 0).alias("dimension")).agg(
        F.count_distinct(u.parent(uri)).alias("n_dirs"), F.count("*").alias("n_files"), F.count_if(uri.contains("/timeline/")).alias("n_messages"), F.count_if(uri.rlike("/timeline/[^/]*$")).alias("n_direct")
    )


def stats(files: DataFrame) -> DataFrame:
    """Recursive number of files and bytes of every directory: dir, n_files, n_bytes. files: uri, size."""
    return below(files.where(u.name(F.col("uri")) != ".DS_Store")).groupBy("dir").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def combined(files: DataFrame, most: int = 10_000, mark: str = "\n\n[...]") -> DataFrame:
    """Text of each directory's own files in order of name, each under its name, without metadata lines, cut at `most`.

    files: uri, text. Only what can be within the first `most` characters is gathered: a running length leaves
    the rest of a directory out before the texts are collected, so a huge directory stays small.
    """
    name = u.name(F.col("uri"))
    part = F.concat(F.lit("\n\n=== "), name, F.lit(" ===\n\n"), t.without_metadata_lines(F.col("text")))
    own = files.where(~name.startswith(".") & (name.endswith(".md") | name.endswith(".txt")) & F.col("text").isNotNull()).select(u.parent(F.col("uri")).alias("dir"), name.alias("name"), F.left(part, F.lit(most + 1)).alias("part"))
    # Each part has at least its header's length, so no more of them can be within the limit; Spark applies this before the shuffle.
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("dir").orderBy("name"))).where(F.col("n") <= most // 13 + 1)
    w = Window.partitionBy("dir").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    some = own.withColumn("before", F.coalesce(F.sum(F.char_length("part")).over(w), F.lit(0))).where(F.col("before") <= most)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "part"))), lambda x: x["part"]), "")
    return some.groupBy("dir").agg(whole.alias("c")).select("dir", F.when(F.char_length("c") > most, F.concat(F.left("c", F.lit(most)), F.lit(mark))).otherwise(F.col("c")).alias("content"))


def dirty(contents: DataFrame, layers: DataFrame) -> DataFrame:
    """Directories whose content no longer has the stored hash: dir, source_hash. contents: dir, content; layers: dir, source_hash."""
    now = contents.select("dir", F.sha2("content", 256).alias("source_hash"))
    old = layers.select("dir", F.col("source_hash").alias("old"))
    return now.join(old, "dir", "left").where(~F.col("source_hash").eqNullSafe(F.col("old"))).select("dir", "source_hash")


def coverage(memories: DataFrame) -> DataFrame:
    """Which layers every directory has: dir, has_l0, has_l1, n_l2. memories: uri, layer (null counts as L2)."""
    layer = F.coalesce("layer", F.lit("L2"))
    return (
        memories.where("uri IS NOT NULL")
        .groupBy(u.directory_of_summary(F.col("uri")).alias("dir"))
        .agg(F.bool_or(layer == "L0").alias("has_l0"), F.bool_or(layer == "L1").alias("has_l1"), F.count_if(layer == "L2").alias("n_l2"))
    )


def explore(files: DataFrame, query: str, depth: int = 3) -> DataFrame:
    """Directories down to a depth with the share of their files that hold the query: dir, depth, n_files, n_hits, relevance."""
    hit = F.col("hit")
    return (
        below(files.where("text IS NOT NULL").select("uri", F.col("text").contains(query).alias("hit")))  # searched once, and only the answer is multiplied
        .withColumn("depth", F.size(u.segments(F.col("dir"))).cast("long"))
        .where(F.col("depth") <= depth)
        .groupBy("dir", "depth")
        .agg(F.count("*").alias("n_files"), F.count_if(hit).alias("n_hits"))
        .withColumn("relevance", F.when(F.col("n_hits") > 0, 0.8).otherwise(0.4))
    )
