"""Documents as tables: files, ignore rules, manifests, snapshots, run history (IO1-IO16)."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .shared import stored

EXTENSIONS = ("py", "pltg", "md", "txt")
# What counts as plain text when a file is taken in.
PLAIN_EXTENSIONS = ("txt", "md", "rst", "csv", "json", "yaml", "yml", "toml", "py", "pltg", "pgmd", "html", "xml", "log")
PLAIN_NAMES = ("readme", "license", "makefile", "dockerfile", "changelog")


def load_document(spark: SparkSession, name: str, path: str) -> DataFrame:
    """IO1: one file, whole."""
    return spark.read.text(path, wholetext=True).select(F.lit(name).alias("doc"), F.col("value").alias("text"))


def register_documents(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """IO2: texts in memory."""
    return spark.createDataFrame(list(texts.items()), "doc string, text string")


def glob_regex(pattern: str) -> str:
    """A file-name pattern as a regular expression; * crosses /."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """IO4: a pattern matches the path, any suffix of it, or a folder above it."""
    hit = F.lit(False)
    for p in patterns:
        body = glob_regex(p.rstrip("/"))[len("(?s)^") : -1]
        hit = hit | path.rlike(f"(?s)(^|/){body}(/|$)" if "/" not in p.rstrip("/") else f"(?s)^/?{body.lstrip('/')}(/|$)")
    return hit


def index_dir(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, exclude: list[str] | None = None) -> DataFrame:
    """IO3: all files under a folder as (doc, text, sha256); doc is the path below the folder."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    root = re.escape(folder.rstrip("/").removeprefix("file:"))
    named = files.select(F.regexp_replace("path", rf"^.*?{root}/", "").alias("doc"), "text")
    kept = named.where(~ignored(F.col("doc"), exclude)) if exclude else named
    return kept.withColumn("sha256", F.sha2("text", 256))


def manifest(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """H8: name and hash of each document."""
    return docs.select(F.col(doc).alias("doc"), F.sha2(F.col(text), 256).alias("sha256"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """IO5, H8: doc and change (added, deleted, changed); unchanged ones don't appear."""
    both = old.select("doc", F.col("sha256").alias("was")).join(new.select("doc", F.col("sha256").alias("now")), "doc", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return both.select("doc", change.alias("change")).where(F.col("change").isNotNull())


def reindex(index: DataFrame, old: DataFrame, new_docs: DataFrame, index_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """IO5, H11: of a stored index (with a doc column) the rows of unchanged documents as they are, and fresh rows of
    added and changed ones. old: the manifest of the documents that the index was made from."""
    change = stored(manifest_diff(old, manifest(new_docs)))
    fresh = index_of(new_docs.join(change.where("change <> 'deleted'"), "doc", "left_semi"))
    return index.join(change.where("change <> 'added'"), "doc", "left_anti").unionByName(fresh)


def named_path(argument: str) -> tuple[str, str]:
    """IO13: name:path, or a path whose file gives the name."""
    if ":" in argument and not re.match(r"\w+://", argument):
        name, path = argument.split(":", 1)
        return name.strip(), path.strip()
    return re.sub(r"\.[^.]*$", "", argument.rstrip("/").rsplit("/", 1)[-1]), argument


def plain(path: Column) -> Column:
    """IO13: whether a file is taken in as plain text, by its extension or name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ending = F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1)).otherwise("")
    return ending.isin(*PLAIN_EXTENSIONS) | name.isin(*PLAIN_NAMES)


def ingest(spark: SparkSession, *arguments: str) -> DataFrame:
    """IO13: (doc, path, text, error) of files; what isn't plain text gets an error in place of its text."""
    named = spark.createDataFrame([(n, p) for n, p in map(named_path, arguments)], "doc string, path string")
    files = spark.read.text([p for _, p in map(named_path, arguments)], wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    found = named.join(files, F.endswith("file", F.col("path")), "left")
    return found.select(
        "doc", "path", F.when(plain(F.col("path")), F.col("value")).alias("text"), F.when(~plain(F.col("path")), F.concat(F.lit("unsupported document format: "), "path")).alias("error")
    )


def save_snapshot(tables: dict[str, DataFrame], folder: str, version: str) -> None:
    """IO6-IO10, P25: one Parquet folder for each table of a version; a version is never changed."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{version}/{name}")


def load_snapshot(spark: SparkSession, folder: str, version: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{version}/{n}") for n in names}


def history_page(runs: DataFrame, limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    """IO14: runs, newest first."""
    return runs.orderBy(F.desc(key)).offset(offset).limit(limit)


def history_apply(runs: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """IO14: save, complete, fail and delete as one merge. changes: the columns of runs, and op (put, delete)."""
    gone = changes.select(key).distinct()
    return runs.join(gone, key, "left_anti").unionByName(changes.where("op = 'put'").drop("op"))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """IO16: (doc, ord, kind, start_line, body): prose, executable blocks and other code of a literate file."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    fence = F.col("line").rlike(r"^\s*```")
    by_doc = Window.partitionBy("doc").orderBy("i")
    seen = F.sum(fence.cast("int")).over(by_doc)
    marked = lines.withColumn("is_fence", fence).withColumn("fences", seen)
    inside = (F.col("fences") % 2 == 1) & ~F.col("is_fence")
    language = F.trim(F.regexp_extract("line", r"^\s*```\s*(.*)$", 1))
    block = Window.partitionBy("doc", "fences")
    opened = marked.withColumn("language", F.first(F.when(F.col("is_fence"), language), ignorenulls=True).over(block))
    marker = F.max(F.when(~F.col("is_fence"), F.col("line").rlike(r"^\s*;;\s*pltg\b"))).over(block)
    kind = F.when(~inside, "prose").when((F.col("language") == "scheme") & marker, "executable").otherwise("code")
    body = opened.where(~F.col("is_fence")).withColumn("kind", kind)
    return (
        body.groupBy("doc", F.col("fences").alias("ord"), "kind")
        .agg(
            (F.min("i") + 1).alias("start_line"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("body"),
        )
        .where(F.trim("body") != "")
    )


def history_get(runs: DataFrame, key: str, name: object) -> DataFrame:
    """IO14: one run."""
    return runs.where(F.col(key) == F.lit(name))


def history_clear(runs: DataFrame, project: str | None = None) -> DataFrame:
    """IO14: no runs, or those of other projects."""
    return runs.limit(0) if project is None else runs.where(~F.col("project").eqNullSafe(F.lit(project)))


def projects(runs: DataFrame) -> DataFrame:
    """IO14: each project with its number of runs and its last one."""
    return runs.groupBy("project").agg(F.count(F.lit(1)).alias("runs"), F.max("id").alias("last"))
