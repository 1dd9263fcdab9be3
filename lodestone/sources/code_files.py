"""Source trees as tables: discovery, ignore rules, languages, hashes, and text from git."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import LANGUAGES, language_of
from lodestone.sources.storage import kept

#: Names that are ignored whatever ignore files say, and folders that are ignored unless the settings name others.
ALWAYS = (".git", "node_modules")
DEFAULTS = ("node_modules", ".git", "dist", "build", "out", "coverage", "__pycache__", ".venv", "venv", ".next", ".nuxt")
#: The ignore file's name, and the depth down to which such files are read.
IGNORE_FILE, IGNORE_DEPTH = ".gitignore", 3


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    negated: bool = False


def named(name: str) -> IgnoreRule:
    """A path of which any part has this name."""
    return IgnoreRule(f"(^|/){re.escape(name)}(/|$)")


def parse_ignore(text: str, base: str = "") -> list[IgnoreRule]:
    """The rules of an ignore file that lies in directory base (with a slash behind, or empty).

    A name without a slash holds anywhere in the tree; a leading slash anchors at
    base; any other pattern holds behind any slash. Only names and patterns that
    end with a slash are bounded at their end.
    """

    def expression(glob: str) -> str:
        steps = re.split(r"(\*\*|\*|\?)", glob)
        return "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in steps)

    rules = []
    for raw in text.split("\n"):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        glob = line[negated:]
        if "/" not in glob[:-1]:
            whole = f"(^|/){expression(glob.removesuffix('/'))}(/|$)"
        else:
            start = "^" + re.escape(base) if glob.startswith("/") else "(^|/)"
            end = "(/|$)" if glob.endswith("/") else ""
            whole = start + expression(glob.strip("/") if glob.startswith("/") else glob.removesuffix("/")) + end
        rules.append(IgnoreRule(whole, negated))
    return rules


def ignore_rules(files: dict[str, str]) -> list[IgnoreRule]:
    """All rules in order: built-in ones, then those of ignore files (path of the directory: text), outer before inner; defaults if there are none."""
    rules = [named(n) for n in ALWAYS]
    if not files:
        return rules + [named(n) for n in DEFAULTS]
    for base in sorted(files):
        rules += parse_ignore(files[base], base)
    return rules


def ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """Whether the last rule that fits the path ignores it."""
    out = F.lit(False)
    for r in rules:
        out = F.when(path.rlike(r.pattern), F.lit(not r.negated)).otherwise(out)
    return out


#: Entries that a task lists before it hands on the folders that are left, tasks of a round, and bytes of files that a task reads.
TASK_ENTRIES, LISTING_TASKS, READ_BYTES = 20_000, 256, 64 << 20


@dataclass(frozen=True)
class Listing:
    """The files of a tree, nothing of them read: (path, size, mtime); and the texts of its ignore files by their folders."""

    uri: str
    files: DataFrame
    ignore_files: dict[str, str]


def listing(spark: SparkSession, root: str, skip: Iterable[str] = DEFAULTS) -> Listing:
    """All files in known languages under root, but for hidden ones and those in hidden folders or folders named in skip, which are never entered.

    Tasks list folder by folder, by Arrow's file systems; one that has listed
    TASK_ENTRIES hands its other folders on to the next round, so neither a wide nor a
    deep tree is one task's. Ignore files are read down to IGNORE_DEPTH.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    start = hadoop.Path(root)
    uri = start.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(start).toUri().toString()
    names, suffixes, budget = frozenset(skip), tuple(f".{x}" for x in LANGUAGES), TASK_ENTRIES

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        store, base = files.FileSystem.from_uri(uri)
        base = base.rstrip("/") + "/"
        todo = [f for batch in batches for f in batch.column(0).to_pylist()]
        seen = 0
        while todo and (not seen or seen < budget):
            folder = todo.pop()
            rows: list[dict] = []
            for info in store.get_file_info(files.FileSelector(base + folder)):
                name = info.base_name
                seen += 1
                if info.type == files.FileType.Directory:
                    if not name.startswith(".") and name not in names:
                        todo.append(f"{folder}{name}/")
                elif name == IGNORE_FILE and folder.count("/") <= IGNORE_DEPTH:
                    with store.open_input_file(info.path) as stream:
                        rows.append({"kind": "ignore", "path": folder, "text": stream.read().decode("utf-8", "replace")})
                elif not name.startswith(".") and name.lower().endswith(suffixes):
                    rows.append({"kind": "file", "path": folder + name, "size": info.size, "mtime": info.mtime_ns // 1_000 / 1e6})
            seen += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if todo:
            yield pa.RecordBatch.from_pylist([{"kind": "folder", "path": f} for f in todo], schema)

    schema = pa.schema([("kind", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("text", pa.string())])
    folders = spark.createDataFrame([("",)], "path string")
    found, more = [], 1
    while more:
        out = kept(folders.repartition(min(LISTING_TASKS, more)).mapInArrow(walk, "kind string, path string, size long, mtime double, text string"))
        found.append(out)
        folders = out.filter("kind = 'folder'").select("path")
        more = folders.count()
    everything = reduce(DataFrame.unionByName, found)
    texts = {r.path: r.text for r in everything.filter("kind = 'ignore'").select("path", "text").collect()}  # rules become one condition, so the driver needs them
    return Listing(uri, everything.filter("kind = 'file'").select("path", "size", "mtime"), texts)


def read_files(files: DataFrame, uri: str) -> DataFrame:
    """files (path, ...) with content as bytes: opened in tasks of about READ_BYTES; one that has gone since it was listed is left out, one larger than binaryFile's maxLength is an error."""
    spark = files.sparkSession
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    total = files.agg(F.sum("size")).first()[0] or 0
    path_at = files.columns.index("path")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as kinds

        store, base = kinds.FileSystem.from_uri(uri)
        base = base.rstrip("/") + "/"
        for batch in batches:
            for i, path in enumerate(batch.column(path_at).to_pylist()):
                try:
                    with store.open_input_file(base + path) as stream:
                        if stream.size() > most:
                            raise ValueError(f"{path} has {stream.size()} bytes, more than spark.sql.sources.binaryFile.maxLength = {most}")
                        content = stream.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary())], [*batch.schema.names, "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition(max(1, -(-total // READ_BYTES)), "path").mapInArrow(read, f"{schema}, content binary")


def scan(spark: SparkSession, root: str, rules: list[IgnoreRule] | None = None, ignore_folders: Iterable[str] = DEFAULTS) -> DataFrame:
    """(path, language, hash, size, mtime, content) of the files in known languages under root.

    Left out are hidden files and folders, folders of the given names, and what
    the ignore rules say: those given, else those of the tree's own ignore files
    (at the root and down to three folders below it). Only files that are left are
    opened. A store that Arrow can't open is an error, not a loss of files.
    """
    names = list(ignore_folders)
    tree = listing(spark, root, names)
    rules = ignore_rules(tree.ignore_files) if rules is None else rules
    wanted = tree.files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*LANGUAGES) & ~ignored(F.col("path"), rules))
    return read_files(wanted, tree.uri).select(
        "path",
        language_of(F.col("path")).alias("language"),
        F.md5("content").alias("hash"),
        F.octet_length("content").cast("long").alias("size"),
        "mtime",
        F.decode("content", "utf-8").alias("content"),
    )


def name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, status) of `git diff --name-status` lines; a rename has its new name."""
    parts = F.split(column, "\t")
    code = F.substring(column, 1, 1)
    status = F.when(code == "A", "added").when(code == "D", "deleted").when(code == "R", "renamed").otherwise("modified")
    return lines.filter(F.size(parts) >= 2).select(F.element_at(parts, -1).alias("path"), status.alias("status"))


def hunks(diffs: DataFrame, path: str = "path", diff: str = "diff") -> DataFrame:
    """(path, start, end) of the new lines of each hunk in a file's unified diff; pure deletions have none."""
    heads = diffs.select(path, F.explode(F.regexp_extract_all(diff, F.lit(r"(?m)^(@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"), 1)).alias("h"))
    start = F.regexp_extract("h", r"\+(\d+)", 1).cast("int")
    count = F.regexp_extract("h", r"\+\d+,(\d+)", 1)
    n = F.when(count == "", 1).otherwise(F.try_cast(count, "int")) if hasattr(F, "try_cast") else F.when(count == "", F.lit(1)).otherwise(F.expr("try_cast(regexp_extract(h, '\\\\+\\\\d+,(\\\\d+)', 1) AS int)"))
    return heads.select(path, start.alias("start"), (start + n - 1).alias("end"), n.alias("n")).filter("n > 0").drop("n")
