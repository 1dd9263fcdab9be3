"""Raw references resolved to edges, by prioritised equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normal_path
from lodestone.operators.ranges import by_prefix


def _first_two_files(nodes: DataFrame) -> DataFrame:
    """(name, id, file_id): for each name the least id of its first two files, so that one is left when a file is left out."""
    by_file = nodes.groupBy("name", "file_id").agg(F.min("id").alias("id"))
    order = Window.partitionBy("name").orderBy("id")
    return by_file.withColumn("_k", F.row_number().over(order)).filter("_k <= 2").select("name", "id", "file_id")


def module_path(file_path: F.Column, module: F.Column) -> F.Column:
    """The path that a relative module name means, seen from a file; null for other names."""
    joined = F.concat(F.regexp_replace(file_path, "[^/]*$", ""), module)
    return F.when(module.startswith("."), normal_path(joined))


def _files_of(nodes: DataFrame) -> DataFrame:
    """(path, target_file) of the files that have symbols."""
    return nodes.groupBy("path").agg(F.min("file_id").alias("target_file"))


def resolve_targets(refs: DataFrame, nodes: DataFrame, imports: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(ref_id, target_id, priority) of refs (ref_id, file_id, target_name).

    0: the symbol of that name in the file that the name is imported from
    (imports: file_id, name, target_path); 1: in the same file; 2: exported in
    another file; 3: any in another file. In each the least id. nodes may be those with
    the names that are asked for, if files are those of all.
    """
    names = nodes.select("name", "file_id", "id", "exported", "path")
    own = names.groupBy("name", "file_id").agg(F.min("id").alias("id"))
    found = refs.join(own, (F.col("target_name") == F.col("name")) & (refs["file_id"] == own["file_id"])).select("ref_id", F.col("id").alias("target_id"), F.lit(1).alias("priority"))
    for priority, candidates in ((2, names.filter("exported = 1")), (3, names)):
        other = _first_two_files(candidates).withColumnRenamed("file_id", "other_file")
        hit = refs.join(other, F.col("target_name") == F.col("name")).filter("file_id != other_file")
        found = found.unionByName(hit.groupBy("ref_id").agg(F.min("id").alias("target_id")).withColumn("priority", F.lit(priority)))
    if imports is not None:
        asked = refs.join(imports.withColumnRenamed("name", "target_name"), ["file_id", "target_name"]).select("ref_id", "target_name", "target_path")
        places = by_prefix(asked, "target_path", _files_of(nodes) if files is None else files, "path", "target_file")
        hit = places.join(own.select(F.col("name").alias("target_name"), F.col("file_id").alias("target_file"), "id"), ["target_name", "target_file"])
        hit = hit.groupBy("ref_id").agg(F.min("id").alias("target_id"))
        found = found.unionByName(hit.withColumn("priority", F.lit(0)))
    best = found.groupBy("ref_id").agg(F.min(F.struct("priority", "target_id")).alias("b"))
    return best.select("ref_id", "b.target_id", "b.priority")


def resolve_links(raw_refs: DataFrame, nodes: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(ref_id, source_id, target_id, kind): references whose source is known and whose target is another node.

    raw_refs: id, file_id, kind, source_qname, target_name. Kind call gives calls. Only
    nodes that a reference names, as its target or its source, are looked at closer.
    """
    refs = raw_refs.withColumnRenamed("id", "ref_id")
    asked = nodes.join(refs.select(F.col("target_name").alias("name")).distinct(), "name", "left_semi")
    own = nodes.select(F.col("qualified_name").alias("source_qname"), "id").join(refs.select("source_qname").distinct(), "source_qname", "left_semi")
    sources = own.groupBy("source_qname").agg(F.max("id").alias("source_id"))
    targets = resolve_targets(refs, asked, imports, _files_of(nodes))
    kind = F.when(F.col("kind") == "call", "calls").otherwise(F.col("kind"))
    return refs.join(sources, "source_qname").join(targets, "ref_id").filter("source_id != target_id").select("ref_id", "source_id", "target_id", kind.alias("kind"))


def resolve_edges(raw_refs: DataFrame, nodes: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, kind) of resolve_links, each once."""
    return resolve_links(raw_refs, nodes, imports).select("source_id", "target_id", "kind").distinct()


def import_links(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_id, name, target_path, source_id, target_id): the first node of an importing file and the first exported one of the imported name in its target.

    imports: file_id, name, target_path.
    """
    first = nodes.join(imports.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.min("id").alias("source_id"))
    placed = by_prefix(imports.select("file_id", "name", "target_path"), "target_path", _files_of(nodes), "path", "target_file").filter("target_file IS NOT NULL")
    exported = nodes.filter("exported = 1").groupBy(F.col("file_id").alias("target_file"), "name").agg(F.min("id").alias("target_id"))
    return placed.join(exported, ["target_file", "name"]).join(first, "file_id").filter("source_id != target_id").select("file_id", "name", "target_path", "source_id", "target_id")


def import_edges(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id) of import_links, each once."""
    return import_links(imports, nodes).select("source_id", "target_id").distinct()


def touched_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """The imports that may mean another file, or other symbols, now that these paths have changed: those whose target is a beginning of one."""
    begins = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("target_path")).distinct()
    return imports.join(begins, "target_path", "left_semi")


def open_references(refs: DataFrame, names: DataFrame, touched: DataFrame) -> DataFrame:
    """The references that may mean something else now: those that ask for one of the names (name), and those that are imported by a touched import."""
    by_name = refs.join(names.select(F.col("name").alias("target_name")).distinct(), "target_name", "left_semi")
    by_import = refs.join(touched.select("file_id", F.col("name").alias("target_name")).distinct(), ["file_id", "target_name"], "left_semi")
    return by_name.select(*refs.columns).unionByName(by_import.select(*refs.columns)).dropDuplicates(["id"])


def changed_symbols(nodes: DataFrame, changes: DataFrame, hunks: DataFrame) -> DataFrame:
    """(qualified_name, reason) for changes (path, status) and hunks (path, start, end).

    All symbols of added and deleted files and of files without hunks; else those
    that a hunk touches.
    """
    with_hunks = hunks.select("path").distinct().withColumn("has_hunks", F.lit(True))
    files = changes.join(with_hunks, "path", "left")
    whole = files.filter("status IN ('added', 'deleted') OR has_hunks IS NULL")
    every = nodes.join(whole.select("path"), "path", "left_semi").select("qualified_name", F.lit("in_changed_file").alias("reason"))
    part = files.filter("status NOT IN ('added', 'deleted') AND has_hunks").select("path")
    touched = nodes.join(part, "path", "left_semi").join(hunks, "path").filter("start_line <= end AND end_line >= start")
    return every.unionByName(touched.select("qualified_name", F.lit("in_diff").alias("reason"))).groupBy("qualified_name").agg(F.min("reason").alias("reason"))
