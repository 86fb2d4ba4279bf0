"""From a repository's files to a graph."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import ancestors, base_name
from graphloom.operators import assemble
from graphloom.operators.model import Graph
from graphloom.plans.shared_folder import written
from graphloom.sources import parse, scan

#: Languages whose packages resolve to the first file under a folder.
BY_FOLDER = ["java", "kotlin", "scala", "csharp"]
#: Modules that Swift brings along.
SWIFT_OWN = ["Foundation", "UIKit", "SwiftUI", "AppKit", "CoreData", "Dispatch", "Combine"]
CONFIGS = ("tsconfig.json", "jsconfig.json")
#: What is watched by a part of a path.
PARTS = ("part", "folded_part")

Rules = list[tuple[str, str, list[str]]]


def aliases_of(files: DataFrame) -> dict[str, Rules]:
    """Alias rules by the folder of each compiler config among ``path, content`` rows; configs are few, and one that can't be read counts for none."""
    found: dict[str, Rules] = {}
    configs = files.where(base_name(F.col("path")).isin(*CONFIGS)).select("path", "content").collect()
    for row in sorted(configs, key=lambda r: (r["path"].count("/"), not r["path"].endswith(CONFIGS[0]))):
        folder = row["path"].rpartition("/")[0]
        try:
            config = scan.parse_jsonc(row["content"])
        except ValueError:
            continue
        rules = scan.alias_rules(config, folder) if isinstance(config, dict) else []
        if rules:
            found.setdefault(folder, rules)
    return found


def _same_folded(wanted: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """``key..., path, target_id``: the first path that is one of ``names``, whatever the case."""
    named = wanted.select(*key, F.explode("names").alias("name")).withColumn("name", F.lower("name"))
    found = named.join(files.select(F.lower("path").alias("name"), "path", F.col("id").alias("target_id")), "name")
    return found.groupBy(*key).agg(F.min("path").alias("path"), F.min_by("target_id", "path").alias("target_id"))


def tried(files: DataFrame, imports: DataFrame, aliases: dict[str, Rules] | Rules | None = None) -> DataFrame:
    """``file_id, specifier, path, language, candidates``: the paths that each import tries, in order.

    ``aliases`` are the rules of configs by folder, of which a file's nearest holds
    (or one list for all files).
    """
    aliases = {"": aliases} if isinstance(aliases, list) else aliases or {}
    named = imports.join(files.select(F.col("id").alias("file_id"), "path", "language"), "file_id")
    made_of = parse.candidates(F.col("language"), F.col("path"), F.col("specifier"))
    if aliases:
        dirs = files.sparkSession.createDataFrame([(d,) for d in aliases], "config_dir string")
        nearest = assemble.nearest_config(files, dirs).withColumnRenamed("id", "file_id")
        named = named.join(nearest, "file_id", "left")
        made = F.array().cast("array<string>")
        for folder, rules in aliases.items():
            made = F.when(F.col("config_dir") == folder, assemble.alias_candidates(F.col("specifier"), rules)).otherwise(made)
        made = F.flatten(F.transform(made, lambda c: F.array(*[F.concat(c, F.lit(e)) for e in parse.TRIED["typescript"]])))
        script = F.col("language").isin("typescript", "javascript") & ~F.col("specifier").startswith(".")
        made_of = F.when(script, F.concat(made, made_of)).otherwise(made_of)
    return named.withColumn("candidates", made_of)


def slashed_name() -> Column:
    """A dotted specifier as a path."""
    return F.replace(F.regexp_replace("specifier", r"\.\*$", ""), F.lit("."), F.lit("/"))


def watched(named: DataFrame) -> DataFrame:
    """``file_id, kind, digest, value`` of ``tried`` rows: what a path that comes or goes must be for an import to be resolved anew.

    The inverse of ``resolve``: a path that is tried (``path``; ``folded`` in lower
    case), a folder that it lies in (``folder``), or a part of it (``part``;
    ``folded_part`` in lower case).  Of all but parts only a digest is kept: one that is
    equal by chance has an import resolved again that stays the same.
    """
    slashed, none = slashed_name(), F.array().cast("array<struct<kind: string, value: string>>")
    of = lambda kind, *values: F.array(*[F.struct(F.lit(kind).alias("kind"), v.alias("value")) for v in values])
    language, folded = F.col("language"), F.lower("specifier")
    more = (
        F.when(language.isin(*BY_FOLDER), of("folder", slashed))
        .when(language == "go", of("part", F.col("specifier")))
        .when(language == "swift", of("part", slashed))
        .when(language == "elm", of("folded", F.lower(F.concat(slashed, F.lit(".elm")))))
        .when(language.isin("ocaml", "elixir"), F.concat(of("folded_part", folded), of("folded", F.lower(F.concat(slashed, F.lit(".ml"))), F.lower(F.concat(slashed, F.lit(".mli"))))))
        .otherwise(none)
    )
    paths = F.transform("candidates", lambda c: F.struct(F.lit("path").alias("kind"), c.alias("value")))
    part = F.col("w.kind").isin(*PARTS)
    every = named.select("file_id", F.explode(F.concat(paths, more)).alias("w"))
    return every.select("file_id", F.when(part, F.col("w.kind")).alias("kind"), F.when(~part, F.xxhash64("w.kind", "w.value")).alias("digest"), F.when(part, F.col("w.value")).alias("value"))


def touched_importers(watch: DataFrame, moved: DataFrame) -> DataFrame:
    """``file_id`` (and ``batch``, if rows have it) of those whose imports a path among ``moved`` (those that came or went) may resolve otherwise."""
    run, path, key = 4, F.col("path"), [c for c in ("file_id", "batch") if c in watch.columns]
    equal = moved.select(F.lit("path").alias("kind"), path.alias("value")).unionByName(moved.select(F.lit("folded").alias("kind"), F.lower("path").alias("value")))
    equal = equal.unionByName(moved.select(F.lit("folder").alias("kind"), F.explode(ancestors(path)).alias("value"))).select(F.xxhash64("kind", "value").alias("digest")).distinct()
    found = watch.where("digest is not null").join(equal, "digest", "left_semi").select(*key)
    parts = watch.where(F.col("kind").isin(*PARTS)).distinct().withColumn("size", F.least(F.lit(run), F.length("value")))
    parts = parts.withColumn("gram", F.substring("value", F.lit(1), F.col("size")))
    forms = moved.select(F.lit("part").alias("kind"), path.alias("p")).unionByName(moved.select(F.lit("folded_part").alias("kind"), F.lower("path").alias("p")))
    runs = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("p") - size + 1)), lambda i: F.struct(F.lit(size).alias("size"), F.substring(F.col("p"), i, F.lit(size)).alias("gram")))
    grams = forms.select("kind", "p", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("size"), F.lit("").alias("gram"))), *[runs(k) for k in range(1, run + 1)])).alias("g")).select("kind", "p", "g.*").distinct()
    held = parts.join(grams, ["kind", "size", "gram"]).where(F.contains("p", "value")).select(*key)
    return found.unionByName(held).distinct()


def resolve(files: DataFrame, imports: DataFrame, aliases: dict[str, Rules] | Rules | None = None) -> DataFrame:
    """``file_id, specifier, target_id`` of imports; ``resolved`` says how."""
    return resolved(files, written(tried(files, imports, aliases), "tried"))


def resolved(files: DataFrame, named: DataFrame) -> DataFrame:
    """``file_id, specifier, target_id`` of ``tried`` rows: candidate paths first, then what a language has besides.

    Java and its like take the first file under the package's folder; Go the first
    path that holds the module's; Swift the same among its own files; Elm a path that
    differs in case alone; OCaml and Elixir the first path that is the module's, or
    holds its name, whatever the case.
    """
    key = ["file_id", "specifier"]
    direct = assemble.first_candidate(named.select(*key, "candidates"), files, key)
    # One row a language; those that have no other way need no other join.
    present = {r["language"] for r in named.select("language").distinct().collect()}
    if not present & {*BY_FOLDER, "go", "swift", "elm", "ocaml", "elixir"}:
        return direct
    direct = written(direct, "direct")
    left, slashed = written(named.drop("candidates").join(direct, key, "left_anti"), "unresolved"), slashed_name()
    of = lambda *languages: left.where(F.col("language").isin(*languages))
    if present & set(BY_FOLDER):
        direct = direct.unionByName(assemble.under_folder(of(*BY_FOLDER).select(*key, slashed.alias("folder")), files, key))
    if "go" in present:
        go = of("go").where(F.split("specifier", "/")[0].contains("."))
        direct = direct.unionByName(assemble.containing(go.select(*key, F.col("specifier").alias("needle")), files, key))
    if "swift" in present:
        swift = of("swift").where(~F.col("specifier").isin(*SWIFT_OWN)).select(*key, slashed.alias("needle"))
        direct = direct.unionByName(assemble.containing(swift, files, key, suffix=".swift"))
    if "elm" in present:
        direct = direct.unionByName(_same_folded(of("elm").select(*key, F.array(F.concat(slashed, F.lit(".elm"))).alias("names")), files, key).drop("path"))
    if present & {"ocaml", "elixir"}:
        folded = of("ocaml", "elixir")
        holding = assemble.containing(folded.select(*key, F.col("specifier").alias("needle")), files, key, fold_case=True).join(files.select(F.col("id").alias("target_id"), "path"), "target_id")
        equal = _same_folded(folded.select(*key, F.array(F.concat(slashed, F.lit(".ml")), F.concat(slashed, F.lit(".mli"))).alias("names")), files, key)
        direct = direct.unionByName(holding.select(*key, "path", "target_id").unionByName(equal).groupBy(*key).agg(F.min_by("target_id", "path").alias("target_id")))
    return direct


def build_graph(spark: SparkSession, scanned: DataFrame, name: str, known: DataFrame | None = None, aliases: dict[str, Rules] | Rules | None = None) -> Graph:
    """Ids, parsed symbols, import edges and call edges of scanned files; aliases, unless given, are those of the configs among them."""
    files = written(assemble.file_ids(scanned, known), "files")
    aliases = aliases_of(files) if aliases is None else aliases
    parsed = written(parse.parse_files(files), "parsed")
    symbols, imports, calls = parse.tables(files, parsed)
    symbols = written(assemble.symbol_ids(symbols).drop("pos"), "symbols")
    edges = written(assemble.import_edges(resolve(files, imports, aliases)), "import-edges")
    numbered = written(assemble.numbered_edges(edges, files), "edges")
    start = numbered.count()
    called = assemble.call_edges(calls, symbols, edges)
    from graphloom.operators.numbering import numbered as number

    call_edges = number(called, ["src", "dst"], start=start).select("id", F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "weight")
    return Graph(name, files, symbols, numbered, written(call_edges, "call-edges"))


def build_repo(spark: SparkSession, root: str, known: DataFrame | None = None) -> Graph:
    """A repository on a disk that executors reach."""
    return build_graph(spark, scan.scan_repo(spark, root), os.path.basename(os.path.abspath(root)), known)
