"""Scanning a repository: ignore rules, languages, line counts, digests.

Folders are listed by tasks, level by level, each with the ignore rules that hold in
it, so that ignored ones are never entered and no list of paths is on the driver;
tasks read the content of the files that are left.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import loc, loc_trimmed, looks_binary, low_byte_sha
from graphloom.plans.shared_folder import written
from graphloom.sources import rules as automaton
from graphloom.sources.languages import detect_language
from graphloom.sources.rules import RuleSet

MOST_BYTES = 1_500_000
#: Folders that no repository wants indexed.
ALWAYS_IGNORED = [
    ".git/", ".hg/", ".svn/", ".idea/", ".vscode/",
    "node_modules/",
    ".venv/", "venv/", "__pycache__/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/", ".tox/", ".nox/",
    ".next/", ".nuxt/", ".svelte-kit/", ".astro/", ".turbo/", ".parcel-cache/", ".cache/",
    ".gradle/", ".dart_tool/", ".cargo/", ".vercel/", ".netlify/", ".output/", ".docusaurus/",
]
#: What a repository leaves out only because it has a language.
LANGUAGE_IGNORED = {
    "typescript": ["dist/", "build/", "out/", ".contentlayer/", ".wrangler/", ".expo/", ".linaria-cache/", ".rollup.cache/", "storybook-static/", "coverage/", "*.min.js", "*.map", "*.bundle.js"],
    "javascript": ["dist/", "build/", "out/", ".contentlayer/", ".wrangler/", ".expo/", ".linaria-cache/", ".rollup.cache/", "storybook-static/", "coverage/", "*.min.js", "*.map", "*.bundle.js"],
    "python": ["dist/", "build/", ".env/", "env/", ".hypothesis/", ".mypy/", ".pyre/", ".pytype/", "*.egg-info/", "*.egg/", "*.pyc", "*.pyo", "htmlcov/", ".coverage*"],
    "go": ["dist/", "build/", "vendor/", "bin/"],
    "rust": ["dist/", "build/", "target/"],
    "java": ["build/", "out/", "target/", "*.class", "*.jar", "*.war"],
    "c": ["build/", "out/", "CMakeFiles/", ".cmake/", ".clangd/", ".ccls-cache/", "*.o", "*.obj", "*.a", "*.so", "*.dylib", "*.dll"],
    "cpp": ["build/", "out/", "CMakeFiles/", ".cmake/", ".clangd/", ".ccls-cache/", "*.o", "*.obj", "*.a", "*.so", "*.dylib", "*.dll"],
    "csharp": ["bin/", "obj/", ".vs/", "packages/", "*.dll", "*.exe", "*.nupkg"],
    "kotlin": ["build/", "out/", "target/", ".kotlin/", "*.class", "*.jar"],
    "ruby": ["vendor/bundle/", ".bundle/", "tmp/", "log/", "*.gem"],
    "php": ["dist/", "build/", "vendor/", "var/", "bootstrap/cache/", "*.phar"],
    "swift": ["build/", ".build/", "DerivedData/", "Pods/", "Carthage/"],
    "scala": ["build/", "out/", ".ivy/", ".coursier/", ".sbt/", ".metals/", ".bloop/", ".bsp/", "target/", "*.class", "*.jar"],
    "dart": ["dist/", "build/", "out/", ".pub-cache/", "*.g.dart", "*.freezed.dart"],
    "zig": ["dist/", "build/", "zig-cache/", ".zig-cache/", "zig-out/", "*.o"],
    "lua": ["dist/", "build/", "lua_modules/", ".luarocks/", "*.luac"],
    "r": ["dist/", "build/", "renv/", "packrat/", ".Rproj.user/", "*.o", "*.so", "*.dll"],
    "elixir": ["deps/", "_build/", ".elixir_ls/", ".lexical/", "rel/", "cover/", "doc/", "*.beam"],
    "elm": ["dist/", "build/", "out/", "elm-stuff/"],
    "ocaml": ["dist/", "build/", "_opam/", "_build/", ".merlin", "*.cmo", "*.cmi", "*.cmx", "*.o"],
    "rescript": ["dist/", "build/", "out/", "lib/bs/", "lib/es6/", "lib/ocaml/", "*.bs.js"],
    "solidity": ["dist/", "build/", "out/", "artifacts/", "cache/", "broadcast/", "typechain-types/", "*.abi.json"],
    "tlaplus": ["dist/", "build/", "out/", ".toolbox/", "*.states", "*.traces"],
    "objc": ["build/", "DerivedData/", "Pods/", "*.o", "*.obj", "*.a"],
    "bash": ["dist/", "build/", "out/"],
    "vue": ["dist/", "build/", "out/", "coverage/", "storybook-static/", "*.min.js", "*.map"],
    "html": ["dist/", "build/", "out/", "_site/"],
    "css": ["dist/", "build/", "out/", ".sass-cache/", "*.min.css", "*.css.map"],
    "json": ["dist/", "build/", "out/", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb"],
    "yaml": ["dist/", "build/", "out/"],
    "toml": ["dist/", "build/", "out/"],
    "embedded_template": ["dist/", "build/", "out/", "vendor/", "tmp/", "log/"],
    "systemrdl": ["build/", "out/", "gen/", "generated/"],
    "ql": ["dist/", "build/", "out/", ".codeql/", "*.bqrs", "*.sarif"],
    "elisp": ["dist/", "build/", "out/", "elpa/", "quelpa/", "straight/", "*.elc", "*.eln"],
}


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file, as a pattern over paths below ``folder``."""

    pattern: str
    negate: bool
    folder: str = ""
    line: str = ""


def compile_rule(line: str, folder: str = "") -> Rule | None:
    """A subset of gitignore: comments, ``!``, leading and trailing slashes, ``*``, ``**`` and ``?``.

    A space means ``**`` too: a deviation from gitignore that existing indexes rely on.
    """
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    negate = text.startswith("!")
    text = text[1:] if negate else text
    text = text[:-1] if text.endswith("/") else text
    anchored = text.startswith("/")
    text = text[1:] if anchored else text
    body = "".join({"**": ".*", " ": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", text))
    return Rule(("^" if anchored else "(^|/)") + body + "(/|$)", negate, folder, line)


def compile_rules(lines: list[str], folder: str = "") -> list[Rule]:
    return [r for r in (compile_rule(x, folder) for x in lines) if r]


def language_rules(present: list[str]) -> list[Rule]:
    """Rules that hold in a repository because it has these languages; they are known once it has been listed."""
    return compile_rules(sorted({line for language in present for line in LANGUAGE_IGNORED.get(language, [])}))


def without_outputs(files: DataFrame) -> DataFrame:
    """``path, language, ...`` without what the rules of the languages present exclude; the languages are a bounded list."""
    present = [r["language"] for r in files.select("language").where("language is not null").distinct().collect()]
    return files.where(~excluded(F.col("path"), language_rules(present)))


def excluded(path: Column, rules: list[Rule]) -> Column:
    """Whether the last rule that matches a path excludes it."""
    return automaton.excluded(path, [(r.line, r.folder) for r in rules])


def is_excluded(path: str, rules: list[Rule]) -> bool:
    """The same for one path, while folders are walked."""
    out = False
    for r in rules:
        if r.folder and not path.startswith(r.folder + "/"):
            continue
        if re.search(r.pattern, path[len(r.folder) + 1 :] if r.folder else path):
            out = not r.negate
    return out


def parse_jsonc(text: str):
    """JSON with comments and trailing commas; what looks like either inside a string stays."""
    tokens = re.findall(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|\s+|,|[^"/,\s]+|/', text, re.S)
    out: list[str] = []
    comma = None  # where the last token but gaps is a comma
    for t in tokens:
        if t.startswith(("//", "/*")) or t.isspace():
            continue
        if t[0] in "}]" and comma is not None:
            out[comma] = ""
        comma = len(out) if t == "," else None
        out.append(t)
    return json.loads("".join(out))


def config_excludes(root: str, folder: str) -> list[str]:
    """The ``exclude`` list of a folder's own compiler config, anchored there."""
    for name in ("tsconfig.json", "jsconfig.json"):
        try:
            with open(os.path.join(root, folder, name), encoding="utf-8") as f:
                found = parse_jsonc(f.read())
        except OSError:
            continue
        except ValueError:
            return []
        listed = found.get("exclude") if isinstance(found, dict) else None
        return ["/" + x.removeprefix("/") for x in listed or [] if isinstance(x, str)]
    return []


def alias_rules(config: dict, folder: str = "") -> list[tuple[str, str, list[str]]]:
    """``(prefix, suffix, targets)`` from a compiler config's ``paths``."""
    options = config.get("compilerOptions") or {}
    base = os.path.normpath(os.path.join(folder, options.get("baseUrl", "."))).replace(os.sep, "/")
    place = lambda t: os.path.normpath(os.path.join(base, t)).replace(os.sep, "/")
    return [(*k.split("*", 1), [place(t) for t in v]) if "*" in k else (k, "", [place(t) for t in v]) for k, v in (options.get("paths") or {}).items()]


def _lines(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read().splitlines()
    except OSError:
        return []


def rules_of(root: str, folder: str = "") -> list[tuple[str, str]]:
    """``(line, folder)`` of a folder's own ignore file and compiler config."""
    own = _lines(os.path.join(root, folder, ".gitignore")) + config_excludes(root, folder)
    return [(line, folder) for line in own]


def in_folder(root: str, folder: str, rules: list[tuple[str, str]]) -> tuple[list[tuple[str, int, int]], list[str]]:
    """``(path, size, modified)`` of a folder's files and the folders in it, without what the rules exclude; links aren't followed."""
    kept, files, folders = RuleSet(rules), [], []
    with os.scandir(os.path.join(root, folder)) as entries:
        for e in sorted(entries, key=lambda e: e.name):
            path = f"{folder}/{e.name}" if folder else e.name
            if kept.excludes(path):
                continue
            if e.is_dir(follow_symlinks=False):
                folders.append(path)
            elif e.is_file():
                told = e.stat()
                files.append((path, told.st_size, told.st_mtime_ns // 1_000_000))
    return files, folders


def listed(spark: SparkSession, root: str, extra: list[str] | None = None, most_bytes: int | None = None, suffixes: list[str] | None = None) -> DataFrame:
    """``path, size, last_modified_ms`` of files that no rule excludes; nested rules hold below their folder.

    A job lists one level of folders, of which the driver only learns how many there
    are.  ``most_bytes`` and ``suffixes`` are applied where files are listed.
    """
    root, wanted = os.path.abspath(root), None if suffixes is None else tuple(f".{x.lower()}" for x in suffixes)
    names, tasks = "path string, size long, last_modified_ms long, folder string, rules array<struct<line: string, folder: string>>", int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for folder, given in zip(frame["folder"], frame["rules"], strict=True):
                rules = [(r["line"], r["folder"]) for r in given]
                rules += rules_of(root, folder) if folder else []
                files, folders = in_folder(root, folder, rules)
                out += [(p, n, t, None, None) for p, n, t in files if (most_bytes is None or n <= most_bytes) and (wanted is None or p.lower().endswith(wanted))]
                out += [(None, None, None, f, [{"line": a, "folder": b} for a, b in rules]) for f in folders]
            found = pd.DataFrame(out, columns=["path", "size", "last_modified_ms", "folder", "rules"])
            yield found.astype({"size": "Int64", "last_modified_ms": "Int64"})

    first = [(line, "") for line in ALWAYS_IGNORED] + rules_of(root) + [(line, "") for line in extra or []]
    level = spark.createDataFrame([("", first)], "folder string, rules array<struct<line: string, folder: string>>")
    levels = []
    while not level.isEmpty():
        found = written(level.repartition(tasks).mapInPandas(run, names), "listed")
        levels.append(found.where("path is not null").select("path", "size", "last_modified_ms"))
        level = found.where("folder is not null").select("folder", "rules")
    return reduce(DataFrame.unionByName, levels)


def described(raw: DataFrame) -> DataFrame:
    """``path, content`` to scanned files: known languages only, no binaries, with line count and digest."""
    kept = raw.withColumn("language", detect_language(F.col("path"))).where("language is not null").where(~looks_binary(F.col("content")))
    return kept.withColumns({"loc": loc(F.col("content")), "sha": low_byte_sha(F.col("content"))})


def scan_repo(spark: SparkSession, root: str, extra: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``path, language, loc, sha, last_modified_ms, content`` of a repository's text files.

    Spark's own file sources skip names that begin with a dot or an underscore,
    which repositories are full of, so tasks open the listed files themselves;
    the repository must lie where executors reach it.
    """
    root = os.path.abspath(root)
    paths = listed(spark, root, extra, most_bytes)
    # Known binaries and other languages' outputs are never opened.
    wanted = without_outputs(paths.withColumn("language", detect_language(F.col("path"))).where("language is not null")).select("path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(f"file://{root}")
        for frame in frames:
            for info in store.get_file_info([f"{top}/{p}" for p in frame["path"]]):
                if info.is_file and info.size <= most_bytes:
                    with store.open_input_stream(info.path) as file:
                        text = file.read().decode("utf-8", "replace")
                    yield pd.DataFrame({"path": [info.path[len(top) + 1 :]], "content": [text], "last_modified_ms": [info.mtime_ns // 1_000_000]})

    return described(wanted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, "path string, content string, last_modified_ms long"))


def from_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """The same from ``(path, content)`` pairs in memory, where lines of blanks alone don't count."""
    given = described(spark.createDataFrame(rows, "path string, content string").withColumn("last_modified_ms", F.lit(0).cast("long")))
    return given.withColumn("loc", loc_trimmed(F.col("content")))


def repo_url(url: Column) -> Column:
    """``struct<owner, name, ref>`` of a hosted repository's address."""
    pattern = r"^(?:https?://)?(?:www\.)?github\.com/([^/]+)/([^/#?]+?)(?:\.git)?(?:/tree/([^?#]+))?/?(?:[?#].*)?$"
    part = lambda i: F.nullif(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.struct(part(1).alias("owner"), part(2).alias("name"), part(3).alias("ref"))


def commit_log(spark: SparkSession, text_path: str, prefix: str = "") -> DataFrame:
    """``path, commit_id, ts, author`` from ``git log --name-only --format=%x01%H%x02%ct%x02%an`` output, cut to a folder."""
    commits = spark.read.option("lineSep", "\x01").text(text_path).where("length(trim(value)) > 0")
    head = F.split(F.split("value", "\n")[0], "\x02")
    names = F.filter(F.slice(F.split("value", "\n"), 2, 1 << 20), lambda n: n != "")
    rows = commits.select(head[0].alias("commit_id"), F.timestamp_seconds(head[1].cast("long")).alias("ts"), head[2].alias("author"), F.explode(names).alias("path"))
    if prefix:
        rows = rows.where(F.startswith("path", F.lit(prefix))).withColumn("path", F.substring("path", F.lit(len(prefix) + 1), F.length("path")))
    return rows.select("path", "commit_id", "ts", "author")


#: What is indexed without a checkout at most (files, bytes, bytes of a file), and folders that are left out there.
HOSTED_FILES, HOSTED_BYTES, HOSTED_FILE_BYTES = 1500, 20_971_520, 1_572_864
HOSTED_IGNORED = r"(^|/)(node_modules|\.git|dist|build|out|\.next|\.turbo|coverage|vendor|target|__pycache__|\.venv|venv)(/|$)"
#: Suffixes of files that are not fetched; fewer than those of ``languages.BINARY``.
HOSTED_BINARY = (
    "png jpg jpeg gif bmp ico webp tiff svg avif heic pdf mp4 mov avi webm mkv mp3 wav flac ogg m4a woff woff2 ttf otf eot "
    "zip tar gz tgz bz2 xz zst rar 7z jar war class so dylib dll exe bin dat wasm node pyc parquet db sqlite lock"
)


def hosted(tree: DataFrame) -> DataFrame:
    """Files (``kind`` blob) of a hosted repository's ``path, kind, size`` listing that are fetched.

    What follows a path's last dot is its suffix, the whole path where it has none.
    """
    suffix = F.lower(F.substring_index("path", ".", -1))
    return tree.where((F.col("kind") == "blob") & ~F.col("path").rlike(HOSTED_IGNORED) & ~suffix.isin(*HOSTED_BINARY.split()) & (F.coalesce("size", F.lit(0)) <= HOSTED_FILE_BYTES))


def checked_size(picked: DataFrame, most_files: int = HOSTED_FILES, most_bytes: int = HOSTED_BYTES) -> DataFrame:
    """``picked``, or an error if that is more than is indexed without a checkout."""
    n, size = picked.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n > most_files or size > most_bytes:
        raise ValueError(f"too large to index without a checkout: {n} files, {size} bytes")
    return picked


def browsed(entries: DataFrame, hidden: bool = False) -> DataFrame:
    """``name, is_git`` of folders to choose from, repositories first, then by name whatever the case; hidden ones on demand."""
    kept = entries if hidden else entries.where(~F.startswith("name", F.lit(".")))
    return kept.orderBy(F.desc("is_git"), F.lower("name"), "name")


def fresh(written_at: Column, index_at: Column, now: Column, ttl_minutes: int = 60) -> Column:
    """Whether a stored graph may be served: younger than its time to live and newer than the repository's index."""
    return (now - written_at < F.expr(f"interval {ttl_minutes} minutes")) & (index_at.isNull() | (written_at > index_at))
