"""Batches of changes against full builds."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from graphloom.operators import assemble
from graphloom.sources import build, incremental, parse

SCHEMA = "path string, language string, sha string, loc long, content string"
SUFFIX = {"ts": "typescript", "py": "python", "go": "go", "java": "java", "ml": "ocaml", "elm": "elm", "rb": "ruby", "json": "json"}


def table(spark, texts):
    rows = [(p, SUFFIX[p.rpartition(".")[2]], hashlib.sha1(t.encode()).hexdigest()[:12], t.count("\n"), t) for p, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def some_texts():
    """Imports of each kind: relative, aliased, by folder, by part of a path, whatever the case."""
    return {
        "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}',
        "src/a.ts": "import { b } from './b'\nimport { c } from '@/lib/c'\nexport function a() {\n  return b() + c()\n}\n",
        "src/b.ts": "export function b() {\n  return 1\n}\n",
        "src/lib/c.ts": "import { late } from './late'\nexport function c() {\n  return late()\n}\n",
        "py/m.py": "from .n import f\n\ndef g():\n    return f()\n",
        "py/n.py": "def f():\n    return 1\n",
        "go/main.go": 'package main\nimport "example.com/tool"\nfunc Run() {\n  Help()\n}\n',
        "example.com/tool/x.go": "package tool\nfunc Help() {\n}\n",
        "j/A.java": "import p.q.*;\npublic class A {\n  public int a() {\n    return run();\n  }\n}\n",
        "p/q/B.java": "public class B {\n  public int run() {\n    return 1;\n  }\n}\n",
        "o/x.ml": "open Helper\nlet x = 1\n",
        "o/y.ml": "let y = 1\n",
        "e/Main.elm": "import Data.Json\nmain = 1\n",
        "r/a.rb": "require './b'\ndef r()\n  s(1)\nend\n",
        "r/b.rb": "def s()\n  1\nend\n",
    }


def changed_texts(texts):
    """Versions one after the other: added, removed, changed files, a moved config."""
    v2 = dict(texts) | {"src/lib/late.ts": "export function late() {\n  return 2\n}\n", "o/helper.ml": "let h = 1\n", "data/json.elm": "x = 1\n", "src/b.ts": "export function other() {\n  return 1\n}\n"}
    del v2["py/n.py"]
    v3 = dict(v2) | {"py/n/__init__.py": "def f():\n    return 3\n", "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["other/*"]}}}', "other/lib/c.ts": "export function c() {\n  return 1\n}\n", "a/example.com/tool/w.go": "package tool\nfunc Help() {\n}\n"}
    del v3["p/q/B.java"]
    v4 = dict(v3) | {"p/q/A.java": "public class Z {\n  public int run() {\n    return 1;\n  }\n}\n", "src/b.ts": texts["src/b.ts"]}
    del v4["tsconfig.json"], v4["r/b.rb"]
    return [texts, v2, v3, v4]


def shown(graph):
    """Files, symbols, and edges by path and name."""
    files = {r.id: r.path for r in graph.files.collect()}
    symbols = {r.id: (files[r.file_id], r.name, r.kind, r.start_line, r.end_line) for r in graph.symbols.collect()}
    imports = sorted((files[r.source_id], files[r.target_id], r.weight) for r in graph.import_edges.collect())
    calls = sorted((symbols[r.source_id], symbols[r.target_id], r.weight) for r in graph.call_edges.collect())
    return files, sorted(symbols.items()), imports, calls


def test_batches_equal_full_builds(spark, tmp_path):
    index, ids = incremental.Index(spark, f"file://{tmp_path}"), None
    for batch, texts in enumerate(changed_texts(some_texts())):
        scanned = table(spark, texts)
        assert index.apply(scanned, batch)
        if batch % 2:
            assert not index.apply(scanned, batch)
            got, want = shown(index.graph("r")), shown(build.build_graph(spark, scanned, "r", ids))
            assert got[0] == want[0] and got[1] == want[1]
            assert got[2] == want[2] and got[3] == want[3] and len(got[2]) > 3 and len(got[3]) > 0
        ids = index.files().select("path", "id")
    assert index.batches() == [0, 1, 2, 3]
    assert index.compact(4) and shown(index.graph("r")) == got
    assert {(r.parsed_in, r.resolved_in, r.linked_in) for r in index.files().collect()} == {(4, 4, 4)}


def test_only_what_a_change_touches_is_done_again(spark, tmp_path):
    texts = {f"d/f{i}.ts": f"import {{ x }} from './f{i + 1}'\nexport function n{i}() {{\n  return n{i + 1}()\n}}\n" for i in range(40)}
    index = incremental.Index(spark, f"file://{tmp_path}")
    index.apply(table(spark, texts), 1)
    last = texts.pop("d/f20.ts")
    index.apply(table(spark, texts), 2)
    index.apply(table(spark, texts | {"d/f20.ts": last + "// more\n", "d/f9.ts": texts["d/f9.ts"] + "// more\n"}), 3)
    done = {b: [spark.read.parquet(f"{tmp_path}/{t}/batch={b}").count() for t in ("parsed", "again", "relinked")] for b in (1, 2, 3)}
    # Without f20 its importer is resolved again; with it back that and itself, and f9, whose importer is linked again.
    assert done == {1: [40, 40, 40], 2: [0, 1, 1], 3: [2, 3, 4]}
    assert spark.read.parquet(f"{tmp_path}/links/batch=3").count() == 4
    # A batch that broke off before its number was in the log is written again.
    index.spark.createDataFrame([(1,)], "x int").write.parquet(f"file://{tmp_path}/symbols/batch=4")
    assert index.apply(table(spark, texts), 4) and index.import_edges().count() == 37


def test_watched_values_name_every_importer_whose_target_changes(spark):
    """Whatever paths come or go: an import that resolves otherwise is among those named."""
    rng = random.Random(1)
    texts = some_texts()
    pool = list(texts) + ["src/lib/late.ts", "src/b/index.ts", "O/HELPER.ml", "x/helper_y.ml", "Data/Json.elm", "data/JSON.elm", "p/q/A.java", "p/q/r/C.java", "0/example.com/tool", "py/n/__init__.py", "r/b"]
    SUFFIX.update({"com/tool": "go", "r/b": "ruby"})
    languages = {p: SUFFIX.get(p.rpartition(".")[2], "go") for p in pool}
    for _ in range(1):
        before, after = (sorted({*rng.sample(pool, len(pool) * 2 // 3), "src/a.ts", "j/A.java", "go/main.go", "o/x.ml", "e/Main.elm", "py/m.py", "r/a.rb", "src/lib/c.ts"}) for _ in range(2))
        ids = {p: i for i, p in enumerate(sorted(pool))}
        files = lambda paths: spark.createDataFrame([(ids[p], p, languages[p]) for p in paths], "id long, path string, language string")  # noqa: B023, E731
        given = spark.createDataFrame([(p, languages[p], str(i), t) for i, (p, t) in enumerate(texts.items())], "path string, language string, sha string, content string")
        imports = parse.tables(files(pool).join(given.select("path", "sha"), "path"), parse.parse_files(given))[1]
        found = []
        for paths in (before, after):
            importers = imports.join(files([p for p in paths if p in before and p in after]).select(F.col("id").alias("file_id")), "file_id", "left_semi")
            found.append({(r.file_id, r.specifier): r.target_id for r in build.resolve(files(paths), importers, {"": [("@/", "", ["src/*"])]}).collect()})
        moved = spark.createDataFrame([(p,) for p in set(before) ^ set(after)], "path string")
        named = {r.file_id for r in build.touched_importers(build.watched(build.tried(files(before), imports.join(files(before).select(F.col("id").alias("file_id")), "file_id", "left_semi"), {"": [("@/", "", ["src/*"])]})), moved).collect()}
        differ = {k[0] for k in found[0].keys() | found[1].keys() if found[0].get(k) != found[1].get(k)}
        assert differ <= named


def test_known_ids_survive(spark, tmp_path):
    index = incremental.Index(spark, f"file://{tmp_path}")
    index.apply(table(spark, {"b.py": "x = 1\n", "c.py": "y = 1\n"}), 1)
    index.apply(table(spark, {"a.py": "z = 1\n", "c.py": "y = 1\n"}), 2)
    assert {r.path: r.id for r in index.files().collect()} == {"c.py": 1, "a.py": 2}
    assert assemble.import_edges(index.rows("resolved")).count() == 0


def test_batches_and_their_rows_join_without_broadcasts(spark, monkeypatch):
    from graphloom.plans import catalog
    from graphloom.sources import incremental

    plans, put = [], incremental.Index._put

    def noted(self, table, batch, rows):
        plans.append((table, rows._jdf.queryExecution().executedPlan().toString()))
        return put(self, table, batch, rows)

    monkeypatch.setattr(incremental.Index, "_put", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    edges = catalog.QUERIES["reindexed_edges"](spark, "/root/testdata/sf0.001")
    plans.append(("edges", edges._jdf.queryExecution().executedPlan().toString()))
    # One explicit broadcast is left: the names that symbols have, up to a bounded number.
    assert {table for table, plan in plans if "BroadcastExchange" in plan} <= {"links"}
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_an_index_of_imports_parses_and_keeps_nothing_else(spark, tmp_path):
    texts = {p: t for p, t in some_texts().items() if p.endswith((".ts", ".py", ".json"))}
    index = incremental.Index(spark, f"file://{tmp_path}", links=False)
    index.apply(table(spark, {p: t for p, t in texts.items() if p != "src/b.ts"}), 1)
    index.apply(table(spark, texts), 2)
    paths = {r.id: r.path for r in index.files().collect()}
    assert {(paths[r.src], paths[r.dst]) for r in index.import_edges().collect()} == {("src/a.ts", "src/b.ts"), ("src/a.ts", "src/lib/c.ts"), ("py/m.py", "py/n.py")}
    parsed = spark.read.parquet(f"{tmp_path}/parsed/batch=1")
    assert parsed.where("size(symbols) + size(calls) > 0").count() == 0 and not {p.name for p in tmp_path.iterdir()} & {"symbols", "calls", "links"}
    # What is watched is told by digests, but for parts of paths.
    assert index.rows("watch").where("(digest is null) = (value is null)").count() == 0
