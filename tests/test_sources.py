"""A repository on disk, parsing, bundles and streams."""

from __future__ import annotations

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.operators import rank, retrieval, views
from graphloom.sources import build, exchange, parse, scan
from graphloom.streaming import live

FILES = {
    "src/types.ts": "export interface User {\n  id: string\n}\nexport type Role = 'admin' | 'user'\n",
    "src/auth.ts": "import type { User } from './types'\nexport function login(u: User) {\n  return check(u)\n}\nfunction check(u: User) {\n  return true\n}\n",
    "src/api.ts": "import { login } from './auth'\nimport { Role } from './types'\nexport const handler = () => {\n  login(null)\n}\n",
    "lib/util.py": "from .inner import run\nimport os\n\ndef helper():\n    return run()\n\nclass _Hidden:\n    pass\n",
    "lib/inner/__init__.py": "def run():\n    return 1\n",
    "main.go": 'package main\nimport (\n  "fmt"\n  "example.com/app/pkg"\n)\nfunc Main() {\n  fmt.Println("x")\n}\nfunc hidden() {}\n',
    "example.com/app/pkg/a.go": "package pkg\ntype Thing struct {}\n",
    "node_modules/x/index.js": "ignored()",
    "build/out.js": "ignored()",
    "sub/keep.log": "kept",
    "sub/drop.log": "dropped",
    "logo.png": "x",
    "bin.txt": "a\0b",
    ".gitignore": "build/\n*.log\n!keep.log\n",
    "sub/.gitignore": "drop*\n",
    "tsconfig.json": '{\n  // comment\n  "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"],}},\n}',
    "src/page.tsx": "import { handler } from '@/api'\nexport default function Page() {\n  handler()\n}\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("repo")
    for path, text in FILES.items():
        file = top / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    return str(top)


def test_scan_prunes_and_describes(spark, root):
    found = {r.path: r for r in scan.scan_repo(spark, root).collect()}
    assert not any(p.startswith(("node_modules", "build")) for p in found) and {"logo.png", "bin.txt", "sub/drop.log"}.isdisjoint(found)
    assert "sub/keep.log" in found and found["src/auth.ts"].language == "typescript" and found["src/auth.ts"]["loc"] == 7
    assert found["tsconfig.json"].language == "json" and found[".gitignore"].language == "other"


def test_repository_to_graph(spark, root):
    g = build.build_repo(spark, root)
    path = {r.id: r.path for r in g.files.collect()}
    imports = {(path[r.source_id], path[r.target_id]) for r in g.import_edges.collect()}
    assert imports == {
        ("src/auth.ts", "src/types.ts"), ("src/api.ts", "src/auth.ts"), ("src/api.ts", "src/types.ts"), ("src/page.tsx", "src/api.ts"),
        ("lib/util.py", "lib/inner/__init__.py"), ("main.go", "example.com/app/pkg/a.go"),
    }
    symbols = {(path[r.file_id], r.name): (r.kind, r.exported) for r in g.symbols.collect()}
    assert symbols[("src/types.ts", "User")] == ("interface", True) and symbols[("src/types.ts", "Role")] == ("type", True)
    assert symbols[("src/auth.ts", "check")] == ("function", False) and symbols[("lib/util.py", "_Hidden")] == ("class", False)
    assert symbols[("main.go", "Main")] == ("function", True) and symbols[("main.go", "hidden")] == ("function", False)
    name = {r.id: r.name for r in g.symbols.collect()}
    calls = {(name[r.source_id], name[r.target_id]) for r in g.call_edges.collect()}
    assert {("login", "check"), ("handler", "login"), ("helper", "run"), ("Page", "handler")} <= calls
    scores = rank.centrality(g.files, views.links(g))
    wanted = spark.createDataFrame([("login",), ("auth.ts",), ("./src/api.ts",)], "target string")
    assert {r.target: path[r.file_id] for r in retrieval.resolve_file_target(g.files, g.symbols, wanted).collect()} == {"login": "src/auth.ts", "auth.ts": "src/auth.ts", "./src/api.ts": "src/api.ts"}
    assert views.resolve_context(g, "add admin role check to login").text.index("src/auth.ts") > 0 and scores.count() == len(path)


CODE = {
    "javascript": ("import x from './x'\nconst y = require('z')\nexport class A {\n  m() {}\n}\nfunction f() {\n  const inner = 1\n  g()\n}\n", {("A", "class"), ("f", "function"), ("y", "const")}, {"./x"}),
    "rust": ("use crate::a::b;\npub struct S {}\nenum E { X }\npub trait T {}\nfn f() { g(); }\nconst C: u8 = 1;\n", {("S", "class"), ("E", "type"), ("T", "interface"), ("f", "function"), ("C", "const")}, {"crate::a::b"}),
    "java": ("import a.b.C;\npublic class D {\n  public int m(int x) {\n    return n(x);\n  }\n}\n", {("D", "class"), ("m", "function")}, {"a.b.C"}),
    "c": ('#include "a.h"\n#include <stdio.h>\nstruct p { int x; };\nint main(void) {\n  return f(1);\n}\n', {("p", "class"), ("main", "function")}, {'"a.h"', "<stdio.h>"}),
    "ruby": ("require_relative 'a'\nclass B\n  def m(x)\n    n(x)\n  end\nend\n", {("B", "class"), ("m", "function")}, {"a"}),
    "php": ("<?php\nrequire 'a.php';\nclass B {\n function m() { n(); }\n}\n", {("B", "class"), ("m", "function")}, {"a.php"}),
    "bash": ("source ./a.sh\nX=1\nf() {\n  g\n}\n", {("X", "const"), ("f", "function")}, {"./a.sh"}),
    "kotlin": ("import a.B\nclass C\nfun f() { g() }\n", {("C", "class"), ("f", "function")}, {"a.B"}),
    "css": (".a { color: red }\n#b { }\n", {(".a", "type"), ("#b", "type")}, set()),
    "yaml": ("a:\n  b: 1\nc: 2\n", {("a", "const"), ("c", "const")}, set()),
    "toml": ("[t]\nk = 1\n", {("t", "class"), ("k", "const")}, set()),
}


@pytest.mark.parametrize("language", sorted(CODE))
def test_languages(language):
    text, symbols, imports = CODE[language]
    found = parse.parse_text(language, text)
    assert {(s["name"], s["kind"]) for s in found["symbols"]} == symbols and set(found["imports"]) == imports


def test_every_language_survives_junk():
    for language in [*parse.LANGUAGES, "python", "unknown"]:
        for text in ("", "\0", "{" * 500, "def (", "'" * 99):
            assert set(parse.parse_text(language, text)) == {"symbols", "imports", "calls", "failed"}


def test_ignore_rules():
    rules = scan.compile_rules(["# no", "", "*.log", "!keep.log", "/top", "a/**/b", "dir/"])
    test = lambda p: scan.is_excluded(p, rules)
    assert test("x/y.log") and not test("x/keep.log") and test("top/z") and not test("x/top") and test("q/a/1/2/b/c") and test("x/dir/f") and not test("dirs/f")
    assert scan.parse_jsonc('{"a": "// no, ]", /* c */ "b": [1, 2,], }') == {"a": "// no, ]", "b": [1, 2]}


def test_bundle_round_trip_and_verdicts(spark, tmp_path):
    f = spark.createDataFrame([(0, "a.ts", "klingon", 1, "s", 0.0)], "id long, path string, language string, loc long, sha string, last_modified double")
    e = spark.createDataFrame([(0, 0, 0, "file", "file", "import")], "id long, source_id long, target_id long, source_kind string, target_kind string, edge_kind string")
    exchange.write_bundle({"files": f, "edges": e}, ("r", "repo"), f"file://{tmp_path}/b", "2024-01-01T00:00:00Z")
    back = exchange.read_bundle(spark, f"file://{tmp_path}/b")
    assert exchange.read_table(back, "files").first().language == "other" and exchange.read_table(back, "edges").first().weight == 1.0 and exchange.read_table(back, "history").count() == 0
    bodies = ['{"name":"x","files":[],"symbols":[],"edges":[]}', "{", '{"name": 1}', "é" * (3 << 20) + "ab"]
    got = [r.v for r in spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", exchange.import_verdict(F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == ["ok", "invalid_json", "invalid_graph", "too_large"]
    (tmp_path / "t.jsonl").write_text('{"v":1,"tool":"a","ts":1,"latencyMs":2.5,"resultSize":3}\nnot json\n')
    assert exchange.read_telemetry(spark, f"file://{tmp_path}/t.jsonl").count() == 1


def test_bundle_of_several_documents(spark, tmp_path):
    """A table of more rows than a document holds is dealt out whole, beside one that fits and an empty one."""
    e = spark.range(1000).select("id", (F.col("id") % 7).alias("source_id"), F.lit(3).cast("long").alias("target_id"))
    tables = {"files": spark.range(3).select("id", F.lit("a.ts").alias("path")), "edges": e, "coupling": spark.range(0).select(F.col("id").alias("file_a_id"))}
    exchange.write_bundle(tables, ("r", "repo"), f"file://{tmp_path}/b", "2024-01-01T00:00:00Z", document_rows=100)
    back = exchange.read_bundle(spark, f"file://{tmp_path}/b")
    assert back.count() == 10 and {r.name for r in back.select("graph.repo.name").collect()} == {"repo"}
    assert sorted((r.id, r.source_id) for r in exchange.read_table(back, "edges").collect()) == [(i, i % 7) for i in range(1000)]
    assert sorted(r.id for r in exchange.read_table(back, "files").collect()) == [0, 1, 2] and exchange.read_table(back, "coupling").count() == 0


def test_commit_log(spark, tmp_path):
    (tmp_path / "log").write_text("\x01aaa\x021700000000\x02Ann\n\nsrc/a.ts\ndoc.md\n\x01bbb\x021700000100\x02Bob\n\nsrc/a.ts\n")
    rows = scan.commit_log(spark, f"file://{tmp_path}/log", "src/").collect()
    assert sorted((r.path, r.commit_id, r.author) for r in rows) == [("a.ts", "aaa", "Ann"), ("a.ts", "bbb", "Bob")]


def test_queue_rules():
    q = live.Queue()
    assert [q.put(i, i, "question" if i == 5 else "instruction") for i in range(21)] == [None] * 20 + [0]
    assert q.take(21, "question") == 5 and q.take(21) == 1 and q.take(603) == 3 and q.take(5000) is None


def test_queue_stream_delivers_once(spark, tmp_path):
    rows = [(1, 10.0, 1, "put", "question"), (1, 11.0, 2, "take", ""), (1, 12.0, 3, "take", ""), (2, 10.0, 4, "put", "instruction"), (2, 13.0, 5, "take_question", "")]
    df = spark.createDataFrame(rows, "key long, s double, event_id long, action string, kind string").select("key", F.timestamp_seconds("s").alias("ts"), "event_id", "action", "kind")
    df.write.parquet(f"file://{tmp_path}/in")
    want = sorted(((r.key, r.event_id, r.taken) for r in live.queue_results(df).collect()))
    assert want == [(1, 2, 1), (1, 3, None), (2, 5, None)]
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = live.queue_stream(stream).writeStream.format("memory").queryName("queue_out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(((r.key, r.event_id, r.taken) for r in spark.table("queue_out").collect())) == want


def test_telemetry_stream_and_watch(spark, tmp_path):
    df = spark.createDataFrame([(0.0, "a", 1.0), (10.0, "a", 3.0), (4000.0, "b", 2.0), (9000.0, "b", 2.0)], "s double, tool string, latency_ms double").select(F.timestamp_seconds("s").alias("ts"), "tool", "latency_ms")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = live.telemetry_hourly(stream, "1 minute").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.tool, r.calls, r.total_ms) for r in spark.table("hours").collect()) == [("a", 2, 4.0), ("b", 1, 2.0), ("b", 1, 2.0)]
    paths = spark.createDataFrame([("src/a.ts",), (".git/x",), ("src/a.ts",)], "path string")
    paths.coalesce(1).write.parquet(f"file://{tmp_path}/paths")
    seen = []
    w = live.watch(spark.readStream.schema("path string").parquet(f"file://{tmp_path}/paths"), lambda d, n: seen.append([r.path for r in d.collect()]), "50 milliseconds", f"file://{tmp_path}/wcp")
    w.processAllAvailable()
    w.stop()
    assert seen == [["src/a.ts"]]


def test_registry_works_without_the_optional_parts(tmp_path):
    """A copy without the corpus operators still imports and has its queries."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e, json; print(json.dumps([len(e.queries()), 'pipeline' in e.queries()]))"
    os.makedirs(tmp_path / "copy")
    subprocess.run(["cp", "-r", f"{top}/graphloom", f"{top}/__spark_entry__.py", str(tmp_path / "copy")], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "copy/graphloom/llm")], check=True)
    out = subprocess.run(["python", "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    n, piped = json.loads(out.stdout.strip().splitlines()[-1])
    assert n > 60 and not piped
