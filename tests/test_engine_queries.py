"""Queries of the graph engine against their oracles, and operators against brute force."""

from __future__ import annotations

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.operators import assemble, rank
from graphloom.plans import catalog, scalars, scanning, shown, streamed
from graphloom.plans import views as V
from graphloom.sources import build, scan

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Two symbols of the smallest tables tie in everything that orders them.
TIED = {"symbol_slices", "atlas_orbits", "atlas_visible"}
MODULES = {m.__name__ for m in (scalars, scanning, shown, streamed)}
NAMES = sorted(n for n in catalog.ORACLES if catalog.QUERIES[n].__module__ in MODULES)


def duck(folder):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else float(value) if value.__class__.__name__ == "Decimal" else value


@pytest.mark.parametrize("name", [*NAMES, "pagerank_plain", "pagerank_personalized", "neighborhood_depth2", "dependents", "resolve_file_target", "coupling", "call_edges", "dependents_budgeted"])
def test_query_equals_oracle(spark, name):
    folder = LARGER if name in TIED else SMALL
    found = duck(folder).sql(catalog.ORACLES[name])
    rows = catalog.QUERIES[name](spark, folder)
    assert sorted(rows.columns) == sorted(found.columns)
    got = sorted(repr([plain(r[c]) for c in found.columns]) for r in rows.collect())
    assert got == sorted(repr([plain(x) for x in r]) for r in found.fetchall())


@pytest.mark.parametrize("strategy", ["single_task", "distributed"])
def test_ranks_of_a_sparse_graph_with_leaves(spark, strategy):
    """Few edges, mixed slowly, and files without any tell a wrong rank from a right one."""
    f = V.files(spark, SMALL)
    kept = V._consecutive(spark, SMALL).where("src % 2 <> dst % 2 and l_orderkey % 8 = 0")
    edges = kept.groupBy("src", "dst").agg(F.sum("l_linenumber").cast("long").alias("weight"))
    lean = f.where("id % 7 = 0").select("id", F.lit(1.0).alias("weight"))
    sparse = V.NEXT + ", edges AS (SELECT src, dst, sum(l_linenumber)::BIGINT AS weight FROM nexts WHERE src % 2 <> dst % 2 AND l_orderkey % 8 = 0 GROUP BY src, dst)"
    sql = "WITH RECURSIVE " + ",\n".join([V.FILES, sparse, V.pagerank_sql("CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END")]) + " SELECT id, score FROM ranks"
    want = dict(duck(SMALL).sql(sql).fetchall())
    got = {r.id: r.score for r in rank.centrality(f, edges, lean, strategy=strategy).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert len({r.src for r in edges.collect()}) < f.count()


def test_enclosing_equals_all_pairs(spark):
    rng = random.Random(1)
    symbols = [(i, rng.randrange(3), s, s + rng.choice([0, 0, 1, 3, 7, 8, 200, 5000, -1])) for i in range(300) for s in [rng.randrange(1, 6000)]]
    calls = [(f"c{k}", rng.randrange(3), rng.randrange(0, 7000)) for k in range(500)]
    found = assemble.enclosing(spark.createDataFrame(calls, "call_id string, file_id long, line int"), spark.createDataFrame(symbols, "id long, file_id long, start_line int, end_line int"))
    want = {}
    for call, file, line in calls:
        around = [(e - s, s, i) for i, f, s, e in symbols if f == file and s <= line <= e]
        if around:
            want[call] = min(around)[2]
    assert {r.call_id: r.caller_id for r in found.collect()} == want and want


@pytest.mark.parametrize("fold,suffix", [(False, None), (True, None), (True, ".go")])
def test_containing_equals_all_pairs(spark, fold, suffix):
    rng = random.Random(2)
    paths = sorted({"/".join("".join(rng.choice("aAbB.") for _ in range(rng.randrange(1, 5))) for _ in range(3)) + rng.choice([".go", ".ml"]) for _ in range(60)})
    needles = ["", "a", "A", "b/", "Ab", "aab", "abAb", "bbabA", "/a/b", "zzz", paths[3], paths[7][2:9]]
    files = spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    found = assemble.containing(spark.createDataFrame([(n,) for n in needles] + [(None,)], "needle string"), files, ["needle"], suffix, fold)
    same = (lambda x: x.lower()) if fold else (lambda x: x)
    want = {n: next((i for i, p in enumerate(paths) if same(n) in same(p) and p.endswith(suffix or "")), None) for n in needles}
    assert {r.needle: r.target_id for r in found.collect()} == {n: i for n, i in want.items() if i is not None}


def test_common_runs_are_avoided_and_dealt_out(spark, monkeypatch):
    """Half of all paths share a folder, whose name is the first run of every needle."""
    monkeypatch.setattr(assemble, "COMMON_RUN", 7)
    paths = sorted([f"common/name{i:03d}.go" for i in range(150)] + [f"other/{i}/common" for i in range(150)])
    needles = ["common/name07", "common/name149.go", "common/none", "common", "ommon/name", "other/77/common"]
    files = spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    found = assemble.containing(spark.createDataFrame([(n, k) for n in needles for k in range(2)], "needle string, k int"), files, ["needle", "k"])
    want = {n: next((i for i, p in enumerate(paths) if n in p), None) for n in needles}
    assert {(r.needle, r.k): r.target_id for r in found.collect()} == {(n, k): i for n, i in want.items() if i is not None for k in range(2)}


def test_a_request_is_given_once_and_a_target_may_be_a_name(spark):
    from graphloom.operators import views
    from graphloom.streaming.live import Queue

    graph = catalog._graph(spark, SMALL)
    queue, asked = Queue(), {1: {"instruction": "look", "paths": ["nowhere.ts"]}, 2: {"instruction": "why", "kind": "question"}}
    queue.put(0.0, 1, "instruction")
    queue.put(1.0, 2, "question")
    first, second, none = (views.next_request(graph, queue, asked, 2.0) for _ in range(3))
    assert "instruction 1" in first.text and "question 2" in second.text and none.text == "No pending viewer request." and not asked
    assert views.neighborhood_of(graph, "no such name").text.startswith('Could not resolve "no such name"')


def test_imports_of_more_languages_resolve(spark):
    files = [
        (0, "Sources/Net/Http.swift", "swift"), (1, "lib/parser.ml", "ocaml"), (2, "src/Data/List.elm", "elm"), (3, "DATA/tree.elm", "elm"), (4, "Net/readme.md", "markdown"), (5, "app/main.ts", "typescript"),
        (6, "web/src/ui/Button.tsx", "typescript"), (7, "web/page.ts", "typescript"), (8, "api/src/ui/Button.ts", "typescript"), (9, "other/MyParserTools.ml", "ocaml"),
    ]
    imports = [(0, "Net"), (0, "Foundation"), (1, "Parser"), (9, "Nothing"), (3, "Data.Tree"), (2, "Data.List"), (7, "@/ui/Button"), (5, "@/ui/Button")]
    found = build.resolve(
        spark.createDataFrame(files, "id long, path string, language string"),
        spark.createDataFrame(imports, "file_id long, specifier string"),
        {"web": [("@/", "", ["web/src/*"])], "": [("@/", "", ["api/src/*"])]},
    )
    got = {(r.file_id, r.specifier): r.target_id for r in found.collect()}
    assert got == {(0, "Net"): 0, (1, "Parser"): 1, (3, "Data.Tree"): 3, (7, "@/ui/Button"): 6, (5, "@/ui/Button"): 8}


def test_configs_among_the_files_give_aliases(spark):
    rows = [("tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}'), ("web/tsconfig.json", '// c\n{"compilerOptions": {"baseUrl": "./app", "paths": {"~/*": ["lib/*"],},},}'), ("bad/jsconfig.json", "{"), ("x/tsconfig.json", "{}")]
    assert build.aliases_of(spark.createDataFrame(rows, "path string, content string")) == {"": [("@/", "", ["src/*"])], "web": [("~/", "", ["web/app/lib/*"])]}


@pytest.mark.parametrize("text,want", [('{"a": [1, 2,], /* x */ "b": "// no, }", }', {"a": [1, 2], "b": "// no, }"}), ('// h\n{"u": "http://x/y", "c": ",]" ,\n}\n', {"u": "http://x/y", "c": ",]"}), ("[1 , ]", [1])])
def test_json_with_comments(text, want):
    assert scan.parse_jsonc(text) == want


def test_json_with_comments_takes_linear_time():
    assert len(scan.parse_jsonc("[" + "1, " * 200_000 + "]")) == 200_000


def test_hosted_repositories_have_a_limit(spark):
    tree = spark.createDataFrame([(f"src/{i}.ts", "blob", 100) for i in range(20)], "path string, kind string, size long")
    assert scan.checked_size(scan.hosted(tree)).count() == 20
    for limits in ((19, 10**9), (100, 1999)):
        with pytest.raises(ValueError):
            scan.checked_size(tree, *limits)


def test_requests_stage_their_files(spark):
    from graphloom.operators import views as rendered

    graph = catalog._graph(spark, SMALL)
    path = V.files(spark, SMALL).where("id = 3").first().path
    view = rendered.request_view(graph, "q7", "what is this", ["no/such/file.ts", path, path], "question")
    assert view.file_ids[0] == 3 and len(view.file_ids) == len(set(view.file_ids)) and f"@no/such/file.ts @{path}" in view.text and "submit_answer" in view.text
    assert rendered.request_view(graph, "q8", "red widget", []).text.startswith("# instruction q8")


@pytest.mark.parametrize("colliding", [False, True])
def test_callees_equal_all_pairs(spark, monkeypatch, colliding):
    """Names that no symbol has don't move; names of one hash stay apart."""
    if colliding:
        monkeypatch.setattr(assemble.F, "hash", F.length)
    packed = []
    monkeypatch.setattr(assemble, "written", lambda df, name: packed.append(df) or df, raising=False)
    rng = random.Random(5)
    symbols = [(i, rng.randrange(12), f"n{rng.randrange(25)}", rng.random() < 0.5) for i in range(90)]
    calls = [(rng.randrange(12), f"n{rng.randrange(40)}") for _ in range(300)] + [(3, None), (99, "n1")]
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(40)] + [(99, 1), (99, 2), (99, 2)]
    found = assemble.resolved_callees(spark.createDataFrame(calls, "file_id long, callee string"), spark.createDataFrame(symbols, "id long, file_id long, name string, exported boolean"), spark.createDataFrame(edges, "src long, dst long"))
    want = {}
    for file, name in set(calls):
        own = [i for i, f, n, _ in symbols if (f, n) == (file, name)]
        far = [(not x, i) for i, f, n, x in symbols if n == name and (file, f) in edges]
        if own or far:
            want[file, name] = (min(own), "same_file") if own else (min(far)[1], "imported")
    assert {(r.file_id, r.callee): (r.callee_id, r.via) for r in found.collect()} == want and {v for _, v in want.values()} == {"same_file", "imported"}
    held = {n for _, _, n, _ in symbols}
    assert packed and {r.n for r in packed[0].select(F.explode("sought").alias("n")).collect()} <= held < {n for _, n in calls if n} | held


def test_calls_are_linked_once_before_they_are_numbered(spark, monkeypatch):
    made = []
    monkeypatch.setattr(shown, "written", lambda df, name: made.append((name, df)) or catalog.written(df, name), raising=False)
    rows = catalog.QUERIES["edges_of_both_kinds"](spark, SMALL).collect()
    assert [name for name, _ in made] == ["edges", "call-edges"]
    assert sum(r.kind == "calls" for r in rows) == made[1][1].count() > 0


def test_lines_are_made_for_the_files_that_can_show(spark, monkeypatch):
    from graphloom.operators import views

    surfaces, seen = views.surfaces, []
    monkeypatch.setattr(views, "surfaces", lambda graph, most: seen.append(graph.files.count()) or surfaces(graph, most))
    g = catalog._graph(spark, SMALL)
    ranking = g.files.selectExpr("id", "path", "cast(id as double) as score", "id as rnk")
    rows = views._prefix(ranking, g, 2, 7, needs_symbols=True)
    assert seen == [7] and [r.id for r in rows] == sorted(r.id for r in rows) and len(rows) == 7 and all(1 <= len(r.lines) <= 2 and r.n_symbols >= len(r.lines) for r in rows)
