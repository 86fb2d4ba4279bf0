"""Hand-worked graphs, and what the oracle can't see."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import assemble, budget, churn, index_state, neighborhood, rank, retrieval, viewer, views
from graphloom.operators.model import Graph
from graphloom.operators.numbering import numbered


def files(spark, paths, loc=10):
    return spark.createDataFrame([(i, p, "typescript", loc, f"sha{i}") for i, p in enumerate(paths)], "id long, path string, language string, loc long, sha string")


def edges(spark, rows):
    return spark.createDataFrame([(*r, 1) if len(r) == 2 else r for r in rows], "src long, dst long, weight long")


@pytest.mark.parametrize("strategy", ["single_task", "distributed"])
def test_two_iterations_by_hand(spark, strategy):
    f, e = files(spark, "abc"), edges(spark, [(0, 1), (1, 2)])
    one = {r.id: r["rank"] for r in rank.centrality(f, e, iterations=1, strategy=strategy).collect()}
    lost = 0.85 / 3 / 3
    assert one[0] == pytest.approx(0.05 + lost) and one[1] == pytest.approx(0.05 + lost + 0.85 / 3)
    two = {r.id: r["rank"] for r in rank.centrality(f, e, iterations=2, strategy=strategy).collect()}
    assert two[2] == pytest.approx(0.05 + 0.85 * one[2] / 3 + 0.85 * one[1]) and sum(two.values()) == pytest.approx(1)


def test_strategies_agree(spark):
    rng = np.random.default_rng(1)
    f = files(spark, [f"p{i:03}" for i in range(60)])
    e = edges(spark, [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 40, 200), rng.integers(0, 60, 200), rng.integers(1, 9, 200), strict=True)])
    lean = f.where("id % 7 = 0").select("id", F.lit(2.0).alias("weight"))
    a = {r.id: r.score for r in rank.centrality(f, e, lean, 10, "single_task").collect()}
    b = {r.id: r.score for r in rank.centrality(f, e, lean, 10, "distributed").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert rank.centrality(f.limit(0), e.limit(0)).count() == 0


def test_rank_in_blocks_is_the_single_tasks(spark, monkeypatch):
    """Many blocks, some without nodes; ends that are no files; links of no weight; several writes on the way."""
    monkeypatch.setattr(rank, "BLOCK_LINKS", 40)
    monkeypatch.setattr(rank, "STEPS_A_JOB", 3)
    f = spark.range(60).select((F.col("id") * 11 - 50).alias("id"), F.col("id").cast("string").alias("path"))
    e = spark.range(900).select((F.col("id") * 7 % 60 * 11 - 50).alias("src"), (F.col("id") * 13 % 41 * 11 - 50).alias("dst"), (F.col("id") % 5).alias("weight")).where("src % 3 <> 0")
    lean = spark.createDataFrame([(-50, 2.0), (61, 1.0), (61, 3.0)], "id long, weight double")
    one = {r.id: r["rank"] for r in rank.centrality(f, e, lean, 8, "single_task").collect()}
    strangers = spark.createDataFrame([(999_983, -50, 5)], "src long, dst long, weight long")
    many = {r.id: r["rank"] for r in rank.centrality(f, e.unionByName(strangers), lean, 8, "distributed").collect()}
    assert len(many) == 60 and all(abs(one[k] - many[k]) < 1e-12 for k in one)


def test_diamond_is_mixed_on_its_ring(spark):
    e = edges(spark, [(0, 1), (2, 0), (1, 3), (3, 2)])
    found = {r.id: (r.ring, r.relation) for r in neighborhood.rings(e, files(spark, "abcd").where("id = 0").select("id"), 2).collect()}
    assert found == {0: (0, "center"), 1: (1, "dependency"), 2: (1, "dependent"), 3: (2, "mixed")}


@pytest.mark.parametrize("small", [{}, {"CHUNK_LINKS": 20, "KEPT_CHUNKS": 1, "GROUP": 5, "TASK_CENTRES": 7, "MOST_MET": 15, "MOST_HELD": 60, "TOLD_ROWS": 3}])
def test_far_rings_are_walked_without_moving_what_is_met(spark, monkeypatch, small):
    """As by joins, whatever the sizes: a hub with many chunks' links, loops, repeats, ids of any size, a centre without edges."""
    for name, value in small.items():
        monkeypatch.setattr(neighborhood, name, value)
    long = lambda n: F.when(n % 9 == 0, n - (1 << 62)).otherwise(n * 1_000_003)
    e = spark.range(300).select(long(F.col("id") * 7 % 90).alias("src"), long(F.col("id") * F.col("id") % 83).alias("dst"))
    e = e.unionByName(e.limit(40)).unionByName(spark.range(1, 60).select(long(F.col("id")).alias("src"), long(F.lit(0)).alias("dst")))
    centres = spark.range(0, 100, 3).select(long(F.col("id")).alias("id"))
    for edges_, depth in ((e, 3), (e, 4), (e.limit(0), 3)):
        walked = neighborhood.rings(edges_, centres, depth)
        # Only edges and centres move.
        assert "hashpartitioning(centre" not in walked._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in walked.select("centre", "id", "ring", "relation").collect())
        monkeypatch.setattr(neighborhood, "JOINED_RINGS", 9)
        assert got == sorted(tuple(r) for r in neighborhood.rings(edges_, centres, depth).select("centre", "id", "ring", "relation").collect())
        monkeypatch.setattr(neighborhood, "JOINED_RINGS", 2)


def test_enclosing_symbol_ties(spark):
    s = spark.createDataFrame([(0, 1, "a", 1, 10, True), (1, 1, "b", 2, 6, True), (2, 1, "c", 3, 7, True)], "id long, file_id long, name string, start_line int, end_line int, exported boolean")
    c = spark.createDataFrame([("x", 1, "f", 5), ("y", 1, "f", 9), ("z", 1, "f", 40)], "call_id string, file_id long, callee string, line int")
    assert {r.call_id: r.caller_id for r in assemble.enclosing(c, s).collect()} == {"x": 1, "y": 0}


def test_callees_prefer_the_file_then_exports_of_imports(spark):
    s = spark.createDataFrame([(0, 0, "f", True), (1, 1, "f", False), (2, 1, "g", False), (3, 2, "g", True), (4, 3, "h", True)], "id long, file_id long, name string, exported boolean")
    c = spark.createDataFrame([("1", 0, "f", 1), ("2", 0, "g", 1), ("3", 0, "h", 1)], "call_id string, file_id long, callee string, line int")
    found = {r.callee: (r.callee_id, r.via) for r in assemble.resolved_callees(c, s, edges(spark, [(0, 1), (0, 2)])).collect()}
    assert found == {"f": (0, "same_file"), "g": (3, "imported")}


def test_budget_edges(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, 1)], "n int, t int")
    kept = lambda limit, spent=0: [r.n for r in budget.within_budget(rows, [F.asc("n")], F.col("t"), limit, spent).orderBy("n").collect()]
    assert kept(3) == [1] and kept(10) == [1, 2] and kept(11) == [1, 2] and kept(19) == [1, 2, 3] and kept(4, 1) == []
    b = budget.Budget(3)
    assert b.fits("x" * 400) and b.spend("abcd") and b.spend("abcdefgh") and not b.spend("a")
    assert budget.tokens_of("") == 0 and budget.tokens_of("😀😀😀") == 2


def test_numbers_of_ranges_equal_one_window(spark, monkeypatch):
    df = spark.createDataFrame([(x * 7919 % 1000,) for x in range(1000)], "k int")
    monkeypatch.setattr("graphloom.operators.numbering.SMALL", 10)
    assert all(r.id == r.k + 5 for r in numbered(df, ["k"], start=5).collect())


def test_sticky_ids_and_collisions(spark):
    f = files(spark, ["c", "a", "b"]).drop("id")
    known = spark.createDataFrame([("b", 7)], "path string, id long")
    assert {r.path: r.id for r in assemble.file_ids(f, known).collect()} == {"b": 7, "a": 8, "c": 9}
    clash = spark.createDataFrame([("b", 7), ("x", 7)], "path string, id long")
    assert {r.path: r.id for r in assemble.file_ids(f, clash).collect()} == {"a": 0, "b": 1, "c": 2}


def small_graph(spark):
    f = files(spark, ["src/api.ts", "src/auth.ts", "src/types.ts", "README.md"])
    s = spark.createDataFrame(
        [(0, 0, "handler", "function", "export function handler()", 3, 9, True), (1, 1, "login", "function", "export function login()", 2, 5, True), (2, 2, "User", "interface", "export interface User", 1, 3, True), (3, 1, "hidden", "function", "", 7, 8, False)],
        "id long, file_id long, name string, kind string, signature string, start_line int, end_line int, exported boolean",
    )
    e = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 2, 1), (2, 1, 2, 1)], "id long, source_id long, target_id long, weight long")
    return Graph("demo", f, s, e, e.limit(0))


def test_views_render_and_repeat(spark):
    g = small_graph(spark)
    first, again = views.skeleton(g), views.skeleton(g)
    assert first == again and first.file_ids == [2, 1, 0]
    assert first.text == (
        "# demo — skeleton (4 files, 3 import edges)\n\nsrc/types.ts  (typescript, 10 loc)\n    export interface User  @src/types.ts:1\n\nsrc/auth.ts  (typescript, 10 loc)\n"
        "    export function login()  @src/auth.ts:2\n    hidden  @src/auth.ts:7\n\nsrc/api.ts  (typescript, 10 loc)\n    export function handler()  @src/api.ts:3"
        "\n\n… 1 lower-ranked file(s) omitted to fit 1500-token budget. Use find_symbol / get_neighborhood to drill in."
    )
    assert "complete inventory" in views.skeleton(g, inventory=True).text and views.skeleton(g, budget=20).file_ids == []
    hood = views.neighborhood(g, 1)
    assert hood.text.startswith("# neighborhood of src/auth.ts (depth 1, 3 files)") and "[CENTER] src/auth.ts" in hood.text and "[dependency] src/types.ts" in hood.text
    assert "(budget reached)" in views.neighborhood(g, 1, budget=35).text and views.neighborhood(g, 99).text == "Unknown file id 99."
    context = views.resolve_context(g, "add admin role check to login")
    assert context.file_ids[0] == 1 and "src/auth.ts" in context.text and "## Key neighborhoods" in context.text
    scores = rank.centrality(g.files, views.links(g))
    assert views.dependents_view(g, scores, "types.ts").text.startswith("src/types.ts is imported by 2 file(s):")
    assert views.dependents_view(g, scores, "User", "dependencies").text == "src/types.ts imports nothing (in-graph)."
    assert "Could not resolve" in views.dependents_view(g, scores, "nothing.ts").text
    assert views.languages_view(g.files).text.startswith("1 language(s) across 4 files, 40 loc:")
    sources = g.files.select(F.col("id").alias("file_id"), "path", F.lit("\n".join(f"line {i}" for i in range(1, 20))).alias("content"))
    found = views.find_symbol_view(g, scores, sources, name="login")
    assert found.text == "export function login()  @src/auth.ts:2-5\nline 2\nline 3\nline 4\nline 5" and found.file_ids == [1]
    assert retrieval.find_symbols(g.symbols, g.files, scores, pattern="(").count() == 0
    assert views.hotspot_view(g, scores, None).file_ids[0] == 2


def test_text_functions(spark):
    row = spark.range(1).select(
        T.normalized(F.lit("a/./b/../c")).alias("n"), T.normalized(F.lit("../x")).alias("up"), T.parent_dir(F.lit("a.ts")).alias("d"), T.breadcrumbs(F.lit("a/b/c")).alias("b"),
        T.signature(F.lit("function   f(a,\tb) {\n x")).alias("s"), T.low_byte_sha(F.lit("é")).alias("sha"), T.loc(F.lit("a\r\n\r\n  \n")).alias("loc"), T.loc_trimmed(F.lit("a\n  \n")).alias("trim"),
        T.estimate_tokens(F.lit("😀😀a")).alias("tok"), T.fnv1a(F.lit("src")).alias("fnv"), T.folder_hash(F.lit("components")).alias("fh"), T.palette_colour(["#000000", "#ffffff"], F.lit(0.5)).alias("c"),
        T.short_number(F.lit(1234)).alias("k"), T.slug(F.lit("My Repo!")).alias("slug"), T.label(F.lit("averyveryverylongfilename.tsx"), 12).alias("label"), T.keywords(F.lit("Add the Widget widget page")).alias("kw"),
    ).first()
    h = 0x811C9DC5
    for ch in b"src":
        h = (h ^ ch) * 0x01000193 % 2**32
    g = 0
    for ch in b"components":
        g = (g * 31 + ch + 2**31) % 2**32 - 2**31
    import hashlib

    assert (row.n, row.up, row.d, row.b) == ("a/c", "../x", ".", ["a", "a/b", "a/b/c"]) and row.s == "function f(a, b)" and row.sha == hashlib.sha1(b"\xe9").hexdigest()[:12]
    assert (row["loc"], row.trim, row.tok, row.fnv, row.fh, row.c, row.k, row.slug) == (2, 1, 2, h, abs(g), "#808080", "1.2K", "my-repo") and row.label == "averyve….tsx" and row.kw == ["widget"]


@pytest.mark.parametrize("block", [256, 7])
def test_coupling_counts_commits_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(churn, "FILES_A_BLOCK", block, raising=False)
    f = files(spark, [f"f{i}" for i in range(90)])
    of = {"all": range(90), "most": range(0, 90, 2), "pair": (3, 5), "one": (4,)}
    commits = spark.createDataFrame([(f"f{i}", c) for c, ids in of.items() for i in ids] + [("f3", "pair")], "path string, commit_id string")
    for least in (1, 2):
        found = churn.coupling(commits, f, least).collect()
        counts = {(a, b): sum(a in ids and b in ids for ids in of.values()) for a in range(90) for b in range(a + 1, 90)}
        expected = {(a, b, n) for (a, b), n in counts.items() if n >= least}
        assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_layout_is_bounded_and_repeats(spark):
    f = files(spark, [f"src/d{i % 3}/f{i}.ts" for i in range(30)])
    e = edges(spark, [(i, (i * 7 + 1) % 30) for i in range(30)])
    scores = rank.centrality(f, e)
    a = sorted(map(tuple, viewer.graph_layout(f, e, scores).collect()))
    assert a == sorted(map(tuple, viewer.graph_layout(f, e, scores).collect())) and len(a) == 30
    seeds = {r.id: (r.x, r.y) for r in viewer.layout_seed(f).collect()}
    assert all(max(abs(x - seeds[i][0]), abs(y - seeds[i][1])) <= 8 * 40 + 1 for i, x, y in a)


def test_treemap_fills_its_rectangle():
    boxes = viewer.squarified([6, 6, 4, 3, 2, 2, 1, 0], 0, 0, 6, 4)
    assert len(boxes) == 7 and sum(w * h for *_, w, h in boxes) == pytest.approx(24) and all(x >= 0 and y >= 0 and x + w <= 6 + 1e-9 and y + h <= 4 + 1e-9 for x, y, w, h in boxes)
    assert viewer.squarified([], 0, 0, 1, 1) == [] and viewer.legend_bands(10)[1] == ("3", 0.25)


def test_versions_switch_at_once(spark, tmp_path):
    store = index_state.Store(spark, f"file://{tmp_path}/index")
    assert store.load() is None
    g = small_graph(spark)
    assert store.save(g) == 1 and store.save(g) == 2 and store.load().files.count() == 4
    scanned = g.files.where("id <> 3").unionByName(files(spark, ["new.ts"]).withColumn("sha", F.lit("n"))).drop("id")
    ids, changed = index_state.reindexed_files(store, scanned)
    assert {r.path: r.id for r in ids.collect()}["new.ts"] == 4
    assert {(r.path, r.change) for r in changed.collect()} == {("README.md", "removed"), ("new.ts", "added")}


def test_enclosing_passes_over_each_row_once(spark):
    """Calls and symbols aren't multiplied: the plan has no generator and one exchange; batches may end anywhere."""
    c = spark.range(300).select(F.concat(F.lit("c"), "id").alias("call_id"), (F.col("id") % 3).alias("file_id"), (F.col("id") % 50).cast("int").alias("line"))
    s = spark.range(90).select("id", (F.col("id") % 2).alias("file_id"), (F.col("id") % 40).cast("int").alias("start_line"), (F.col("id") % 40 + F.col("id") % 7).cast("int").alias("end_line"))
    found = assemble.enclosing(c, s)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    inside = s.join(c, "file_id").where("start_line <= line and line <= end_line").groupBy("call_id").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "start_line", "id")).alias("b"))
    assert {(r.call_id, r.caller_id) for r in found.collect()} == {(r.call_id, r.b.id) for r in inside.collect()}


def test_a_large_table_is_numbered_with_one_write(spark, monkeypatch):
    from graphloom.operators import numbering

    written, names = numbering.written, []
    monkeypatch.setattr(numbering, "SMALL", 10)
    monkeypatch.setattr(numbering, "written", lambda df, name: names.append(name) or written(df, name))
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("x")).repartition(5)
    rows = numbered(df, ["k"], "no", start=5).collect()
    assert sorted(r.no for r in rows) == list(range(5, 1005)) and all(r.no == r.k + 5 for r in rows)
    assert names == ["numbered"]


@pytest.mark.parametrize("name", ["dependents", "dependents_budgeted", "dependents_view", "find_symbol_view"])
def test_queries_that_rank_make_edges_once(spark, monkeypatch, name):
    from graphloom.plans import catalog, shown  # noqa: F401  the second registers views
    from graphloom.plans import views as V

    made, make = [], V.rank_edges
    monkeypatch.setattr(V, "rank_edges", lambda *a: made.append(a) or make(*a))
    monkeypatch.setattr(rank, "centrality", lambda files, edges, *a, **k: files.select("id", F.lit(1.0).alias("rank"), F.lit(1.0).alias("score")))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_layout_in_blocks_is_the_single_tasks(spark, monkeypatch):
    """Over twice so many links as files, ends that are no files, blocks without any; several writes on the way."""
    f = files(spark, [f"src/d{i % 3}/f{i}.ts" for i in range(30)])
    e = edges(spark, [(i % 30, (i * 7 + 1) % 30) for i in range(70)] + [(3, 999), (999, 4)])
    scores = f.select("id", (F.col("id") / 30).alias("score"))
    one = sorted(map(tuple, viewer.graph_layout(f, e, scores, iterations=5).collect()))
    for name, value in {"SMALL_LAYOUT": 9, "LAYOUT_FILES": 2, "STEPS_A_WRITE": 2, "BODIES_AT_ONCE": 3}.items():
        monkeypatch.setattr(viewer, name, value)
    monkeypatch.setattr(viewer, "refine", None)  # no task has all files
    many = sorted(map(tuple, viewer.graph_layout(f, e, scores, iterations=5).collect()))
    assert [r[0] for r in many] == [r[0] for r in one] and all(abs(a - b) <= 1 for r, s in zip(one, many, strict=True) for a, b in zip(r, s, strict=True))


def test_symbols_are_matched_with_a_task_once(spark):
    f, e = files(spark, ["src/login.ts", "src/other.ts", "lib/role.ts"]), edges(spark, [(0, 1), (1, 2)])
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    symbols = spark.createDataFrame([(i, i % 3, f"role_{i}") for i in range(10)], "id long, file_id long, name string").mapInArrow(counted, "id long, file_id long, name string")
    found = [r.path for r in rank.rank_for_task(f, symbols, e, "check the login role").orderBy("rnk").collect()]
    assert found[0] == "lib/role.ts" or found[0] == "src/login.ts"
    assert passed.value == 10


def test_ids_in_few_files_are_those_among_all(spark):
    """Found by counting the symbols of files before; nulls stand first."""
    rows = [(None if i % 11 == 0 else i * 7 % 13, i * 5 % 4, i) for i in range(200)]
    s = spark.createDataFrame(rows, "file_id long, start_line int, pos long")
    want = {(r.file_id, r.start_line, r.pos): r.id for r in assemble.symbol_ids(s).collect() if r.file_id in (0, 5, 12)}
    got = {(r.file_id, r.start_line, r.pos): r.id for r in assemble.ids_in_files(s, [12, 0, 5, 5, 99]).collect()}
    assert got == want and assemble.ids_in_files(s, []).count() == 0


@pytest.mark.parametrize("name", ["dependents_view", "find_symbol_view", "find_symbols_exact"])
def test_views_of_imports_make_no_call_edges_and_number_few_symbols(spark, monkeypatch, name):
    from graphloom.plans import catalog

    want = [tuple(r) for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()]
    refuse = lambda *_: pytest.fail("made for nothing")
    monkeypatch.setattr(assemble, "call_edges", refuse)
    monkeypatch.setattr(assemble, "symbol_ids", refuse)
    assert [tuple(r) for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()] == want


def test_atlas_links_of_the_query_are_not_looked_up_among_nodes(spark):
    """All ends come from the symbols and edges themselves; a file that ``part`` lacks is linked too, as in the SQL."""
    from graphloom.plans import catalog

    plan = catalog.QUERIES["atlas_links"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
    s = spark.createDataFrame([(0, 7), (1, 8)], "id long, file_id long")
    found = viewer.atlas_links(None, s, edges(spark, [(7, 8)]), edges(spark, [(1, 0)]))
    assert sorted(map(tuple, found.collect())) == [("f7", "f8", "imports"), ("f7", "s0", "defines"), ("f8", "s1", "defines"), ("s1", "s0", "calls")]


def test_callees_whose_hashes_are_equal_are_told_apart(spark):
    """Among 3,000 names many have equal hashes of sixteen bits; file 1 has the odd ones, and file 0 calls all."""
    names = [f"name_{i}" for i in range(3000)]
    c = spark.createDataFrame([(0, n, 1) for n in names], "file_id long, callee string, line int")
    s = spark.createDataFrame([(i, 1 if i % 2 else 2, n, True) for i, n in enumerate(names)], "id long, file_id long, name string, exported boolean")
    short = spark.createDataFrame([(n,) for n in names], "n string").select(F.hash("n").bitwiseAND(F.lit(0xFFFF)).alias("h"))
    assert short.distinct().count() < len(names)
    found = {r.callee: r.callee_id for r in assemble.resolved_callees(c, s, edges(spark, [(0, 1)])).collect()}
    assert found == {n: i for i, n in enumerate(names) if i % 2}


def test_numbered_rows_leave_out_what_only_orders(spark, monkeypatch):
    from graphloom.operators import numbering

    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k"), (F.col("id") * 37 % 100).alias("x"))
    for small in (10, 1000):
        monkeypatch.setattr(numbering, "SMALL", small)
        rows = numbered(df, ["k"], "no", drop=("k",)).collect()
        assert [set(r.asDict()) for r in rows] == [{"x", "no"}] * 100 and all(r.no == r.x for r in rows)


@pytest.mark.parametrize("hidden_types", [[], ["class"], ["file"], ["function", "class"]])
def test_visible_links_are_those_between_shown_nodes(spark, hidden_types):
    f = files(spark, ["a.ts", "b.ts"])
    s = spark.createDataFrame([(i, i % 2, f"n{i}", "class" if i % 3 else "function") for i in range(8)], "id long, file_id long, name string, kind string")
    imports, calls = edges(spark, [(0, 1)]), edges(spark, [(i, i * 3 % 8) for i in range(1, 8) if i != 4])
    nodes = viewer.atlas_nodes(f, s, f.select("id", F.lit(0).alias("x"), F.lit(0).alias("y")))
    want = viewer.visible(nodes, viewer.atlas_links(f, s, imports, calls), hidden_types, ["imports"])[1]
    marked = viewer.marked(s, hidden_types)
    twice = marked.select("id", F.shiftright("id", 1).alias("plain"))
    of_marked = calls.join(twice.select(F.col("plain").alias("src"), F.col("id").alias("s")), "src").join(twice.select(F.col("plain").alias("dst"), F.col("id").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    got = viewer.visible_links(marked, imports, of_marked, hidden_types, ["imports"])
    assert sorted((r.source, r.target, r.kind) for r in got.collect()) == sorted((r.source, r.target, r.kind) for r in want.collect())


def test_files_of_finished_shuffles_go_with_the_next_write(spark):
    import glob
    import time

    from graphloom.plans.shared_folder import written

    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    n_files = lambda: sum(len(glob.glob(f"{d}/*/shuffle_*.data")) for d in folders)
    written(spark.range(10), "first")
    time.sleep(2)
    before = n_files()
    for _ in range(3):
        written(spark.range(1000).repartition(5, "id"), "moved")
    # Those of the last write may wait for another; Spark removes files beside its work.
    for _ in range(10):
        written(spark.range(10), "next")
        time.sleep(0.5)
        if n_files() <= before:
            break
    assert n_files() <= before
