"""Rules as one automaton against one pattern after the other; listing by level against a walk."""

from __future__ import annotations

import hashlib
import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import views
from graphloom.sources import exchange, scan
from graphloom.sources.rules import RuleSet

LINES = st.lists(st.text(alphabet="ab./*?! ", max_size=6), max_size=8)
PATHS = st.lists(st.text(alphabet="ab.", min_size=1, max_size=4), min_size=1, max_size=4).map("/".join)


@given(LINES, LINES, st.sampled_from(["a", "b/a", "a.b"]), st.lists(PATHS, min_size=1, max_size=12))
@settings(max_examples=400, deadline=None)
def test_the_automaton_equals_the_patterns(lines, below, folder, paths):
    chain = scan.compile_rules(lines) + scan.compile_rules(below, folder)
    rules = RuleSet([(line, "") for line in lines] + [(line, folder) for line in below])
    for path in [*paths, *[f"{folder}/{p}" for p in paths], folder]:
        assert rules.excludes(path) == scan.is_excluded(path, chain), path


def test_time_does_not_grow_with_the_rules():
    paths = [f"src/folder{i % 50}/deep{i % 7}/file{i}.py" for i in range(4000)]
    took = []
    for n in (20, 2000):
        rules = RuleSet([(f"name{i}/", "") for i in range(n)] + [("file1*.py", ""), ("!file12.py", "")])
        rules.excludes(paths[0])
        best = []
        for _ in range(3):
            began = time.process_time()
            found = [rules.excludes(p) for p in paths]
            best.append(time.process_time() - began)
        took.append(min(best))
        assert found[1] and not found[12] and not found[2]
    assert took[1] < 4 * took[0] + 0.05


def test_few_sets_of_states_are_remembered(monkeypatch):
    from graphloom.sources import rules as module

    monkeypatch.setattr(module, "MOST_STATES", 10)
    rules = RuleSet([("*a*b*", ""), ("!b", "")])
    assert [rules.excludes(p) for p in ("xaxbx", "c/b", "aab/c", "ba")] == [True, False, True, False]


def walked(root, extra):
    """One folder after the other, with one pattern after the other."""
    def own(folder):
        return scan._lines(os.path.join(root, folder, ".gitignore")) + scan.config_excludes(root, folder)

    found, waiting = [], [("", scan.compile_rules([*scan.ALWAYS_IGNORED, *own(""), *extra]))]
    while waiting:
        folder, rules = waiting.pop()
        rules = rules + scan.compile_rules(own(folder), folder) if folder else rules
        for name in os.listdir(os.path.join(root, folder)):
            path = f"{folder}/{name}" if folder else name
            if not scan.is_excluded(path, rules):
                if os.path.isdir(os.path.join(root, path)):
                    waiting.append((path, rules))
                else:
                    found.append(path)
    return sorted(found)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    texts = {
        ".gitignore": "*.log\n/only-root\n!keep.log\nsub/*.tmp\n", "a.log": "", "keep.log": "x", "only-root": "x", "b/only-root": "x", "b/.gitignore": "!a.log\nc/\n*.md\n", "b/a.log": "x", "b/c/d.py": "x", "b/e.md": "x",
        "sub/x.tmp": "x", "sub/deep/x.tmp": "x", "node_modules/p/i.js": "x", "web/tsconfig.json": '{"exclude": ["gen", "/out2"], // c\n}', "web/gen/x.ts": "x", "web/deep/gen/y.ts": "x", "web/out2/z.ts": "x", "web/ok.ts": "x" * 3000, ".hidden/_x.py": "x",
        "d1/d2/d3/d4/d5/f.py": "x",
    }
    for path, text in texts.items():
        place = root / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(text)
    (root / "empty").mkdir()
    return root


def test_listing_by_level_equals_a_walk(spark, tree):
    for extra in ([], ["d3/", "!*.log"]):
        found = scan.listed(spark, str(tree), extra).collect()
        assert sorted(r.path for r in found) == walked(str(tree), extra)
    sizes = {r.path: r.size for r in found}
    assert sizes["web/ok.ts"] == 3000 and all(r.last_modified_ms > 0 for r in found)


def test_sizes_and_suffixes_are_filtered_where_files_are_listed(spark, tree):
    assert {r.path for r in scan.listed(spark, str(tree), most_bytes=2000, suffixes=["ts", "py"]).collect()} == {"web/deep/gen/y.ts", ".hidden/_x.py", "d1/d2/d3/d4/d5/f.py"} | (
        {"web/gen/x.ts"} & set(walked(str(tree), []))
    )


def test_large_files_are_not_read(spark, tree):
    assert "web/ok.ts" not in {r.path for r in scan.scan_repo(spark, str(tree), most_bytes=2000).collect()}


def test_slices_are_cut_by_line_breaks(spark):
    texts = ["", "one", "a\nb\nc", "a\r\nb\r\nc\r\n", "é\n漢字\n😀\n", "\n\n\n", "x\ry\nz\r", "l\n" * 50]
    sources = spark.createDataFrame([(i, f"f{i}", hashlib.sha1(t.encode()).hexdigest(), t) for i, t in enumerate(texts)], "file_id long, path string, sha string, content string")
    spans = [(a, b) for a in (-1, 0, 1, 2, 3, 4, 9) for b in (0, 1, 2, 3, 4, 60)]
    symbols = spark.createDataFrame([(i * 100 + k, i, a, b) for i in range(len(texts)) for k, (a, b) in enumerate(spans)], "id long, file_id long, start_line int, end_line int")
    kept = views.line_breaks(sources)
    assert kept.columns == ["sha", "breaks"] and kept.count() == len(texts)
    for breaks in (None, kept):
        found = {r.id: r for r in views.sliced(symbols, sources, 10, 2, breaks).collect()}
        for i, text in enumerate(texts):
            lines = text.replace("\r\n", "\n").split("\n") if "\r\n" in text else text.split("\n")
            for k, (a, b) in enumerate(spans):
                body = lines[max(1, a) - 1 : min(len(lines), b)] if min(len(lines), b) >= max(1, a) else []
                full, r = "\n".join(body), found[i * 100 + k]
                long = -(-(len(full.encode("utf-16-le")) // 2) // 4) > 10
                assert r.anchor == f"f{i}:{a}-{b}" and r.elided == long
                assert r.source == ("\n".join(body[:2]) + f"\n  … {len(body) - 2} more line(s) — read {r.anchor}" if long else full), (text, a, b)


def test_record_hashes(spark):
    rows = [("tool", 250, 10), ("t", 99, 0), ("é", 100, 7)]
    df = spark.createDataFrame(rows, "tool string, ms long, size long").select(exchange.record_hash(F.col("tool"), F.col("ms"), F.col("size")).alias("h"), "tool")
    assert {r.tool: r.h for r in df.collect()} == {t: hashlib.sha512(f"{t}{ms % 100}{n}".encode()).hexdigest() for t, ms, n in rows}


def test_large_bundles_are_refused_before_they_are_gathered(spark, tmp_path):
    with pytest.raises(ValueError, match="files has more than 5 rows"):
        exchange.write_bundle({"files": spark.range(6)}, ("r", "n"), f"file://{tmp_path}/b", "2024-01-01T00:00:00Z", most_rows=5)


def test_rows_in_memory_count_lines_that_have_more_than_blanks(spark):
    assert [r.loc for r in scan.from_rows(spark, [("a.py", "x\n  \n\t\ny\n")]).collect()] == [2]
