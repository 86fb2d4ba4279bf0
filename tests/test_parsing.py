"""Structure in sources of several languages, and bounded time."""

from __future__ import annotations

import time

import pytest

from graphloom.sources import parse


def found(language, text):
    r = parse.parse_text(language, text)
    assert r["failed"] is None
    return {(s["kind"], s["name"], s["start_line"], s["end_line"], s["exported"]) for s in r["symbols"]}, r["imports"], [(c["callee"], c["line"]) for c in r["calls"]]


def test_typescript_nests():
    text = """import { x } from './a'
export class K extends Base {
  run(
    a = "}) {", b = '({' // }
  ): Promise<void> { return call(a) }
  m() { if (this.x) { call2<T>({ k: `}` }) } }
}
export const arrow = (a: number) => {
  return inner(a)
}
const obj = { a: 1,
  b: 2 }
function* outer(): void {
  function nested() { deep() }
}
export interface I { a: string }
export type T1 = { a: string } | undefined
export enum E { A }
let re = /["'({]/.test(s)
export abstract class Q {}
"""
    symbols, imports, calls = found("typescript", text)
    assert symbols == {
        ("class", "K", 2, 7, True), ("const", "arrow", 8, 10, True), ("const", "obj", 11, 12, False), ("function", "outer", 13, 15, False), ("interface", "I", 16, 16, True),
        ("type", "T1", 17, 17, True), ("type", "E", 18, 18, True), ("const", "re", 19, 19, False), ("class", "Q", 20, 20, True),
    }
    assert imports == ["./a"] and calls == [("call", 5), ("call2", 6), ("inner", 9), ("deep", 14), ("test", 19)]


#: By language: a source, and its symbols as (kind, name, first and last line).
KINDS = {
    "javascript": ("export default class A {}\nasync function f() {}\nvar x = 1\nlet y = 2\n", {("class", "A", 1, 1), ("function", "f", 2, 2), ("const", "x", 3, 3), ("const", "y", 4, 4)}),
    "go": ("type T struct {\n  a int\n}\nfunc (t *T) M(\n  a int) {\n}\nfunc f() {}\n", {("type", "T", 1, 3), ("function", "M", 4, 6), ("function", "f", 7, 7)}),
    "rust": ("pub fn f<'a>(x: &'a str) {\n}\nstruct S { a: i32 }\nenum E { A }\npub trait T { fn m(&self); }\nconst C: i32 = 5;\n", {("function", "f", 1, 2), ("class", "S", 3, 3), ("type", "E", 4, 4), ("interface", "T", 5, 5), ("const", "C", 6, 6)}),
    "java": ("class A {\n  A(int x) { this.x = x; }\n  int m() { return n(); }\n}\ninterface I {\n  void q();\n}\nenum E { P }\n", {("class", "A", 1, 4), ("function", "m", 3, 3), ("interface", "I", 5, 7), ("function", "q", 6, 6), ("type", "E", 8, 8)}),
    "c": ("struct s { int a; };\nunion u { int a; };\nenum e { A };\ntypedef int t_t;\nstatic const int limit = 5;\nint run(int a,\n  char *b)\n{\n  x = '{';\n}\nint declared(int);\n", {("class", "s", 1, 1), ("type", "u", 2, 2), ("type", "e", 3, 3), ("type", "t_t", 4, 4), ("const", "limit", 5, 5), ("function", "run", 6, 10)}),
    "cpp": ("template <typename T>\nclass X : public Y {\n  int run() const { return f(1'000, '}'); }\n};\nstruct S { };\nenum class E { A };\nunion U { };\n", {("class", "X", 2, 4), ("function", "run", 3, 3), ("class", "S", 5, 5), ("type", "E", 6, 6), ("type", "U", 7, 7)}),
    "csharp": ("struct S { }\ninterface I { void M(); }\nenum E { A }\ndelegate int D(int x);\nclass A {\n  public int P { get; set; }\n  int F(int x) => G(x);\n}\n", {("class", "S", 1, 1), ("interface", "I", 2, 2), ("function", "M", 2, 2), ("type", "E", 3, 3), ("function", "D", 4, 4), ("class", "A", 5, 8), ("const", "P", 6, 6), ("function", "F", 7, 7)}),
    "kotlin": ("object O { }\nclass C(val x: Int) {\n  fun f() = g()\n}\ntypealias T = Int\nval p = 1\n", {("class", "O", 1, 1), ("class", "C", 2, 4), ("function", "f", 3, 3), ("type", "T", 5, 5), ("const", "p", 6, 6)}),
    "ruby": ("module M\n  class A\n    def self.f(a = 'end')\n    end\n    def g?\n    end\n  end\nend\n", {("class", "M", 1, 8), ("class", "A", 2, 7), ("function", "f", 3, 4), ("function", "g?", 5, 6)}),
    "php": ("<?php\ntrait T { }\ninterface I { }\nenum E { }\nconst X = 1;\nclass A { public function f() { } }\nfunction g() { }\n", {("class", "T", 2, 2), ("interface", "I", 3, 3), ("type", "E", 4, 4), ("const", "X", 5, 5), ("class", "A", 6, 6), ("function", "f", 6, 6), ("function", "g", 7, 7)}),
    "swift": ("protocol P { }\nstruct S { }\nclass C {\n  func f() { }\n}\n", {("interface", "P", 1, 1), ("class", "S", 2, 2), ("class", "C", 3, 5), ("function", "f", 4, 4)}),
    "scala": ("trait T { }\nobject O {\n  def f(x: Int) = g(x)\n}\nclass C { }\n", {("interface", "T", 1, 1), ("class", "O", 2, 4), ("function", "f", 3, 3), ("class", "C", 5, 5)}),
    "zig": ("pub fn f(a: u8) void {\n}\nconst x = 1;\nvar y = 2;\n", {("function", "f", 1, 2), ("const", "x", 3, 3), ("const", "y", 4, 4)}),
    "lua": ("--[[ function no() ]]\nfunction a.b(x)\n  local s = [[ function ]]\nend\n", {("function", "a.b", 2, 4)}),
    "r": ("f <- function(x) {\n  x\n}\n", {("function", "f", 1, 3)}),
    "elixir": ("defmodule M do\n  def f(x) do\n  end\nend\n", {("function", "M", 1, 4), ("function", "f", 2, 3)}),
    "elm": ("type alias A = Int\ntype B = C\nf x =\n  x\n", {("type", "A", 1, 1), ("type", "B", 2, 2), ("function", "f", 3, 4)}),
    "ocaml": ("let x = 1\nclass c = object end\n", {("const", "x", 1, 1), ("class", "c", 2, 2)}),
    "rescript": ("let x = 1\nmodule M = {\n}\n", {("const", "x", 1, 1), ("class", "M", 2, 3)}),
    "solidity": ("contract C {\n}\n", {("class", "C", 1, 2)}),
    "bash": ("f() {\n  echo '}'\n}\nX=1\n", {("function", "f", 1, 3), ("const", "X", 4, 4)}),
    "css": (".a { }\n#b {\n}\n", {("type", ".a", 1, 1), ("type", "#b", 2, 3)}),
    "json": ('{\n  "a": {"b": 1},\n  "c": 2\n}\n', {("const", "a", 2, 2), ("const", "c", 3, 3)}),
    "yaml": ("a:\n  b: 1\nc: 2\n", {("const", "a", 1, 2), ("const", "c", 3, 3)}),
    "toml": ("[t]\na = 1\n", {("class", "t", 1, 1), ("const", "a", 2, 2)}),
    "elisp": ("(defun f (x) 'y)\n(defvar v 1)\n", {("function", "f", 1, 1), ("const", "v", 2, 2)}),
}


@pytest.mark.parametrize("language", sorted(KINDS))
def test_kinds_of_each_language(language):
    text, want = KINDS[language]
    assert {s[:4] for s in found(language, text)[0]} == want


def test_definitions_are_no_calls_and_calls_are_no_definitions():
    symbols, _, calls = found("java", "class A {\n  void m(int a,\n    int b) throws X {\n    new Foo() { void in() { x(); } };\n    if (f(1)) { return g(); }\n  }\n}\n")
    assert {s[1] for s in symbols} == {"A", "m", "in"} and [c for c, _ in calls] == ["Foo", "x", "f", "g"]
    symbols, _, calls = found("c", "int a = b * f(1);\nint g(void);\nint h(void) { if (k(2)) { return m(3); } }\n")
    assert {s[1] for s in symbols} == {"a", "h"} and [c for c, _ in calls] == ["f", "k", "m"]
    assert [c for c, _ in found("kotlin", "fun f() {\n  run(1) { g() }\n}\n")[2]] == ["run", "g"]


def test_brackets_that_close_nothing():
    symbols, _, _ = found("typescript", "function a() { b(] }\nfunction c() { ) }\nfunction d() {\n  (e\n}\nfunction f() {}\n")
    assert {s[:4] for s in symbols} == {("function", "a", 1, 1), ("function", "c", 2, 2), ("function", "d", 3, 5), ("function", "f", 6, 6)}


@pytest.mark.parametrize("text", ["a " * 300_000, "{" * 400_000, "}" * 400_000, "a(" * 200_000, '"' * 400_000, "/*" * 200_000, "int a\n" * 100_000, "x<" * 200_000, "public " * 100_000])
def test_hard_files_end_in_time(text):
    for language in ("c", "java", "csharp", "typescript", "rust", "kotlin"):
        began = time.monotonic()
        assert parse.parse_text(language, text, 1.0)["failed"] in (None, "time")
        assert time.monotonic() - began < 8


def test_neighbours_of_a_hard_file_are_parsed(spark):
    rows = [("1", "rust", "fn a() {}\n"), ("2", "rust", '"' * 1_000_000), ("3", "rust", "fn b() {}\n"), ("4", "python", "def (:"), ("5", "python", "def f(): pass")]
    out = {r.sha: r for r in parse.parse_files(spark.createDataFrame(rows, "sha string, language string, content string").coalesce(1), seconds=0.5).collect()}
    assert {k: (r.failed, [s.name for s in r.symbols]) for k, r in out.items()} == {"1": (None, ["a"]), "2": ("time", []), "3": (None, ["b"]), "4": ("SyntaxError", []), "5": (None, ["f"])}


def test_files_are_parsed_once_for_the_parts_asked_by_as_many_tasks_as_shuffles_have(spark):
    text = "def a():\n    b()\n\n\ndef c():\n    d(1)\n"
    rows = [(k, f"f{k}.py", "python", "same", text) for k in range(40)] + [(99, "g.ts", "typescript", "other", "import x from 'y'\nexport function f() {\n  g(1)\n}\n"), (100, "n.ts", "typescript", "none", None)]
    files = spark.createDataFrame(rows, "id long, path string, language string, sha string, content string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # equal contents come in several batches
        whole = parse.parse_files(files)
        assert whole.rdd.getNumPartitions() == 7  # few bytes, yet not put together in one task
        got = {r.sha: r for r in whole.collect()}
        assert len(got) == whole.count() == 3
        assert [s.name for s in got["same"].symbols] == ["a", "c"] and [c.callee for c in got["same"].calls] == ["b", "d"]
        assert got["other"].imports == ["y"] and [tuple(s) for s in got["other"].symbols] == [("f", "function", "export function f()", 2, 4, True)] and got["none"].symbols == []
        for part in parse.PARTS:
            some = {r.sha: r for r in parse.parse_files(files, parts=(part,)).collect()}
            assert all(some[k][p] == (got[k][p] if p == part else []) for k in got for p in parse.PARTS)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
