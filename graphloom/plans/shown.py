"""Queries of what is shown: rendered views under a budget, viewers' filters, requests and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import assemble, churn, rank, retrieval, viewer, views as rendered
from graphloom.operators.numbering import numbered
from graphloom.plans import catalog as C
from graphloom.plans import views as V
from graphloom.plans.registry import query, with_
from graphloom.plans.shared_folder import written
from graphloom.sources import scan
from graphloom.streaming import live

# ---- views rendered under a budget, folded file by file in SQL -----------------------


def _tokens(text: str) -> str:
    return f"ceil(length({text}) / 4.0)::BIGINT"


def _surface(name: str, most: int) -> str:
    """``name(file_id, n, lines)``: a file's symbol lines, exports first."""
    return f"""{name} AS (SELECT file_id, count(*) AS n, list(line ORDER BY k) FILTER (WHERE k <= {most}) AS lines FROM (
  SELECT s.file_id, row_number() OVER (PARTITION BY s.file_id ORDER BY s.exported DESC, s.start_line, s.id) AS k,
    '  ' || CASE WHEN s.exported THEN '· ' ELSE '  ' END || s.name || '  @' || f.path || ':' || s.start_line AS line FROM symbols s JOIN files f ON f.id = s.file_id) GROUP BY file_id)"""


#: How many lines of a file fit after its title, by the sums of their tokens.
_CUMULATED = "list_transform(range(1, len(lines) + 1), lambda i: list_sum(list_transform(lines[1:i], lambda x: ceil((length(x) + 1) / 4.0)))::BIGINT)"


def _skeleton(name: str, ranking: str, budget: str) -> list[str]:
    """CTEs up to ``name(text, file_ids)``; ``ranking(id, no)`` orders the files."""
    return [
        _surface(f"{name}_s", 12),
        f"""{name}_f AS (SELECT row_number() OVER (ORDER BY r.no) AS pos, f.id, f.path, chr(10) || f.path || '  (' || f.language || ', ' || f.loc || ' loc)' AS title, s.n, s.lines
  FROM {ranking} r JOIN files f ON f.id = r.id JOIN {name}_s s ON s.file_id = f.id)""",
        f"""{name}_h AS (SELECT '# parts — skeleton (' || (SELECT count(*) FROM files) || ' files, ' || ((SELECT count(*) FROM edges) + (SELECT count(*) FROM call_edges)) || ' import edges)' || chr(10) AS head, ({budget})::BIGINT AS lim)""",
        f"""{name}_w AS (
  SELECT 0::BIGINT AS pos, {_tokens("head")} AS used, true AS ok, []::VARCHAR[] AS said, []::BIGINT[] AS ids FROM {name}_h
  UNION ALL
  SELECT pos, CASE WHEN ok THEN used2 + CASE WHEN noted THEN note_tokens ELSE 0 END ELSE used END, ok,
    CASE WHEN ok THEN said || [title] || lines[1:shown] || CASE WHEN noted THEN [note] ELSE [] END ELSE said END, CASE WHEN ok THEN ids || [id] ELSE ids END
  FROM (SELECT *, note IS NOT NULL AND used2 + note_tokens <= lim AS noted FROM (SELECT *, {_tokens("chr(10) || note")} AS note_tokens FROM (
    SELECT *, CASE WHEN shown < n THEN '  … ' || (n - shown) || ' more symbol(s) in ' || path END AS note, used1 + coalesce(cum[shown], 0) AS used2 FROM (
      SELECT *, len(list_filter(cum, lambda c: used1 + c <= lim)) AS shown FROM (
        SELECT f.pos, w.used, w.said, w.ids, f.id, f.path, f.title, f.n, f.lines, h.lim, w.used + {_tokens("f.title || chr(10) || f.lines[1]")} <= h.lim AS ok,
          w.used + {_tokens("f.title")} AS used1, {_CUMULATED.replace("lines", "f.lines")} AS cum
        FROM {name}_w w JOIN {name}_f f ON f.pos = w.pos + 1 CROSS JOIN {name}_h h WHERE w.ok))))))""",
        f"""{name}_l AS (SELECT said, ids FROM {name}_w ORDER BY pos DESC, ok LIMIT 1)""",
        f"""{name} AS (SELECT head || array_to_string(said, chr(10)) || CASE WHEN (SELECT count(*) FROM files) > len(ids)
  THEN chr(10) || chr(10) || '… ' || ((SELECT count(*) FROM files) - len(ids)) || ' lower-ranked file(s) omitted to fit ' || lim || '-token budget. Use find_symbol / get_neighborhood to drill in.' ELSE '' END AS text, ids AS file_ids
  FROM {name}_l, {name}_h)""",
    ]


def _hood(name: str, centre: str, budget: str) -> list[str]:
    """CTEs up to ``name(text, file_ids)`` of a file's neighbourhood of depth 1."""
    return [
        _surface(f"{name}_s", 8),
        f"""{name}_n AS (SELECT id, 1 AS ring, CASE bit_or(way) WHEN 1 THEN 'dependency' WHEN 2 THEN 'dependent' ELSE 'mixed' END AS tag FROM (
    SELECT dst AS id, 1 AS way FROM edges WHERE src = {centre} UNION ALL SELECT src, 2 FROM edges WHERE dst = {centre}) WHERE id <> {centre} GROUP BY id
  UNION ALL SELECT {centre}, 0, 'CENTER')""",
        f"""{name}_f AS (SELECT row_number() OVER (ORDER BY x.ring, round(r.score, 12) DESC, f.path) AS pos, f.id, f.path, tag,
    chr(10) || '[' || tag || '] ' || f.path || '  (' || f.language || ', ' || f.loc || ' loc)' AS title, coalesce(s.n, 0) AS n, coalesce(s.lines, []::VARCHAR[]) AS lines
  FROM {name}_n x JOIN files f ON f.id = x.id JOIN ranks r ON r.id = f.id LEFT JOIN {name}_s s ON s.file_id = f.id)""",
        f"""{name}_h AS (SELECT '# neighborhood of ' || (SELECT path FROM files WHERE id = {centre}) || ' (depth 1, ' || (SELECT count(*) FROM {name}_n) || ' files)' || chr(10) AS head, ({budget})::BIGINT AS lim)""",
        f"""{name}_w AS (
  SELECT 0::BIGINT AS pos, {_tokens("head")} AS used, true AS ok, []::VARCHAR[] AS said, []::BIGINT[] AS ids FROM {name}_h
  UNION ALL
  SELECT pos, CASE WHEN ok THEN used2 + CASE WHEN noted THEN note_tokens ELSE 0 END ELSE used END, ok,
    CASE WHEN ok THEN said || [title] || lines[1:shown] || CASE WHEN noted THEN [note] ELSE [] END ELSE said || [chr(10) || '[' || tag || '] ' || path || '  @' || path || ':1  (budget reached)'] END, CASE WHEN ok THEN ids || [id] ELSE ids END
  FROM (SELECT *, note IS NOT NULL AND used2 + note_tokens <= lim AS noted FROM (SELECT *, {_tokens("chr(10) || note")} AS note_tokens FROM (
    SELECT *, CASE WHEN len(lines) = 0 THEN '  (no public symbols — @' || path || ':1)' WHEN shown < n THEN '  … ' || (n - shown) || ' more in ' || path END AS note, used1 + coalesce(cum[shown], 0) AS used2 FROM (
      SELECT *, len(list_filter(cum, lambda c: used1 + c <= lim)) AS shown FROM (
        SELECT f.pos, w.used, w.said, w.ids, f.id, f.path, f.tag, f.title, f.n, f.lines, h.lim, w.used + {_tokens("f.title || CASE WHEN len(f.lines) > 0 THEN chr(10) || f.lines[1] ELSE '' END")} <= h.lim AS ok,
          w.used + {_tokens("f.title")} AS used1, {_CUMULATED.replace("lines", "f.lines")} AS cum
        FROM {name}_w w JOIN {name}_f f ON f.pos = w.pos + 1 CROSS JOIN {name}_h h WHERE w.ok))))))""",
        f"""{name}_l AS (SELECT said, ids FROM {name}_w ORDER BY pos DESC, ok LIMIT 1)""",
        f"""{name} AS (SELECT head || array_to_string(said, chr(10)) AS text, ids AS file_ids FROM {name}_l, {name}_h)""",
    ]


GRAPH = (V.FILES, V.SYMBOLS, V.CALLS, V.RANK_EDGES, C.ENCLOSED, C.CALLEES, C.CALL_EDGES, V.pagerank_sql())
PLAIN = "plain AS (SELECT r.id, row_number() OVER (ORDER BY round(r.score, 12) DESC, path) AS no FROM ranks r JOIN files USING (id))"


def _shown(spark, view):
    return spark.createDataFrame([(view.text, view.file_ids)], "text string, file_ids array<long>")


@query(with_(*GRAPH, PLAIN, *_skeleton("shown", "plain", "1500")) + "SELECT text, file_ids FROM shown")
def skeleton(spark, d):
    return _shown(spark, rendered.skeleton(C._graph(spark, d)))


@query(with_(*GRAPH, *_hood("shown", "40", "1200")) + "SELECT text, file_ids FROM shown")
def neighborhood_view(spark, d):
    return _shown(spark, rendered.neighborhood(C._graph(spark, d), 40))


def _task_ranks(task: str) -> str:
    """``tasked(id, no)``: files by matches with a task (in path and symbol names) and personalised centrality."""
    lean = "(SELECT m FROM matched WHERE matched.id = files.id)"
    personal = V.pagerank_sql(lean)
    for old, new in (("outs AS", "t_outs AS"), ("FROM edges e JOIN outs o", "FROM edges e JOIN t_outs o"), ("shares AS", "t_shares AS"), ("leans AS", "t_leans AS"), ("FROM leans", "FROM t_leans"), ("jumps AS", "t_jumps AS"), ("\npr AS", "\nt_pr AS"),
                     ("FROM pr JOIN shares s ON s.src = pr.id", "FROM t_pr pr JOIN t_shares s ON s.src = pr.id"), ("FROM jumps j", "FROM t_jumps j"), ("FROM pr LEFT JOIN outs o", "FROM t_pr pr LEFT JOIN t_outs o"), ("ranks AS", "t_ranks AS"), ("FROM pr WHERE", "FROM t_pr WHERE")):
        assert old in personal, old
        personal = personal.replace(old, new)
    hits = "len(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) >= 3 AND list_contains(t, x)))"
    return f"""task AS (SELECT list_distinct(list_filter(regexp_extract_all(lower('{task}'), '[a-z0-9]+'), lambda x: length(x) >= 3)) AS t),
by_symbol AS (SELECT file_id, sum(2 * {hits.format("name")})::DOUBLE AS m FROM symbols, task GROUP BY file_id),
matched AS (SELECT f.id, {hits.format("f.path")}::DOUBLE + coalesce(s.m, 0) AS m FROM files f LEFT JOIN by_symbol s ON s.file_id = f.id, task),
{personal},
tasked AS (SELECT id, row_number() OVER (ORDER BY round(2 * m / (SELECT max(m) FROM matched) + score, 12) DESC, path) AS no FROM t_ranks JOIN matched USING (id) JOIN files USING (id))"""


#: The skeleton has 45% of the budget; what its text leaves is dealt to the neighbourhoods of the first two files.
CONTEXT = [
    f"said AS (SELECT '# context for: {C.TASK}' || chr(10) || chr(10) || chr(10) || '## Most relevant files (task-ranked)' || chr(10) || text AS first, file_ids FROM sk)",
    "room AS (SELECT greatest(0, 2500 - ceil(length('# context for: " + C.TASK + "' || chr(10) || chr(10) || '## Most relevant files (task-ranked)' || chr(10) || text) / 4.0)::BIGINT) AS r FROM sk)",
    "focus AS (SELECT id, row_number() OVER (ORDER BY no) AS k FROM tasked WHERE id IN (SELECT file_id FROM symbols))",
]
EACH = "(SELECT greatest(300, r // 2) FROM room)"


@query(with_(*GRAPH, _task_ranks(C.TASK), *_skeleton("sk", "tasked", "1125"), *CONTEXT, *_hood("h1", "(SELECT id FROM focus WHERE k = 1)", EACH), *_hood("h2", "(SELECT id FROM focus WHERE k = 2)", EACH)) + """
SELECT first || chr(10) || chr(10) || CASE WHEN (SELECT r FROM room) > 200 THEN '## Key neighborhoods (import structure)' || chr(10) || h1.text || chr(10) || chr(10) || h2.text || chr(10) || chr(10) ELSE '' END
  || chr(10) || '— Every line carries a path:line anchor. Read source only where a slice is insufficient.' AS text,
  list_reduce(said.file_ids || CASE WHEN (SELECT r FROM room) > 200 THEN h1.file_ids || h2.file_ids ELSE [] END, lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE a || [x] END, []::BIGINT[]) AS file_ids FROM said, h1, h2""")
def resolve_context(spark, d):
    return _shown(spark, rendered.resolve_context(C._graph(spark, d), C.TASK))


@query(with_(*GRAPH, _task_ranks(C.TASK), *_skeleton("shown", "tasked", "1500")) + "SELECT text, file_ids FROM shown")
def task_skeleton(spark, d):
    return _shown(spark, rendered.task_skeleton(C._graph(spark, d), C.TASK))


@query()
def staged_request(spark, d):
    paths = [r.path for r in V.files(spark, d).where("id in (3, 4)").orderBy("id").collect()]
    return _shown(spark, rendered.request_view(C._graph(spark, d), "q1", "how do these fit together", paths, "question"))


def _list(rows: str, head: str, budget: int, more: str = "''") -> str:
    """A text of ``rows(no, line)`` up to the first that doesn't fit; ``more`` may use ``rest``."""
    return f"""runs AS (SELECT no, line, {_tokens(head)} + sum({_tokens("chr(10) || line")}) OVER (ORDER BY no) AS used FROM {rows}),
kept AS (SELECT coalesce(list(line ORDER BY no), []::VARCHAR[]) AS said, (SELECT count(*) FROM {rows}) - count(*) AS rest FROM runs WHERE used <= {budget})
SELECT {head} || chr(10) || array_to_string(said, chr(10)) || CASE WHEN rest > 0 THEN {more} ELSE '' END AS text FROM kept"""


@query(with_(V.FILES) + """, g AS (SELECT language, count(*) AS n, sum(loc)::BIGINT AS loc FROM files GROUP BY language),
w AS (SELECT least(20, max(length(language))) AS width FROM g),
h AS (SELECT count(*) || ' language(s) across ' || sum(n)::BIGINT || ' files, ' || sum(loc)::BIGINT || ' loc:' AS head FROM g),
rows AS (SELECT row_number() OVER (ORDER BY loc DESC, n DESC, language) AS no, '  ' || rpad(language, width::INT, ' ') || '  ' || lpad(n::VARCHAR, 5, ' ') || ' file(s)  ' || lpad(loc::VARCHAR, 8, ' ') || ' loc' AS line FROM g, w), """
    + _list("rows", "(SELECT head FROM h)", 90, "chr(10) || '  … ' || rest || ' more language(s) omitted (raise budget_tokens).'"))
def languages_view(spark, d):
    return _shown(spark, rendered.languages_view(V.files(spark, d), 90)).select("text")


@query(C.RANKS.rstrip() + f""", target AS (SELECT id, path FROM files ORDER BY path LIMIT 1),
hits AS (SELECT src AS id, f.path, e.weight, r.score FROM edges e JOIN target t ON e.dst = t.id JOIN files f ON f.id = e.src JOIN ranks r ON r.id = e.src),
h AS (SELECT (SELECT path FROM target) || ' is imported by ' || count(*) || ' file(s):' AS head FROM hits),
rows AS (SELECT row_number() OVER (ORDER BY round(score, 12) DESC, weight DESC, path) AS no, '  ' || path || '  (×' || weight || ', centrality ' || printf('%.2f', score) || ')  @' || path || ':1' AS line FROM hits), """
    + _list("rows", "(SELECT head FROM h)", 300, "chr(10) || '  … ' || rest || ' more omitted.'"))
def dependents_view(spark, d):
    target = V.files(spark, d).orderBy("path").first().path
    g = C._imports_graph(spark, d)
    return _shown(spark, rendered.dependents_view(g, C._scores(spark, d, rendered.links(g)), target, budget=300)).select("text")


@query(C.RANKS.rstrip() + f""", ch AS (SELECT l_partkey AS id, count(*) AS commits FROM lineitem WHERE l_shipdate >= {C.UNTIL} - INTERVAL 90 DAY GROUP BY 1),
top AS (SELECT path, coalesce(commits, 0) AS commits, score, row_number() OVER (ORDER BY round(score + coalesce(commits, 0)::DOUBLE / (coalesce(commits, 0) + 5), 12) DESC, path) AS no FROM ranks JOIN files USING (id) LEFT JOIN ch USING (id) QUALIFY no <= 20),
runs AS (SELECT no, '  ' || path || '  (centrality ' || printf('%.2f', score) || ', ' || commits || ' commits)  @' || path || ':1' AS line FROM top),
h AS (SELECT '# hotspots — load-bearing × recently-changed (' || (SELECT count(*) FROM ch) || ' files touched)' || chr(10) AS head),
summed AS (SELECT no, line, (SELECT {_tokens("head")} FROM h) + sum({_tokens("chr(10) || line")}) OVER (ORDER BY no) AS used FROM runs)
SELECT (SELECT head FROM h) || string_agg(line, chr(10) ORDER BY no) AS text FROM summed WHERE used <= 600""")
def hotspot_view(spark, d):
    churned = churn.churn(V.commits(spark, d), V.last_commit(spark, d))
    g = C._graph(spark, d)
    return _shown(spark, rendered.hotspot_view(g, C._scores(spark, d, rendered.links(g)), churned)).select("text")


@query(with_(V.FILES, V.SYMBOLS, _surface("s", 5)) + "SELECT file_id, n AS n_symbols, array_to_string(lines, chr(10)) AS lines FROM s")
def surfaces(spark, d):
    from graphloom.operators.model import Graph

    found = rendered.surfaces(Graph("parts", V.files(spark, d), V.symbols(spark, d), None, None), 5)
    return found.select("file_id", "n_symbols", F.array_join("lines", "\n").alias("lines"))


def _sliced(symbols: str, budget: int, head: int) -> str:
    """``sized(id, anchor, b, t, elided)``: the lines of symbols whose file has a text."""
    return rf"""cut AS (SELECT s.id, f.path || ':' || start_line || '-' || end_line AS anchor, regexp_split_to_array(content, '\r?\n') AS l, start_line, end_line
  FROM {symbols} s JOIN files f ON f.id = s.file_id JOIN docs d ON d.id = s.file_id),
body AS (SELECT id, anchor, CASE WHEN least(len(l), end_line) >= greatest(1, start_line) THEN l[greatest(1, start_line):least(len(l), end_line)] ELSE [] END AS b FROM cut),
whole AS (SELECT *, array_to_string(b, chr(10)) AS t FROM body),
sized AS (SELECT *, ceil((length(t) + length(regexp_replace(t, '[\x{{0}}-\x{{FFFF}}]', '', 'g'))) / 4.0) > {budget} AS elided FROM whole),
slices AS (SELECT id, anchor, CASE WHEN NOT elided THEN t ELSE array_to_string(b[1:{head}], chr(10)) || chr(10) || '  … ' || (len(b) - len(b[1:{head}])) || ' more line(s) — read ' || anchor END AS source, elided FROM sized)"""


def _sources(spark, d):
    return V.documents(spark, d).select(F.col("id").alias("file_id"), "content").join(V.files(spark, d).select(F.col("id").alias("file_id"), "path"), "file_id")


@query(with_(V.FILES, V.SYMBOLS, V.DOCS, _sliced("symbols", 40, 2)) + "SELECT id, anchor, source, elided FROM slices")
def symbol_slices(spark, d):
    return rendered.sliced(V.symbols(spark, d), _sources(spark, d), 40, 2)


FOUND = with_(
    V.FILES, V.SYMBOLS, V.DOCS, V.RANK_EDGES, V.pagerank_sql(),
    "hits AS (SELECT s.*, f.path, row_number() OVER (ORDER BY round(r.score, 12) DESC, exported DESC, f.path, start_line, s.id) AS k FROM symbols s JOIN files f ON f.id = s.file_id JOIN ranks r ON r.id = f.id WHERE name = 'fn_7' QUALIFY k <= 25)",
    _sliced("hits", 300, 8),
    """blocks AS (SELECT k, file_id, '  @' || coalesce(anchor, path || ':' || start_line || '-' || end_line) || chr(10) || coalesce(source, '(source unavailable — read the anchor)') AS block FROM hits LEFT JOIN slices USING (id))""",
    r"""spent AS (SELECT *, sum(ceil((2 + length(block) + length(regexp_replace(block, '[\x{0}-\x{FFFF}]', '', 'g'))) / 4.0)) OVER (ORDER BY k) AS used FROM blocks)""",
    "fits AS (SELECT * FROM spent WHERE k = 1 OR used <= 800)",
)


@query(FOUND + """SELECT (SELECT string_agg(block, chr(10) || chr(10) ORDER BY k) FROM fits)
  || CASE WHEN (SELECT count(*) FROM blocks) > (SELECT count(*) FROM fits) THEN chr(10) || chr(10) || '… ' || ((SELECT count(*) FROM blocks) - (SELECT count(*) FROM fits)) || ' more match(es) omitted (narrow the query).' ELSE '' END AS text,
  (SELECT list(file_id ORDER BY m) FROM (SELECT file_id, min(k) AS m FROM fits GROUP BY file_id)) AS file_ids""")
def find_symbol_view(spark, d):
    g = C._imports_graph(spark, d)
    return _shown(spark, rendered.find_symbol_view(g, C._scores(spark, d, rendered.links(g)), _sources(spark, d), name="fn_7"))


@query(with_(*GRAPH, *_hood("shown", "40", "1200")) + "SELECT text, file_ids FROM shown")
def neighborhood_of_a_name(spark, d):
    """The target is the end of a path, which only one file has."""
    name = V.files(spark, d).where("id = 40").select(T.base_name(F.col("path")).alias("n")).first().n
    return _shown(spark, rendered.neighborhood_of(C._graph(spark, d), name))


@query(with_(V.FILES, V.SYMBOLS, V.CALLS, V.RANK_EDGES, C.ENCLOSED, C.CALLEES, C.CALL_EDGES) + """, listed AS (
  SELECT row_number() OVER (ORDER BY s.path, t.path) - 1 AS id, src AS source_id, dst AS target_id, 'import' AS kind, weight FROM edges JOIN files s ON s.id = src JOIN files t ON t.id = dst
  UNION ALL SELECT (SELECT count(*) FROM edges) + row_number() OVER (ORDER BY src, dst) - 1, src, dst, 'calls', weight FROM call_edges)
SELECT id, source_id, target_id, kind, weight FROM listed""")
def edges_of_both_kinds(spark, d):
    """Import edges numbered by path, call edges after them."""
    from graphloom.operators.model import Graph

    f, s, e = V.files(spark, d), V.symbols(spark, d), written(V.rank_edges(spark, d), "edges")
    imports = assemble.numbered_edges(e, f)
    # Counted first and then numbered, so they are made once.
    linked = written(assemble.call_edges(V.calls(spark, d), s, e), "call-edges")
    called = numbered(linked, ["src", "dst"], start=imports.count())
    return Graph("parts", f, s, imports, called.select("id", F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "weight")).edges()


@query(with_(V.FILES) + """, e AS (
  SELECT language AS task, sum(loc)::BIGINT AS tokens, (sum(loc) * (10 + length(language)))::BIGINT AS baseline FROM files GROUP BY language),
x AS (SELECT *, 0 AS last FROM e UNION ALL SELECT 'total', sum(tokens)::BIGINT, sum(baseline)::BIGINT, 1 FROM e)
SELECT row_number() OVER (ORDER BY last, task) AS no, '| ' || task || ' | ' || CASE WHEN tokens >= 1000 THEN printf('%.1fK', floor(tokens / 100 + 0.5) / 10) ELSE tokens::VARCHAR END || ' | '
  || CASE WHEN baseline >= 1000 THEN printf('%.1fK', floor(baseline / 100 + 0.5) / 10) ELSE baseline::VARCHAR END || ' | ' || printf('%.1f', CASE WHEN tokens > 0 THEN baseline / tokens ELSE 0 END) || '× |' AS line FROM x""")
def savings_table(spark, d):
    by = V.files(spark, d).groupBy(F.col("language").alias("task")).agg(F.sum("loc").alias("tokens"))
    return rendered.savings(by.withColumn("baseline", F.col("tokens") * (10 + F.length("task"))))


# ---- viewers ------------------------------------------------------------------------

_ATLAS = with_(V.FILES, V.SYMBOLS) + f""", p AS (SELECT id, loc, path, {C.SEEDED} FROM files), c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM p),
a AS (SELECT *, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS away FROM p, c), m AS (SELECT greatest(1, max(away)) AS r FROM a),
h1 AS (SELECT *, fmod(id * 2654435761.0::DOUBLE, 4294967296.0::DOUBLE)::BIGINT AS h FROM a, m),
h2 AS (SELECT * REPLACE (fmod(xor(h, h >> 15)::DOUBLE * 2246822519.0::DOUBLE, 4294967296.0::DOUBLE)::BIGINT AS h) FROM h1),
f AS (SELECT id, x, y, r * 0.7 * (1 - (away / r) ** 2) + (xor(h, h >> 13) / 4294967295.0::DOUBLE * 2 - 1) * r * 0.14 AS z, greatest(3.0, least(9.0, 3.0 + sqrt(loc) / 6)) AS radius FROM h2),
k AS (SELECT s.id, s.kind, s.file_id, (row_number() OVER (PARTITION BY s.file_id ORDER BY s.id) - 1)::DOUBLE AS k FROM symbols s),
t AS (SELECT k.*, (k % 16) / 15 * 2 - 1 AS tilt, 7 + k * 1.1 AS shell FROM k),
nodes AS (SELECT 'f' || id AS node, 'file' AS type, id AS file_id, x, y, z, radius::DOUBLE AS radius FROM f UNION ALL
  SELECT 's' || t.id, kind, t.file_id, f.x + cos(k * 2.399963) * sqrt(greatest(0.0, 1 - tilt * tilt)) * shell, f.y + sin(k * 2.399963) * sqrt(greatest(0.0, 1 - tilt * tilt)) * shell, f.z + tilt * shell, 2.4
  FROM t JOIN f ON f.id = t.file_id)
"""


def _nodes(spark, d):
    f = V.files(spark, d)
    flat = f.select("id", (F.col("id") * 7919 % 1009).alias("x"), (F.col("id") * 104729 % 1013).alias("y"))
    return viewer.atlas_nodes(f, V.symbols(spark, d), flat)


@query(_ATLAS + "SELECT node, type, file_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(radius, 6) AS radius FROM nodes")
def atlas_orbits(spark, d):
    return _nodes(spark, d).select("node", "type", "file_id", *[F.round(c, 4).alias(c) for c in ("x", "y", "z")], F.round("radius", 6).alias("radius"))


@query(_ATLAS + """SELECT round((min(x) + max(x)) / 2, 4) AS cx, round((min(y) + max(y)) / 2, 4) AS cy, round((min(z) + max(z)) / 2, 4) AS cz,
  round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z), 50) * 1.2, 4) AS dist, round(greatest(5.0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z), 50) / 180), 4) AS pick FROM nodes""")
def atlas_bounds(spark, d):
    found = viewer.bounds(_nodes(spark, d))
    return found.select(*[F.round(c, 4).alias(c) for c in found.columns])


@query(C.ATLAS_WITH + """SELECT source, target, kind FROM links WHERE kind <> 'imports'
  AND source NOT IN (SELECT 's' || id FROM symbols WHERE kind = 'class') AND target NOT IN (SELECT 's' || id FROM symbols WHERE kind = 'class')""")
def atlas_visible(spark, d):
    s, e = viewer.marked(V.symbols(spark, d, without=("signature",)), ["class"]), C._edges(spark, d)
    return viewer.visible_links(s, e, assemble.call_edges(V.calls(spark, d), s, e), ["class"], ["imports"])


FOCUS = 40


@query(with_(V.EDGES) + f"""SELECT CASE WHEN src = {FOCUS} THEN dst ELSE src END AS id, sum(weight)::BIGINT AS weight, greatest(1, max(sum(weight)) OVER ())::BIGINT AS top
FROM edges WHERE src = {FOCUS} OR dst = {FOCUS} GROUP BY 1""")
def focus_neighbours(spark, d):
    return viewer.focus_neighbours(V.edges(spark, d), FOCUS)


@query(with_(V.EDGES) + f"SELECT src, dst, weight FROM edges WHERE src = {FOCUS} OR dst = {FOCUS}")
def focus_edges(spark, d):
    return viewer.incident(V.edges(spark, d), FOCUS)


@query(with_(V.RANK_EDGES) + "SELECT src, dst, weight FROM edges ORDER BY weight DESC, src, dst LIMIT 400")
def heaviest_edges(spark, d):
    return viewer.heaviest(V.rank_edges(spark, d))


def _special(spark, d):
    near = viewer.focus_neighbours(V.edges(spark, d), FOCUS).select("id")
    return viewer.partitioned(viewer.buildings(V.files(spark, d)), near.unionByName(spark.range(FOCUS, FOCUS + 1)))


SPECIAL = with_(V.FILES, V.EDGES) + f", special AS (SELECT {FOCUS} AS id UNION SELECT dst FROM edges WHERE src = {FOCUS} UNION SELECT src FROM edges WHERE dst = {FOCUS})\n"


@query(SPECIAL + "SELECT f.id, s.id IS NOT NULL AS special FROM files f LEFT JOIN special s USING (id)")
def special_buildings(spark, d):
    return _special(spark, d).select("id", "special")


@query(SPECIAL + "SELECT id FROM special UNION ALL (SELECT id FROM files ANTI JOIN special USING (id) ORDER BY loc DESC, id LIMIT 140)")
def labelled_buildings(spark, d):
    return viewer.labelled(_special(spark, d), V.files(spark, d))


COLOURS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in viewer.LANGUAGE_COLOURS.items()) + "}"


@query(with_(V.FILES) + f"SELECT language AS key, language AS label, {COLOURS}[language] AS colour, count(*) AS n FROM files GROUP BY language")
def legend_languages(spark, d):
    return viewer.legend(V.files(spark, d))


@query(with_(V.FILES) + """, t AS (SELECT CASE WHEN language = 'markdown' THEN 'docs' WHEN language = 'json' THEN 'config' WHEN path LIKE '%.css' THEN 'style' ELSE 'source' END AS key FROM files)
SELECT key, CASE key WHEN 'style' THEN 'styles' ELSE key END AS label, CASE key WHEN 'docs' THEN '#64748B' WHEN 'config' THEN '#F59E0B' WHEN 'style' THEN '#EC4899' ELSE '#3B82F6' END AS colour, count(*) AS n FROM t GROUP BY key""")
def legend_types(spark, d):
    return viewer.legend(V.files(spark, d), "type")


@query(with_(V.FILES) + """, fnv AS (SELECT id, path, list_reduce(list_transform(range(1, length(path) + 1), lambda i: ascii(substr(path, i::INT, 1))::BIGINT), lambda h, c: (xor(h, c)::HUGEINT * 16777619 % 4294967296)::BIGINT, 2166136261::BIGINT) AS s0,
  list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::INT, 1))::BIGINT), lambda h, c: (xor(h, c)::HUGEINT * 16777619 % 4294967296)::BIGINT, 2166136261::BIGINT) AS h
  FROM (SELECT *, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS k FROM files)),
a1 AS (SELECT *, xor(s0, (s0 & 524287) << 13) AS a FROM fnv), a2 AS (SELECT *, xor(a, a >> 17) AS b FROM a1), s1 AS (SELECT *, xor(b, (b & 134217727) << 5) AS s1 FROM a2),
b1 AS (SELECT *, xor(s1, (s1 & 524287) << 13) AS c FROM s1), b2 AS (SELECT *, xor(c, c >> 17) AS e FROM b1), s2 AS (SELECT *, xor(e, (e & 134217727) << 5) AS s2 FROM b2)
SELECT id, round(cos((h & 65535) / 65535.0::DOUBLE * 2 * pi()) * (500 + ((h >> 16) & 255) / 255.0::DOUBLE * 250) + ((s1 & 16777215) / 16777216.0::DOUBLE * 2 - 1) * 40, 6) AS x,
  round(sin((h & 65535) / 65535.0::DOUBLE * 2 * pi()) * (500 + ((h >> 16) & 255) / 255.0::DOUBLE * 250) + ((s2 & 16777215) / 16777216.0::DOUBLE * 2 - 1) * 40, 6) AS y FROM s2""")
def layout_seeds(spark, d):
    return viewer.layout_seed(V.files(spark, d)).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# ---- requests, answers, folders -----------------------------------------------------

QUEUE = """e AS (SELECT user_id % 10 AS key, event_id, epoch_us(ts) / 1e6 AS now, CASE event_type WHEN 'purchase' THEN 'take' WHEN 'error' THEN 'take_question' ELSE 'put' END AS action,
  CASE event_type WHEN 'signup' THEN 'question' ELSE 'instruction' END AS kind, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS no FROM events),
q AS (SELECT DISTINCT key, 0::BIGINT AS no, []::STRUCT(t DOUBLE, id BIGINT, kind VARCHAR)[] AS items, false AS asked, NULL::BIGINT AS event_id, NULL::BIGINT AS taken FROM e
  UNION ALL
  SELECT key, no, CASE WHEN action = 'put' THEN CASE WHEN len(items) >= 20 THEN items[2:] ELSE items END || [{'t': now, 'id': event_id, 'kind': kind}]
      WHEN hit IS NULL THEN items ELSE list_filter(items, lambda x: x.id <> hit) END, action <> 'put', event_id, CASE WHEN action <> 'put' THEN hit END
  FROM (SELECT *, CASE WHEN action = 'take' THEN items[1].id WHEN action = 'take_question' THEN list_filter(items, lambda x: x.kind = 'question')[1].id END AS hit FROM (
    SELECT e.key, e.no, e.event_id, e.now, e.action, e.kind, list_filter(q.items, lambda x: e.now - x.t <= 600) AS items FROM q JOIN e ON e.key = q.key AND e.no = q.no + 1)))"""


@query("WITH RECURSIVE " + QUEUE + " SELECT key, event_id, taken FROM q WHERE asked")
def request_queue(spark, d):
    action = F.when(F.col("kind") == "purchase", "take").when(F.col("kind") == "error", "take_question").otherwise("put")
    kind = F.when(F.col("kind") == "signup", "question").otherwise("instruction")
    return live.queue_results(V.events(spark, d).select((F.col("key") % 10).alias("key"), "ts", "event_id", action.alias("action"), kind.alias("kind")))


@query("""WITH RECURSIVE f AS (SELECT user_id, event_id, epoch_ms(ts) AS at, event_type = 'purchase' AS done, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_type = 'purchase', event_id::VARCHAR) AS no FROM events),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS no, NULL::BIGINT AS event_id, NULL::BIGINT AS last, false AS sent FROM f
  UNION ALL SELECT f.user_id, f.no, f.event_id, CASE WHEN NOT f.done AND (w.last IS NULL OR f.at - w.last >= 40000000) THEN f.at ELSE w.last END, f.done OR w.last IS NULL OR f.at - w.last >= 40000000
  FROM w JOIN f ON f.user_id = w.user_id AND f.no = w.no + 1)
SELECT user_id AS request_id, event_id::VARCHAR AS text FROM w WHERE sent""")
def throttled_frames(spark, d):
    """Events as frames of an answer each user waits for; those of a purchase are final."""
    frames = V.events(spark, d).select(F.col("key").alias("request_id"), "ts", F.col("event_id").cast("string").alias("text"), (F.col("kind") == "purchase").alias("done"))
    return live.throttled(frames, 40_000_000).select("request_id", "text")


@query("""SELECT user_id AS session, event_id, count(*) OVER w AS calls, sum(ceil(length(props) / 4.0)::BIGINT) OVER w::BIGINT AS tokens FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_receipt(spark, d):
    e = V.events(spark, d)
    return live.running_receipt(e.select(F.col("key").alias("session"), "ts", "event_id", T.estimate_tokens(F.col("props")).alias("tokens"))).select("session", "event_id", "calls", "tokens")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'signup' THEN 'question' ELSE 'instruction' END AS kind FROM events WHERE event_type IN ('view', 'signup')")
def question_requests(spark, d):
    kind = F.when(F.col("kind") == "view", F.lit(None).cast("string")).when(F.col("kind") == "signup", "question").otherwise("instruction")
    return live.questions(V.events(spark, d).select("event_id", kind.alias("kind")))


@query("SELECT 'answer' AS kind, user_id::VARCHAR AS request_id, props AS answer, true AS done, ts FROM events WHERE event_type <> 'click'")
def answer_events(spark, d):
    answer = F.when(F.col("kind") == "click", F.lit("")).otherwise(F.col("props"))
    return live.answer_events(V.events(spark, d).select(F.col("key").cast("string").alias("request_id"), answer.alias("answer"), "ts"))


@query(with_(V.FILES, V.EDGES) + "SELECT id FROM files WHERE language = 'go' UNION SELECT dst FROM edges JOIN files ON files.id = src WHERE language = 'go'")
def touched_files(spark, d):
    chosen = V.files(spark, d).where("language = 'go'").select("id")
    return retrieval.one_hop(chosen, V.edges(spark, d))


LISTED = [
    "src/a.ts", "node_modules/b.js", "dist/c.js", "d.png", "docs/e.md", "vendor/f.go", "build", "g.lock", "distant/h.py", ".git/i", "k.ear", "l.pyo", "m.o", "n.a", "p.lib", "q.obj", "r.avro", "s.orc",
    "t.sqlite3", "u.mdb", "v.psd", "w.ai", "x.sketch", "y.PNG", "bin", "a.zip/z", "a.b/bin", "c.sqlite", "e.war",
]
_LISTED = "[" + ", ".join(f"'{p}'" for p in LISTED) + "]"


@query(f"""WITH t AS (SELECT p_partkey AS id, {_LISTED}[p_partkey % {len(LISTED)} + 1] AS p, p_size * 50000 AS size, p_partkey % 7 = 0 AS tree FROM part)
SELECT id, p AS path, size FROM t WHERE NOT tree AND p IN ('src/a.ts', 'docs/e.md', 'distant/h.py', 'k.ear', 'l.pyo', 'm.o', 'n.a', 'p.lib', 'q.obj', 'r.avro', 's.orc', 't.sqlite3', 'u.mdb', 'v.psd', 'w.ai', 'x.sketch', 'a.zip/z', 'a.b/bin') AND size <= 1572864""")
def hosted_files(spark, d):
    path = F.get(F.array(*map(F.lit, LISTED)), (F.col("p_partkey") % len(LISTED)).cast("int"))
    tree = V.read(spark, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path"), F.when(F.col("p_partkey") % 7 == 0, "tree").otherwise("blob").alias("kind"), (F.col("p_size") * 50_000).alias("size"))
    return scan.checked_size(scan.hosted(tree), 10**9, 10**15).select("id", "path", "size")


@query("""SELECT row_number() OVER (ORDER BY is_git DESC, lower(name), name) AS no, name, is_git FROM (
  SELECT CASE WHEN c_custkey % 6 = 0 THEN '.' || c_name WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END AS name, c_acctbal > 5000 AS is_git FROM customer) WHERE name NOT LIKE '.%'""")
def browsed_folders(spark, d):
    c = V.read(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("."), "c_name")).when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(F.col("c_name"))
    listed = scan.browsed(c.select(name.alias("name"), (F.col("c_acctbal") > 5000).alias("is_git")))
    return numbered(listed.withColumns({"last": ~F.col("is_git"), "folded": F.lower("name")}), ["last", "folded", "name"], "no", start=1).select("no", "name", "is_git")


@query("""SELECT event_id, TIMESTAMP '2024-01-15 12:00:00' - ts < INTERVAL 60 MINUTE AND (user_id % 3 = 0 OR ts > TIMESTAMP '2024-01-15 11:30:00') AS fresh FROM events""")
def fresh_graphs(spark, d):
    at = lambda t: F.lit(t).cast("timestamp")
    index = F.when(F.col("key") % 3 != 0, at("2024-01-15 11:30:00"))
    return V.events(spark, d).select("event_id", scan.fresh(F.col("ts"), index, at("2024-01-15 12:00:00")).alias("fresh"))


@query(with_(V.FILES, V.RANK_EDGES, V.pagerank_sql()) + "SELECT id, round(score, 6) AS score FROM ranks")
def pagerank_distributed(spark, d):
    """The strategy for graphs of any size; ranks are those of the single task."""
    return rank.centrality(V.files(spark, d), C._edges(spark, d), strategy="distributed").select("id", F.round("score", 6).alias("score"))
