"""Rendered, token-budgeted views: skeleton, neighbourhood, task context, hotspots and lists.

A view shows a prefix of ranked files, and each file costs at least a token, so
at most ``budget`` files and a dozen symbols each can show.  That prefix is cut
by the cluster (a top-k and a ranked window); only it is rendered on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from graphloom.functions.text import estimate_tokens, symbol_line
from graphloom.operators import rank
from graphloom.operators.budget import Budget, tokens_of
from graphloom.operators.churn import hotspots
from graphloom.operators.model import Graph
from graphloom.operators.neighborhood import rings
from graphloom.operators.retrieval import find_symbols, neighbours, resolve_file_target
from graphloom.streaming.live import Queue


@dataclass
class View:
    """Text, and the files that it shows."""

    text: str
    file_ids: list[int] = field(default_factory=list)


def links(graph: Graph) -> DataFrame:
    return graph.import_edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight")


def surfaces(graph: Graph, most: int) -> DataFrame:
    """``file_id, n_symbols, lines``: each file's first ``most`` symbol lines, exports first, then by line."""
    w = Window.partitionBy("file_id").orderBy(F.desc("exported"), "start_line", "id")
    numbered = graph.symbols.withColumn("k", F.row_number().over(w))
    joined = numbered.join(graph.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    line = symbol_line(F.col("signature"), F.col("name"), F.col("exported"), F.col("path"), F.col("start_line"))
    shown = F.sort_array(F.collect_list(F.when(F.col("k") <= most, F.struct("k", line.alias("line")))))
    return joined.groupBy("file_id").agg(F.count("*").alias("n_symbols"), F.transform(shown, lambda s: s["line"]).alias("lines"))


def _prefix(ranking: DataFrame, graph: Graph, most: int, limit: int, needs_symbols: bool) -> list[Row]:
    """At most ``limit`` files in order, with their symbol lines, which are made for these files only."""
    if needs_symbols:
        ranking = ranking.join(graph.symbols.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi")
    top = ranking.join(graph.files.select("id", "language", "loc"), "id").orderBy("rnk").limit(limit).collect()
    if not top:
        return []
    ids = graph.files.sparkSession.createDataFrame([(r.id,) for r in top], "file_id long")
    files = graph.files.join(F.broadcast(ids.withColumnRenamed("file_id", "id")), "id", "left_semi")
    symbols = graph.symbols.join(F.broadcast(ids), "file_id", "left_semi")
    found = {r.file_id: r for r in surfaces(replace(graph, files=files, symbols=symbols), most).collect()}
    none = Row(n_symbols=None, lines=None)
    return [Row(**r.asDict(), n_symbols=s.n_symbols, lines=s.lines) for r in top for s in [found.get(r.id, none)]]


def skeleton(graph: Graph, budget: int = 1500, most: int = 12, ranking: DataFrame | None = None, inventory: bool = False) -> View:
    """Central files first, each with its public surface; a file shows with its first symbol or not at all."""
    ranking = ranking if ranking is not None else rank.ranked(graph.files, rank.centrality(graph.files, links(graph)))
    n_files = graph.files.count()
    purse = Budget(budget)
    header = f"# {graph.name} — skeleton ({n_files} files, {graph.edges().count()} import edges)\n"
    purse.charge(header)
    lines, shown_ids = [], []
    for r in _prefix(ranking, graph, most, budget, needs_symbols=True):
        title = f"\n{r.path}  ({r.language}, {r.loc} loc)"
        if not purse.fits(f"{title}\n{r.lines[0]}"):
            break
        purse.charge(title)
        lines.append(title)
        shown = 0
        while shown < len(r.lines) and purse.spend("\n" + r.lines[shown]):
            lines.append(r.lines[shown])
            shown += 1
        if shown < r.n_symbols:
            more = f"  … {r.n_symbols - shown} more symbol(s) in {r.path}"
            if purse.spend("\n" + more):
                lines.append(more)
        shown_ids.append(r.id)
    footer = ""
    if inventory:
        rest = [r.path for r in graph.files.where(~F.col("id").isin(shown_ids or [-1])).select("path").orderBy("path").toLocalIterator()]
        if rest:
            footer = f"\n\n# Every other file ({len(rest)}) — complete inventory, nothing hidden (paths only; use find_symbol / get_neighborhood for any of them):\n" + "\n".join(rest)
    elif n_files > len(shown_ids):
        footer = f"\n\n… {n_files - len(shown_ids)} lower-ranked file(s) omitted to fit {budget}-token budget. Use find_symbol / get_neighborhood to drill in."
    return View(header + "\n".join(lines) + footer, shown_ids)


def neighborhood(graph: Graph, centre: int, depth: int = 1, budget: int = 1200, most: int = 8, scores: DataFrame | None = None) -> View:
    """A file, then its rings, nearest and most central first."""
    named = graph.files.where(F.col("id") == centre).select("path").first()
    if named is None:
        return View(f"Unknown file id {centre}.")
    scores = scores if scores is not None else rank.centrality(graph.files, links(graph))
    around = rings(links(graph), graph.files.where(F.col("id") == centre).select("id"), depth)
    total = around.count()
    ordered = around.join(graph.files.select("id", "path"), "id").join(scores.select("id", "score"), "id", "left")
    order = Window.orderBy("ring", F.round(F.coalesce("score", F.lit(0.0)), 12).desc(), "path")
    ordered = ordered.select("id", "path", "ring", "relation", F.row_number().over(order).alias("rnk"))
    purse = Budget(budget)
    header = f"# neighborhood of {named.path} (depth {depth}, {total} files)\n"
    purse.charge(header)
    lines, shown_ids = [], []
    for r in _prefix(ordered, graph, most, budget + 1, needs_symbols=False):
        tag = "CENTER" if r.relation == "center" else r.relation + (f" ·{r.ring}" if r.ring > 1 else "")
        title = f"\n[{tag}] {r.path}  ({r.language}, {r.loc} loc)"
        symbols = r.lines or []
        if not purse.fits(title + ("\n" + symbols[0] if symbols else "")):
            lines.append(f"\n[{tag}] {r.path}  @{r.path}:1  (budget reached)")
            break
        purse.charge(title)
        lines.append(title)
        shown = 0
        while shown < len(symbols) and purse.spend("\n" + symbols[shown]):
            lines.append(symbols[shown])
            shown += 1
        rest = (r.n_symbols or 0) - shown
        note = f"  (no public symbols — @{r.path}:1)" if not symbols else f"  … {rest} more in {r.path}" if rest else ""
        if note and purse.spend("\n" + note):
            lines.append(note)
        shown_ids.append(r.id)
    return View(header + "\n".join(lines), shown_ids)


def resolve_context(graph: Graph, task: str, budget: int = 2500, focus_files: int = 2, depth: int = 1) -> View:
    """A task's skeleton, then the neighbourhoods of its first files."""
    scores = rank.centrality(graph.files, links(graph))
    ranking = rank.rank_for_task(graph.files, graph.symbols, links(graph), task)
    seen: dict[int, None] = {}
    first = skeleton(graph, max(400, int(budget * 0.45 + 0.5)), ranking=ranking)
    parts = [f"# context for: {task.strip()}\n", "## Most relevant files (task-ranked)\n" + first.text]
    seen.update(dict.fromkeys(first.file_ids))
    left = max(0, budget - tokens_of("\n".join(parts)))
    with_symbols = ranking.join(graph.symbols.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi")
    focus = [r.id for r in with_symbols.orderBy("rnk").limit(max(1, focus_files)).collect()]
    if left > 200 and focus:
        each = max(300, left // len(focus))
        hoods = [neighborhood(graph, i, depth, each, scores=scores) for i in focus]
        parts.append("## Key neighborhoods (import structure)\n" + "\n\n".join(h.text for h in hoods))
        for h in hoods:
            seen.update(dict.fromkeys(h.file_ids))
    parts.append("\n— Every line carries a path:line anchor. Read source only where a slice is insufficient.")
    return View("\n\n".join(parts), list(seen))


def _listed(head: str, rows: list[tuple[int | None, str]], budget: int, more: str) -> View:
    purse, lines, ids = Budget(budget), [], []
    purse.charge(head)
    for file_id, line in rows:
        if not purse.spend("\n" + line):
            break
        lines.append(line)
        ids.append(file_id)
    rest = len(rows) - len(lines)
    return View(head + "\n" + "\n".join(lines) + (more.format(rest) if rest else ""), [i for i in ids if i is not None])


def hotspot_view(graph: Graph, scores: DataFrame, churned: DataFrame | None, budget: int = 600, limit: int = 20) -> View:
    touched = churned.count() if churned is not None else 0
    head = f"# hotspots — load-bearing × recently-changed ({touched} files touched)\n" if touched else "# hotspots — import centrality (no git churn data)\n"
    found = hotspots(graph.files, scores, churned, limit).collect()
    rows = [(r.id, f"  {r.path}  (centrality {r.centrality:.2f}{f', {r.commits} commits' if touched else ''})  @{r.path}:1") for r in found]
    view = _listed(head, rows, budget, "")
    return View(view.text.replace(head + "\n", head, 1), view.file_ids)


def dependents_view(graph: Graph, scores: DataFrame, target: str, direction: str = "dependents", budget: int = 800) -> View:
    """Who imports a target, or what it imports, in budget."""
    spark = graph.files.sparkSession
    asked = resolve_file_target(graph.files, graph.symbols, spark.createDataFrame([(target,)], "target string")).first()
    if asked is None or asked.file_id is None:
        return View(f'Could not resolve "{target}" to a single file (unknown or ambiguous). Try a fuller path.')
    path = graph.files.where(F.col("id") == asked.file_id).first().path
    hits = neighbours(links(graph), graph.files, scores, [asked.file_id], "in" if direction == "dependents" else "out")
    verb = "is imported by" if direction == "dependents" else "imports"
    total = hits.count()
    if not total:
        return View(f"{path} {verb} nothing (in-graph).", [asked.file_id])
    shown = hits.orderBy(F.round("score", 12).desc(), F.desc("weight"), "path").limit(budget).collect()
    rows = [(r.id, f"  {r.path}  (×{r.weight}, centrality {r.score:.2f})  @{r.path}:1") for r in shown]
    view = _listed(f"{path} {verb} {total} file(s):", rows + [(None, "")] * (total - len(rows)), budget, "\n  … {} more omitted.")
    return View(view.text, [asked.file_id, *view.file_ids])


def languages_view(files: DataFrame, budget: int = 500) -> View:
    stats = files.groupBy("language").agg(F.count("*").alias("n"), F.sum("loc").alias("loc")).orderBy(F.desc("loc"), F.desc("n"), "language").collect()
    if not stats:
        return View("No files indexed.")
    width = min(20, max(len(r.language) for r in stats))
    head = f"{len(stats)} language(s) across {sum(r.n for r in stats)} files, {sum(r['loc'] for r in stats)} loc:"
    rows = [(None, f"  {r.language:<{width}}  {r.n:>5} file(s)  {r['loc']:>8} loc") for r in stats]
    return _listed(head, rows, budget, "\n  … {} more language(s) omitted (raise budget_tokens).")


def line_breaks(sources: DataFrame, key: str = "sha") -> DataFrame:
    """``key, breaks``: at which bytes each content has its line breaks; to be kept with an index, by digest."""
    kind = dict(sources.dtypes)[key]

    def run(batches):
        for batch in batches:
            found = [np.flatnonzero(np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8) == 10) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], [key, "breaks"])

    return sources.dropDuplicates([key]).select(key, "content").mapInArrow(run, f"{key} {kind}, breaks array<long>")


def sliced(symbols: DataFrame, sources: DataFrame, budget: int = 400, head: int = 8, breaks: DataFrame | None = None) -> DataFrame:
    """``id, anchor, source, elided``: a symbol's lines, or its first ones and a pointer; ``sources``: ``file_id, path, content`` (and ``sha``, if ``breaks`` are given).

    Only files that have a wanted symbol are read, each once: its symbols' lines
    are cut out of its bytes by the places of its line breaks.
    """
    wanted = symbols.groupBy("file_id").agg(F.collect_list(F.struct("id", "start_line", "end_line")).alias("wanted"))
    read = sources.join(wanted, "file_id")
    read = read.join(line_breaks(read.select("file_id", "content"), "file_id"), "file_id") if breaks is None else read.join(breaks, "sha")
    each = read.select("path", F.col("content").cast("binary").alias("data"), "breaks", "wanted").withColumn("lines", F.size("breaks") + 1)

    def cut(s):
        begin = F.greatest(F.lit(1), s["start_line"])
        n = F.greatest(F.lit(0), F.least(F.col("lines"), s["end_line"]) - begin + 1)
        kept = F.least(n, F.lit(max(1, head)))
        return F.struct(s["id"].alias("id"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), n.alias("n"), kept.alias("kept"), text(begin, n).alias("full"), text(begin, kept).alias("short"))

    def text(begin, n):
        """``n`` lines from a line on; a break in the text may have a carriage return before it."""
        at = F.when(begin > 1, F.get("breaks", (begin - 2).cast("int")) + 1).otherwise(F.lit(0))
        last = (begin + n - 2).cast("int")
        ended = last < F.size("breaks")
        stop = F.when(ended, F.get("breaks", last) + 1).otherwise(F.length("data"))
        told = F.replace(F.substring(F.col("data"), (at + 1).cast("int"), (stop - at).cast("int")).cast("string"), F.lit("\r\n"), F.lit("\n"))
        return F.when(n <= 0, F.lit("")).when(ended, F.substring(told, F.lit(1), F.length(told) - 1)).otherwise(told)

    cuts = each.select("path", F.explode(F.transform("wanted", cut)).alias("s")).select("path", "s.*")
    anchor = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    pointer = F.concat("short", F.lit("\n  … "), (F.col("n") - F.col("kept")).cast("string"), F.lit(" more line(s) — read "), anchor)
    fits = estimate_tokens(F.col("full")) <= budget
    return cuts.select("id", anchor.alias("anchor"), F.when(fits, F.col("full")).otherwise(pointer).alias("source"), (~fits).alias("elided"))


def neighborhood_of(graph: Graph, target: str, depth: int = 1, budget: int = 1200) -> View:
    """The neighbourhood of a path, a path's suffix or a symbol's file, if that is one file."""
    asked = graph.files.sparkSession.createDataFrame([(target,)], "target string")
    found = resolve_file_target(graph.files, graph.symbols, asked).first()
    if found is None or found.file_id is None:
        return View(f'Could not resolve "{target}" to a single file (unknown or ambiguous). Try a fuller path.')
    return neighborhood(graph, found.file_id, depth, budget)


def find_symbol_view(graph: Graph, scores: DataFrame, sources: DataFrame, name: str | None = None, pattern: str | None = None, budget: int = 800) -> View:
    """Definitions by name or pattern, each with its anchor and source."""
    if not name and not pattern:
        return View("Provide `name` or `pattern`.")
    hits = find_symbols(graph.symbols, graph.files, scores, name, pattern).collect()
    if not hits:
        return View(f"No symbols match {name or pattern}.")
    wanted = graph.files.sparkSession.createDataFrame([(h.id, h.file_id, h.start_line, h.end_line) for h in hits], "id long, file_id long, start_line int, end_line int")
    found = {r.id: r for r in sliced(wanted, sources, 300).collect()}
    purse, blocks, ids = Budget(budget), [], {}
    for h in hits:
        s = found.get(h.id)
        anchor = s.anchor if s else f"{h.path}:{h.start_line}-{h.end_line}"
        block = f"{h.signature}  @{anchor}\n{s.source if s else '(source unavailable — read the anchor)'}"
        if not purse.spend("\n\n" + block):
            break
        blocks.append(block)
        ids[h.file_id] = None
    rest = len(hits) - len(blocks)
    return View("\n\n".join(blocks) + (f"\n\n… {rest} more match(es) omitted (narrow the query)." if rest else ""), list(ids))


def request_view(graph: Graph, request_id: str, instruction: str, paths: list[str], kind: str = "instruction", budget: int = 2500) -> View:
    """A viewer's request with the context staged for it; the files are those selected and those staged."""
    spark = graph.files.sparkSession
    asked = spark.createDataFrame([(p,) for p in paths], "target string")
    found = {r.target: r.file_id for r in resolve_file_target(graph.files, graph.symbols, asked).collect()}
    selected = [found[p] for p in dict.fromkeys(paths) if found.get(p) is not None]
    staged = resolve_context(graph, instruction + ("\n\nFocus files:\n" + "\n".join(paths) if paths else ""), budget)
    question = kind == "question"
    closing = f"answer with submit_answer, request_id {request_id}" if question else "carry it out"
    text = "\n".join([f"# {'question' if question else 'instruction'} {request_id} ({closing})", instruction, "", "## selected", " ".join(f"@{p}" for p in paths) or "(none)", "", "## staged context", staged.text])
    return View(text, list(dict.fromkeys([*selected, *staged.file_ids])))


def next_request(graph: Graph, queue: Queue, requests: dict[int, dict], now: float, budget: int = 2500) -> View:
    """The view of the oldest waiting request, which the queue gives away once; ``requests`` has what was asked, by number."""
    taken = queue.take(now)
    if taken is None:
        return View("No pending viewer request.")
    asked = requests.pop(taken)
    return request_view(graph, str(taken), asked["instruction"], asked.get("paths") or [], asked.get("kind") or "instruction", asked.get("budget") or budget)


def task_skeleton(graph: Graph, task: str = "", budget: int = 1500) -> View:
    """The command line's skeleton: ranked for a task, or by centrality without one."""
    return skeleton(graph, budget, ranking=rank.rank_for_task(graph.files, graph.symbols, links(graph), task))


def savings(estimates: DataFrame) -> DataFrame:
    """``line`` rows, in order of ``no``, of a table of ``task, tokens, baseline``, and their totals last."""
    shown = lambda n: F.when(n >= 1000, F.format_string("%.1fK", n / 1000)).otherwise(n.cast("string"))
    ratio = F.when(F.col("tokens") > 0, F.col("baseline") / F.col("tokens")).otherwise(F.lit(0.0))
    line = F.format_string("| %s | %s | %s | %.1f× |", "task", shown(F.col("tokens")), shown(F.col("baseline")), ratio)
    totals = estimates.agg(F.sum("tokens").alias("tokens"), F.sum("baseline").alias("baseline")).select(F.lit("total").alias("task"), "tokens", "baseline", F.lit(1).alias("last"))
    both = estimates.select("task", "tokens", "baseline", F.lit(0).alias("last")).unionByName(totals)
    return both.select(F.row_number().over(Window.orderBy("last", "task")).alias("no"), line.alias("line"))
