"""Chat formatting into budgeted, turn-aligned windows, with a loss mask.

Each turn becomes ``<|turn|>role\\ntext<|end|>\\n``.  Control strings inside a
text (those of this template and of other common ones) get one backslash after
their first character once all backslashes are doubled; runs of backslashes in
an escaped text are therefore even except in an escape, which makes this
reversible.

Prefix sums of turn tokens cut a conversation into spans: a span takes turns as
long as they fit what the budget leaves after the system turn and the history
allowance (the first span, which repeats nothing, the whole budget), and the next
span starts at the first turn that doesn't.  Every window after the first repeats
the system turn and the latest turns that fit the history allowance; what is
repeated is masked, so each target counts once.  A turn that leaves no room for
the history gets a window without any.

The cut needs tokens alone, so a first pass sums these by conversation and texts
move once, to their conversation.

Defined cases.  Null text or role counts as empty.  Turns that share a number are
ordered by role, then by a hash of the text; repeated rows stay repeated turns.
Null ``conv_id`` is a conversation of its own.  A turn larger than the budget
gets a window that exceeds it, flagged ``over_budget``; turns are never cut,
however long.  An empty table gives no windows.  Other columns are ignored.  Only
DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import table

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
NEWLINE_IN_ROLE = "<|nl|>"
#: Strings that mark turns in this or other chat templates; never left as they are inside a text.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
BUDGET, HISTORY = 1024, 256
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL, doubled)


def unescape(text: Column) -> Column:
    plain = reduce(lambda t, c: F.replace(t, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c)), reversed(CONTROL), text)
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def estimated_tokens(text: Column) -> Column:
    """About four characters a token; at least one, as the marks of a turn are tokens too."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def _turns(turns: DataFrame, tokens) -> DataFrame:
    """``key, conv_id, turn, role, target, is_system, body, tie, tokens``; ``key`` stands for ``conv_id`` and is never null."""
    given = F.coalesce("role", F.lit(""))
    t = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"),
        "conv_id",
        F.col("turn"),
        F.replace(escape(given), F.lit("\n"), F.lit(NEWLINE_IN_ROLE)).alias("role"),
        (given == TARGET_ROLE).alias("target"),
        (given == SYSTEM_ROLE).alias("is_system"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
    )
    return t.withColumns({"tie": F.xxhash64("body"), "tokens": tokens(F.col("body"))})


def spans_of(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """``key, span_of``: the span (from 0) of each turn of a conversation, in order.

    Prefix sums grow with every turn, so where a span ends is found by halving; the
    fold jumps from span to span.
    """
    order = Window.partitionBy("key").orderBy("turn", "role", "tie")
    summed = turns.withColumn("end", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = summed.groupBy("key").agg(F.sort_array(F.collect_list("end")).alias("ends"), F.min(F.struct("turn", "role", "tie", "is_system", "tokens")).alias("first"))
    system = F.when(F.col("first.is_system"), F.col("first.tokens")).otherwise(F.lit(0))
    listed = listed.select("key", "ends", F.size("ends").alias("n"), F.greatest(F.lit(1), F.lit(budget - history) - system).cast("long").alias("room"))

    def fitting(limit: Column) -> Column:
        """How many turns end at a limit or before."""
        halves = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
        return F.aggregate(halves, F.lit(0), lambda at, step: F.when((at + step <= F.col("n")) & (F.try_element_at("ends", F.greatest(F.lit(1), at + step)) <= limit), at + step).otherwise(at))

    def jump(state: Column, _: Column) -> Column:
        at = state["at"]
        limit = F.when(at == 0, F.lit(budget).cast("long")).otherwise(F.get("ends", at - 1) + F.col("room"))
        moved = F.transform(F.array(F.greatest(at + 1, fitting(limit))), lambda to: F.struct(to.alias("at"), F.concat(state["starts"], F.array(to)).alias("starts")))
        return F.when(at < F.col("n"), F.get(moved, F.lit(0))).otherwise(state)

    none = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("starts"))
    # Starts of all spans, and the end of the last.
    starts = F.aggregate("ends", none, jump)["starts"]
    found = listed.select("key", starts.alias("starts"))
    lengths = F.transform(F.slice("starts", 1, F.size("starts") - 1), lambda s, i: F.array_repeat(i, F.get("starts", i + 1) - s))
    return found.select("key", F.flatten(lengths).alias("span_of"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=estimated_tokens) -> DataFrame:
    """One row per window: ``conv_id, key, window, formatted, n_context, loss, n_tokens, over_budget``.

    Rows lie by ``key``, which stands for ``conv_id`` and is never null, so what
    groups by it needs no shuffle.  ``n_context`` leading turns of the window are repeated from before; ``loss``
    lists ``start`` (from 0) and ``length``, in characters, of the target texts.
    """
    t = _turns(turns, tokens)
    spans = spans_of(t, budget, history)
    by = Window.partitionBy("key")
    order = by.orderBy("turn", "role", "tie")
    t = t.withColumn("no", F.row_number().over(order))
    piece = F.struct("no", "role", "body", "target", "tokens")
    t = t.withColumn("system", F.first(F.when((F.col("no") == 1) & F.col("is_system"), piece)).over(by.orderBy("no")))
    t = t.withColumn("before", F.sum("tokens").over(by.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("before", F.coalesce("before", F.lit(0)))
    # Whole turns before this one that start at most `history` tokens back; the system turn comes apart.
    recent = F.collect_list(piece).over(by.orderBy("before").rangeBetween(-history, -1))
    t = t.withColumn("recent", recent).join(spans, "key")
    span = F.get("span_of", F.col("no") - 1)
    opens = (F.col("no") > 1) & (span != F.get("span_of", F.greatest(F.lit(0), F.col("no") - 2)))
    t = t.withColumns({"span": span.cast("long"), "history": F.when(opens, F.col("recent"))}).drop("span_of")
    spans = t.groupBy("key", "span").agg(
        F.first("conv_id").alias("conv_id"),
        F.min("no").alias("first_no"),
        F.first("system", ignorenulls=True).alias("system"),
        F.first("history", ignorenulls=True).alias("history"),
        F.sort_array(F.collect_list(piece)).alias("new"),
    )
    later = F.col("first_no") > 1
    none = F.expr("slice(new, 1, 0)")
    system = F.when(later & F.col("system").isNotNull(), F.array("system")).otherwise(none)
    told = F.filter(F.coalesce("history", none), lambda p: F.col("system").isNull() | (p["no"] != F.col("system.no")))
    spans = spans.withColumns({"lead": system, "told": told})
    whole = F.aggregate(F.concat("lead", "told", "new"), F.lit(0).cast("long"), lambda n, p: n + p["tokens"])
    spans = spans.withColumn("context", F.when(whole <= budget, F.concat("lead", "told")).otherwise(F.col("lead")))
    spans = spans.withColumn("n_context", F.size("context")).withColumn("turns", F.concat("context", "new"))
    spans = spans.withColumn("texts", F.transform("turns", lambda p: F.concat(F.lit(OPEN), p["role"], F.lit("\n"), p["body"], F.lit(CLOSE))))
    # Where each turn's body starts: the turns before it, its mark, its role and the line break.
    starts = F.aggregate(
        F.transform("texts", lambda x: F.length(x).cast("long")),
        F.array(F.lit(0).cast("long")),
        lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)),
    )
    spans = spans.withColumn("starts", starts)
    loss = F.transform(
        "turns",
        lambda p, i: F.struct(
            (F.get("starts", i) + F.lit(len(OPEN) + 1) + F.length(p["role"])).alias("start"),
            F.length(p["body"]).cast("long").alias("length"),
            (p["target"] & (i >= F.col("n_context"))).alias("on"),
        ),
    )
    spans = spans.withColumn("loss", F.transform(F.filter(loss, lambda s: s["on"]), lambda s: F.struct(s["start"], s["length"])))
    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda n, p: n + p["tokens"])
    return spans.select(
        "conv_id", "key", F.col("span").alias("window"), F.array_join("texts", "").alias("formatted"), "n_context", "loss", n_tokens.alias("n_tokens"), (n_tokens > budget).alias("over_budget")
    )


def read_back(wins: DataFrame) -> DataFrame:
    """Per window, parsed from its formatted text alone: ``turns`` (role, text; repeated ones left out) and ``loss_text``."""
    pieces = F.slice(F.split("formatted", r"<\|end\|>\n"), F.col("n_context") + 1, F.size(F.split("formatted", r"<\|end\|>\n")) - 1 - F.col("n_context"))
    parsed = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.replace(F.regexp_extract(p, r"(?s)\A<\|turn\|>([^\n]*)\n", 1), F.lit(NEWLINE_IN_ROLE), F.lit("\n"))).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)\A<\|turn\|>[^\n]*\n(.*)\z", 1)).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return wins.select("conv_id", "key", "window", parsed.alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("formatted").cast("long").alias("n_chars"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    back = read_back(windows(given.unionByName(planted)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = back.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", told.alias("told"), "loss_text"))).alias("w"),
        F.sum("n_chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("w", lambda x: x["loss_text"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda x: x["told"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
