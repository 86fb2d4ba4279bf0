"""Views of the driver's tables as files, edges, symbols, calls, commits and events, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.languages import detect_language

EXTENSIONS = ["ts", "py", "go", "rs", "java", "md", "json", "css", "rb", "txt"]
LANGUAGES = ["typescript", "python", "go", "rust", "java", "markdown", "json", "css", "ruby", "other"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS)).cast("int"))
    path = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("."), ext)
    out = p.select(F.col("p_partkey").alias("id"), path.alias("path"), F.col("p_size").cast("long").alias("loc"), F.substring(F.sha1(F.col("p_name").cast("binary")), 1, 12).alias("sha"))
    return out.withColumn("language", detect_language(F.col("path")))


def _consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null and src <> dst")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consecutive(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of edges, with repeats."""
    return _consecutive(spark, sf_dir).select("src", "dst")


def rank_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with weights that differ more, so that ranks do too."""
    return _consecutive(spark, sf_dir).groupBy("src", "dst").agg(F.sum("l_linenumber").cast("long").alias("weight"))


def raw_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before ids: ``file_id, start_line, pos`` order them."""
    li = read(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 10).cast("int")
    return li.select(
        F.col("l_partkey").alias("file_id"), F.concat(F.lit("fn_"), (F.col("l_suppkey") % 60).cast("string")).alias("name"),
        F.when(F.col("l_linestatus") == "O", "function").otherwise("class").alias("kind"), F.lit("").alias("signature"),
        start.alias("start_line"), (start + F.col("l_quantity").cast("int")).alias("end_line"), (F.col("l_returnflag") == "N").alias("exported"),
        F.struct("l_orderkey", "l_suppkey").alias("pos"),
    )


def symbols(spark: SparkSession, sf_dir: str, without: tuple[str, ...] = ()) -> DataFrame:
    from graphloom.operators.assemble import symbol_ids

    return symbol_ids(raw_symbols(spark, sf_dir).drop(*without), drop=("pos",))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("call_id"), F.col("l_partkey").alias("file_id"),
        F.concat(F.lit("fn_"), ((F.col("l_orderkey") * 31 + F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 120).cast("string")).alias("callee"),
        (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 50).cast("int").alias("line"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").cast("string").alias("commit_id"), F.col("l_shipdate").alias("ts"), F.col("l_suppkey").cast("string").alias("author"))
    return li.join(files(spark, sf_dir).select("id", "path"), "id").drop("id")


def last_commit(spark: SparkSession, sf_dir: str):
    return read(spark, sf_dir, "lineitem").agg(F.max("l_shipdate")).first()[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.col("doc_id").alias("id"), path.alias("path"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("content"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(read(spark, sf_dir, "events"))


def events_of(table: DataFrame) -> DataFrame:
    return table.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), "value", "props")


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
FILES = f"""files AS (
  SELECT p_partkey AS id,
    lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.' || {_LIST(EXTENSIONS)}[p_partkey % 10 + 1] AS path,
    p_size::BIGINT AS loc, substr(sha1(p_name), 1, 12) AS sha, {_LIST(LANGUAGES)}[p_partkey % 10 + 1] AS language FROM part)"""
NEXT = """nexts AS (
  SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey AS src,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst)"""
EDGES = NEXT + ", edges AS (SELECT src, dst, count(*) AS weight FROM nexts GROUP BY src, dst)"
RANK_EDGES = NEXT + """, edges AS (
  SELECT src, dst, sum(l_linenumber)::BIGINT AS weight FROM nexts GROUP BY src, dst)"""
SYMBOLS = """symbols AS (
  SELECT row_number() OVER (ORDER BY l_partkey, l_linenumber, l_orderkey, l_suppkey) - 1 AS id, l_partkey AS file_id, 'fn_' || (l_suppkey % 60) AS name,
    CASE WHEN l_linestatus = 'O' THEN 'function' ELSE 'class' END AS kind, l_linenumber * 10 AS start_line,
    l_linenumber * 10 + l_quantity::INT AS end_line, l_returnflag = 'N' AS exported FROM lineitem)"""
CALLS = """calls AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS call_id, l_partkey AS file_id,
    'fn_' || ((l_orderkey * 31 + l_suppkey * 7 + l_linenumber) % 120) AS callee, l_linenumber * 10 + l_suppkey % 50 AS line
  FROM lineitem)"""
COMMITS = "commits AS (SELECT l_partkey AS file_id, l_orderkey AS commit_id, l_shipdate AS ts, l_suppkey AS author FROM lineitem)"
DOCS = "docs AS (SELECT doc_id AS id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, lang AS language, coalesce(text, '') AS content FROM documents)"
FOLDER = "split_part(path, '/', 1)"


def pagerank_sql(jump: str = "1.0", iterations: int = 40) -> str:
    """CTEs from ``files`` and ``edges`` to ``ranks(id, rank, score)``; ``jump`` is a file's unscaled teleport weight."""
    return f"""outs AS (SELECT src, sum(weight)::DOUBLE AS w FROM edges GROUP BY src),
shares AS (SELECT e.src, e.dst, e.weight / o.w AS share FROM edges e JOIN outs o USING (src)),
leans AS (SELECT id, ({jump})::DOUBLE AS lean FROM files),
jumps AS (SELECT id, lean / (SELECT sum(lean) FROM leans) AS jump FROM leans),
pr AS (
  SELECT 0 AS it, id, 1.0::DOUBLE / (SELECT count(*) FROM files) AS r FROM files
  UNION ALL
  SELECT any_value(it) + 1, id, sum(v) FROM (
    SELECT pr.it, s.dst AS id, 0.85 * pr.r * s.share AS v FROM pr JOIN shares s ON s.src = pr.id
    UNION ALL
    SELECT d.it, j.id, (0.15 + 0.85 * d.lost) * j.jump FROM jumps j,
      (SELECT pr.it, sum(CASE WHEN o.src IS NULL THEN pr.r ELSE 0 END) AS lost FROM pr LEFT JOIN outs o ON o.src = pr.id GROUP BY pr.it) d)
  WHERE it < {iterations} GROUP BY id),
ranks AS (SELECT id, r AS rank, r / max(r) OVER () AS score FROM pr WHERE it = {iterations})"""
