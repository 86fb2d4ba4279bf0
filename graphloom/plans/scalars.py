"""Queries of the scalar functions: text, paths, numbers, colours, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.plans import views as V
from graphloom.plans.registry import query, with_
from graphloom.sources import scan
from graphloom.streaming import live

STOPWORDS = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


@query(f"""SELECT doc_id AS id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'),
  lambda x: length(x) >= 4 AND NOT list_contains({STOPWORDS}, x)))), ' ') AS keywords FROM documents""")
def keywords(spark, d):
    return V.documents(spark, d).select("id", F.array_join(F.array_sort(T.keywords(F.col("content"))), " ").alias("keywords"))


@query(with_(V.DOCS) + r"""SELECT id, len(list_filter(string_split(content, chr(10)), lambda x: regexp_replace(x, '[ \t\x0b\f\r]+', '', 'g') <> '')) AS loc,
  octet_length(encode(content)) AS bytes, length(content) + length(regexp_replace(content, '[\x{0}-\x{FFFF}]', '', 'g')) AS units FROM docs""")
def line_counts_trimmed(spark, d):
    c = F.col("content")
    return V.documents(spark, d).select("id", T.loc_trimmed(c).alias("loc"), F.octet_length(c).alias("bytes"), T.utf16_length(c).alias("units"))


@query(with_(V.FILES) + """, s AS (SELECT id, path, string_split(path, '/') AS p FROM files)
SELECT id, p[1] || '/' || p[2] AS parent, path AS folded, array_to_string(['', p[1], p[1] || '/' || p[2]], ';') AS above,
  array_to_string([p[1], p[1] || '/' || p[2], path], ';') AS crumbs, p[1] AS label, '../' || p[3] AS outside FROM s""")
def path_parts(spark, d):
    p = F.col("path")
    crooked = F.concat(F.lit("./x/../"), F.replace(p, F.lit("/"), F.lit("/./")), F.lit("/y/.."))
    outside = F.concat(F.lit("a/../../"), T.base_name(p))
    return V.files(spark, d).select(
        "id", T.parent_dir(p).alias("parent"), T.normalized(crooked).alias("folded"), F.array_join(T.ancestors(p), ";").alias("above"),
        F.array_join(T.breadcrumbs(p), ";").alias("crumbs"), T.folder_label(T.top_level_folder(p)).alias("label"), T.normalized(outside).alias("outside"),
    )


@query("""SELECT p_partkey AS id, 'root' AS root_label, CASE p_partkey % 3 WHEN 0 THEN 'apps/' || lower(p_brand) WHEN 1 THEN lower(p_brand) ELSE '/' END AS folder,
  CASE p_partkey % 3 WHEN 0 THEN 'apps/' || lower(p_brand) WHEN 1 THEN lower(p_brand) ELSE '.' END AS cluster, '.' AS root_parent FROM part""")
def workspace_folders(spark, d):
    p = V.read(spark, d, "part")
    brand = F.lower("p_brand")
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("apps/"), brand, F.lit("/src/a.ts"))).when(F.col("p_partkey") % 3 == 1, F.concat(brand, F.lit("/a.ts"))).otherwise(F.lit("a.ts"))
    p = p.withColumn("path", path)
    return p.select("p_partkey", "path").select(
        F.col("p_partkey").alias("id"), T.folder_label(T.top_level_folder(F.lit("a.ts"))).alias("root_label"), T.top_level_folder(F.col("path")).alias("folder"),
        T.cluster_key(F.col("path")).alias("cluster"), T.parent_dir(F.lit("a.ts")).alias("root_parent"),
    )


#: A path of each kind that ``file_type`` knows, and the kind.
KINDS = [
    ("src/a.test.ts", "test"), ("src/b.spec.jsx", "test"), ("pkg/__tests__/c.ts", "test"), ("tests/d.py", "test"), ("e2e/e.js", "test"), ("types/f.d.ts", "types"),
    ("tsconfig.base.json", "config"), ("web/next.config.js", "config"), (".eslintrc.js", "config"), (".prettierrc", "config"), ("package.json", "build"), ("a/package-lock.json", "build"),
    ("yarn.lock", "build"), ("Cargo.lock", "build"), ("requirements.txt", "build"), ("a.scss", "style"), ("b.less", "style"), ("README.md", "docs"), ("c.yaml", "config"), ("d.go", "source"),
]
_KINDS = "[" + ", ".join(f"{{'p': '{p}', 'k': '{k}'}}" for p, k in KINDS) + "]"


@query(f"SELECT id, x.p AS path, x.k AS file_type FROM (SELECT p_partkey AS id, {_KINDS}[p_partkey % {len(KINDS)} + 1] AS x FROM part)")
def file_types_by_rule(spark, d):
    from graphloom.sources.languages import detect_language

    path = F.get(F.array(*[F.lit(p) for p, _ in KINDS]), (F.col("p_partkey") % len(KINDS)).cast("int"))
    return V.read(spark, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path"), T.file_type(path, detect_language(path)).alias("file_type"))


DEFINITION = "'export function fn_' || (l_suppkey % 60) || '(a:  string,' || chr(9) || ' b: number) ' || repeat('x', ((l_partkey % 5) * 60)::INT) || CASE WHEN l_linenumber % 2 = 0 THEN ' {' || chr(10) || '}' ELSE '' END"


@query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trim(regexp_replace(regexp_extract({DEFINITION}, '^[^{{\\n]*'), '\\s+', ' ', 'g')) AS flat FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN length(flat) > 200 THEN substr(flat, 1, 197) || '…' ELSE flat END AS signature FROM d""")
def signatures(spark, d):
    body = F.expr("""concat('export function fn_', cast(l_suppkey % 60 as string), '(a:  string,', chr(9), ' b: number) ', repeat('x', cast((l_partkey % 5) * 60 as int)),
      case when l_linenumber % 2 = 0 then concat(' {', chr(10), '}') else '' end)""")
    return V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.signature(body).alias("signature"))


@query(with_(V.FILES, V.SYMBOLS) + """SELECT s.id, CASE WHEN exported AND s.id % 3 <> 0 THEN '  · ' ELSE '    ' END || CASE s.id % 3 WHEN 0 THEN 'export function ' || name WHEN 1 THEN 'def ' || name ELSE name END
  || '  @' || path || ':' || start_line AS line FROM symbols s JOIN files f ON f.id = file_id""")
def symbol_lines(spark, d):
    s = V.symbols(spark, d).join(V.files(spark, d).select(F.col("id").alias("file_id"), "path"), "file_id")
    sig = F.when(F.col("id") % 3 == 0, F.concat(F.lit("export function "), "name")).when(F.col("id") % 3 == 1, F.concat(F.lit("def "), "name")).otherwise(F.lit(""))
    return s.select("id", T.symbol_line(sig, F.col("name"), F.col("exported"), F.col("path"), F.col("start_line")).alias("line"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey >= 1000 THEN printf('%.1fK', floor(o_orderkey / 100.0 + 0.5) / 10) ELSE o_orderkey::VARCHAR END AS short,
  round((o_orderkey % 30) / ((o_orderkey % 30) + 5.0), 9) AS saturation,
  CASE WHEN o_orderkey % 30 >= 20 THEN 3.0 WHEN o_orderkey % 30 >= 10 THEN 2.0 WHEN o_orderkey % 30 >= 4 THEN 1.5 ELSE 1.0 END::DOUBLE AS border,
  round(ln(o_orderkey % 500 + 1) / ln(501), 9) AS scaled, round(0.8 + ln(o_orderkey % 500 + 1) / ln(501) * 23.2, 9) AS height,
  round(greatest(3.0, least(9.0, 3.0 + sqrt(o_orderkey % 2000) / 6)), 9) AS radius,
  floor(156 + 64 * least(1.0, sqrt(o_orderkey % 500) / sqrt(300)) + 0.5)::BIGINT AS width, floor(46 + 12 * least(1.0, sqrt(o_orderkey % 500) / sqrt(300)) + 0.5)::BIGINT AS tall FROM orders""")
def scales(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    small, mid = F.col("id") % 30, F.col("id") % 500
    size = T.node_size(mid)
    return o.select(
        "id", T.short_number(F.col("id")).alias("short"), F.round(T.churn_saturation(small), 9).alias("saturation"), T.hotspot_border(small).alias("border"),
        F.round(T.log_scale(mid, F.lit(500)), 9).alias("scaled"), F.round(T.building_height(mid, F.lit(500)), 9).alias("height"), F.round(T.node_radius(F.col("id") % 2000), 9).alias("radius"),
        size["width"].alias("width"), size["height"].alias("tall"),
    )


_CODES = "list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i::INT, 1))::BIGINT)"


@query(with_(V.FILES) + f""", f AS (SELECT id, path, split_part(path, '/', 1) AS folder FROM files)
SELECT id, list_reduce({_CODES.format("path")}, lambda h, c: (xor(h, c)::HUGEINT * 16777619 % 4294967296)::BIGINT, 2166136261::BIGINT) AS fnv,
  abs(list_reduce({_CODES.format("folder")}, lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT)) AS folder_hash FROM f""")
def string_hashes(spark, d):
    p = F.col("path")
    return V.files(spark, d).select("id", T.fnv1a(p).alias("fnv"), T.folder_hash(T.top_level_folder(p)).alias("folder_hash"))


@query("""SELECT c_custkey AS id, CASE WHEN s = '' THEN 'repo' ELSE s END AS slug, CASE WHEN s = '' THEN 'repo' ELSE s END || '.graph.json' AS bundle FROM (
  SELECT c_custkey, regexp_replace(regexp_replace(lower(n), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM (
    SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '#?!' ELSE c_name || ' / ' || c_mktsegment || '!' END AS n FROM customer))""")
def slugs(spark, d):
    from graphloom.sources.exchange import bundle_name

    name = F.when(F.col("c_custkey") % 7 == 0, F.lit("#?!")).otherwise(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("!")))
    return V.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.slug(name).alias("slug"), bundle_name(name).alias("bundle"))


PALETTE = ["#102030", "#80ff00", "#f0e0d0"]


def _channel(a: int, b: int) -> str:
    return f"floor({a} + {b - a} * t + 0.5)::INT"


def _mixed(a: str, b: str) -> str:
    return "printf('#%02x%02x%02x', " + ", ".join(_channel(int(a[i : i + 2], 16), int(b[i : i + 2], 16)) for i in (1, 3, 5)) + ")"


@query(f"""WITH p AS (SELECT p_partkey AS id, p_size / 64.0::DOUBLE * 2 AS pos FROM part)
SELECT id, CASE WHEN pos < 1 THEN (SELECT {_mixed(PALETTE[0], PALETTE[1])} FROM (SELECT pos AS t)) ELSE (SELECT {_mixed(PALETTE[1], PALETTE[2])} FROM (SELECT pos - 1 AS t)) END AS colour FROM p""")
def palette_colours(spark, d):
    return V.read(spark, d, "part").select(F.col("p_partkey").alias("id"), T.palette_colour(PALETTE, F.col("p_size") / 64.0).alias("colour"))


@query(with_(V.FILES) + r""", n AS (SELECT id, split_part(path, '/', 3) AS name FROM files), e AS (SELECT *, regexp_extract(name, '\.[A-Za-z0-9]{1,6}$') AS ext FROM n)
SELECT id, CASE WHEN length(name) <= 24 THEN name ELSE substr(name, 1, greatest(1, 23 - length(ext))) || '…' || ext END AS label FROM e""")
def labels_shortened(spark, d):
    return V.files(spark, d).select("id", T.label(T.base_name(F.col("path"))).alias("label"))


@query(r"""WITH u AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'https://github.com/' || c_mktsegment || '/r' || c_custkey || '.git'
  WHEN 1 THEN 'github.com/o' || c_custkey || '/repo/tree/dev/x?tab=1' WHEN 2 THEN 'http://www.github.com/o/r' || c_custkey || '/' ELSE 'https://example.org/o/r' END AS url FROM customer)
SELECT id, CASE id % 4 WHEN 0 THEN split_part(url, '/', 4) WHEN 1 THEN 'o' || id WHEN 2 THEN 'o' END AS owner,
  CASE id % 4 WHEN 0 THEN 'r' || id WHEN 1 THEN 'repo' WHEN 2 THEN 'r' || id END AS name, CASE id % 4 WHEN 1 THEN 'dev/x' END AS ref FROM u""")
def repo_urls(spark, d):
    c = V.read(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    url = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("https://github.com/"), "c_mktsegment", F.lit("/r"), k, F.lit(".git")))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("github.com/o"), k, F.lit("/repo/tree/dev/x?tab=1")))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("http://www.github.com/o/r"), k, F.lit("/")))
        .otherwise(F.lit("https://example.org/o/r"))
    )
    return c.select(F.col("c_custkey").alias("id"), scan.repo_url(url).alias("u")).select("id", "u.owner", "u.name", "u.ref")


WATCHED = [".git/HEAD", "src/node_modules/x/y.js", "build", "src/builder/a.ts", "dist/a.js", "a/.next/b", "distant/c.py", "coverage/lcov", "__pycache__/m.pyc"]
_WATCHED = "[" + ", ".join(f"'{p}'" for p in WATCHED) + "]"


@query(f"""SELECT event_id, p AS path FROM (SELECT event_id, {_WATCHED}[event_id % {len(WATCHED)} + 1] AS p FROM events) WHERE p IN ('src/builder/a.ts', 'distant/c.py')""")
def watched_changes(spark, d):
    path = F.get(F.array(*map(F.lit, WATCHED)), (F.col("event_id") % len(WATCHED)).cast("int"))
    return V.events(spark, d).select("event_id", path.alias("path")).where(~F.col("path").rlike(live.WATCH_IGNORED))
