"""Scalar expressions over paths, source text and identifiers.

A ``path`` is repository-relative with forward slashes.  All functions take and
return columns, so they stay inside generated code and reach scans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which token estimates count."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def estimate_tokens(text: Column) -> Column:
    """Four characters a token, rounded up; at least 1 unless empty."""
    return F.ceil(utf16_length(text) / 4).cast("long")


def terms(text: Column, least: int = 3) -> Column:
    """Lower-case alphanumeric runs of ``least`` characters or more, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= least)


#: Words that say nothing about a task.
STOPWORDS = [
    "the", "and", "for", "add", "with", "this", "that", "from", "into", "your",
    "make", "when", "where", "what", "how", "why", "view", "page", "code", "file",
    "files", "should", "support", "using", "use", "new", "get", "set", "show",
]


def keywords(text: Column) -> Column:
    """Distinct terms of four characters or more that are no stop words."""
    return F.array_except(F.array_distinct(terms(text, 4)), F.array(*map(F.lit, STOPWORDS)))


def loc(content: Column) -> Column:
    """Lines with any character besides a carriage return; lines of spaces count."""
    return F.size(F.filter(F.split(content, "\n"), lambda x: F.length(F.replace(x, F.lit("\r"), F.lit(""))) > 0)).cast("long")


def loc_trimmed(content: Column) -> Column:
    """The other line count: lines of white space don't count."""
    return F.size(F.filter(F.split(content, "\n"), lambda x: F.length(F.regexp_replace(x, r"\s", "")) > 0)).cast("long")


def low_byte_sha(content: Column) -> Column:
    """Twelve hex digits of the SHA-1 over each UTF-16 unit's low byte; for ASCII, of the text itself.

    The units' hex digits come as a whole; the last two of every four are kept.
    """
    low = F.unhex(F.regexp_replace(F.hex(F.encode(content, "UTF-16BE")), "..(..)", "$1"))
    ascii_only = F.octet_length(content) == F.length(content)
    return F.substring(F.when(ascii_only, F.sha1(content.cast("binary"))).otherwise(F.sha1(low)), 1, 12)


def looks_binary(content: Column) -> Column:
    return F.instr(F.substring(content, 1, 8000), "\0") > 0


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    """``.`` for a file at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "/"))


def normalized(path: Column) -> Column:
    """Dots folded: ``a/./b/../c`` is ``a/c``; a ``..`` that leaves the root stays."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    fold = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(F.size(fold) == 0, F.lit(".")).otherwise(F.array_join(fold, "/"))


def top_level_folder(path: Column) -> Column:
    """First segment; two under a workspace folder; ``/`` for a file at the root."""
    parts = F.split(path, "/")
    first = F.get(parts, F.lit(0))
    return F.when(F.size(parts) == 1, F.lit("/")).when(first.isin("apps", "packages", "services"), F.concat_ws("/", first, F.get(parts, F.lit(1)))).otherwise(first)


def folder_label(folder: Column) -> Column:
    return F.when(folder == "/", F.lit("root")).otherwise(folder)


def cluster_key(path: Column, depth: int = 2) -> Column:
    """The first ``depth`` folders; ``.`` at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.lit(1), F.least(F.lit(depth), F.size(parts) - 1))), "/"))


def ancestors(path: Column) -> Column:
    """Every folder above a file, nearest last, from ``''`` (the root)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def breadcrumbs(path: Column) -> Column:
    """Every prefix of a path that ends at a segment."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def file_type(path: Column, language: Column) -> Column:
    """What a file is for, by the first rule that fits."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"\.(test|spec)\.[jt]sx?$"), "test")
        .when(p.rlike(r"(^|/)(__tests__|tests?|spec|e2e)/"), "test")
        .when(p.rlike(r"\.d\.ts$"), "types")
        .when(p.rlike(r"(^|/)(tsconfig|next\.config|tailwind\.config|postcss\.config|vite\.config|webpack\.config|jest\.config|babel\.config|eslint\.config)"), "config")
        .when(p.rlike(r"\.(eslintrc|prettierrc|babelrc|gitignore)"), "config")
        .when(p.rlike(r"(^|/)(package(-lock)?|yarn\.lock|pnpm-lock|bun\.lock|cargo\.lock|go\.sum|requirements\.txt)"), "build")
        .when(p.rlike(r"\.(css|scss|sass|less)$"), "style")
        .when(language == "markdown", "docs")
        .when(language.isin("json", "yaml"), "config")
        .otherwise("source")
    )


def signature(definition: Column) -> Column:
    """A definition's head: up to a brace or line break, white space collapsed, 200 characters at most."""
    flat = F.trim(F.regexp_replace(F.regexp_extract(definition, r"^[^{\n]*", 0), r"\s+", " "))
    return F.when(F.length(flat) > 200, F.concat(F.substring(flat, 1, 197), F.lit("…"))).otherwise(flat)


def symbol_line(signature_: Column, name: Column, exported: Column, path: Column, start_line: Column) -> Column:
    """``  · signature  @path:line``; the dot marks exports whose signature doesn't show it."""
    sig = F.when(F.coalesce(signature_, F.lit("")) == "", name).otherwise(signature_)
    mark = F.when(exported & ~sig.rlike(r"^export\b|\bpub\b|\bpublic\b"), F.lit("· ")).otherwise(F.lit("  "))
    return F.concat(F.lit("  "), mark, sig, F.lit("  @"), path, F.lit(":"), start_line.cast("string"))


def churn_saturation(commits: Column, half: int = 5) -> Column:
    return commits / (commits + F.lit(half))


def slug(name: Column, spare: str = "repo") -> Column:
    found = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(found == "", F.lit(spare)).otherwise(found)


def short_number(n: Column) -> Column:
    """``1.2K`` from a thousand up."""
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000), F.lit("K"))).otherwise(n.cast("string"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over ASCII text, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: h.bitwiseXOR(c) * F.lit(0x01000193).cast("long") % F.lit(1 << 32).cast("long"))


def folder_hash(folder: Column) -> Column:
    """Absolute value of the 32-bit string hash with factor 31."""
    codes = F.transform(F.filter(F.split(folder, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31))
    return F.abs(wrapped)


def hotspot_border(commits_90d: Column) -> Column:
    return F.when(commits_90d >= 20, 3.0).when(commits_90d >= 10, 2.0).when(commits_90d >= 4, 1.5).otherwise(1.0)


def log_scale(value: Column, top: Column) -> Column:
    return F.log(value + 1) / F.log(top + 1)


def building_height(lines: Column, max_loc: Column, low: float = 0.8, high: float = 24.0) -> Column:
    return F.lit(low) + log_scale(lines, max_loc) * F.lit(high - low)


def node_radius(lines: Column) -> Column:
    return F.greatest(F.lit(3.0), F.least(F.lit(9.0), F.lit(3.0) + F.sqrt(lines) / 6))


def node_size(lines: Column) -> Column:
    """``struct<width, height>`` in whole pixels; grows with the root of the line count up to 300 lines."""
    t = F.least(F.lit(1.0), F.sqrt(lines) / F.sqrt(F.lit(300)))
    return F.struct(F.floor(156 + 64 * t + 0.5).alias("width"), F.floor(46 + 12 * t + 0.5).alias("height"))


def mixed_colour(a: str, b: str, t: Column) -> Column:
    """Between two ``#rrggbb`` colours."""

    def channel(i: int) -> Column:
        x, y = int(a[i : i + 2], 16), int(b[i : i + 2], 16)
        return F.floor(F.lit(x) + F.lit(y - x) * t + 0.5).cast("int")

    return F.format_string("#%02x%02x%02x", channel(1), channel(3), channel(5))


def palette_colour(palette: list[str], t: Column) -> Column:
    """A place between 0 and 1 on a palette of two colours or more."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (len(palette) - 1)
    found = mixed_colour(palette[-1], palette[-1], F.lit(0.0))
    for i in range(len(palette) - 2, -1, -1):
        found = F.when(at < i + 1, mixed_colour(palette[i], palette[i + 1], at - i)).otherwise(found)
    return found


def jitter(n: Column) -> Column:
    """A fixed pseudo-random number from -1 to 1 for an integer; products are doubles taken modulo 2**32."""
    word = lambda x: F.pmod(x, F.lit(4294967296.0)).cast("long")
    h = word(n.cast("double") * F.lit(2654435761.0))
    h = h.bitwiseXOR(F.shiftright(h, 15))
    h = word(h.cast("double") * F.lit(2246822519.0))
    h = h.bitwiseXOR(F.shiftright(h, 13))
    return h / F.lit(4294967295.0) * 2 - 1


def label(text: Column, most: int = 24) -> Column:
    """Shortened to ``most`` characters, keeping a file's suffix."""
    suffix = F.regexp_extract(text, r"\.[A-Za-z0-9]{1,6}$", 0)
    cut = F.concat(F.substring(text, F.lit(1), F.greatest(F.lit(1), F.lit(most - 1) - F.length(suffix))), F.lit("…"), suffix)
    return F.when(F.length(text) <= most, text).otherwise(cut)
