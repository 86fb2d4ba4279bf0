"""Languages by file name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of each language that is parsed.
SUFFIXES = {
    "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "python": "py pyi", "go": "go", "rust": "rs", "java": "java",
    "c": "c h", "cpp": "cpp cc cxx hpp hh", "csharp": "cs", "kotlin": "kt kts", "ruby": "rb", "php": "php", "swift": "swift",
    "scala": "scala", "dart": "dart", "zig": "zig", "lua": "lua", "r": "r", "elixir": "ex exs", "elm": "elm", "ocaml": "ml mli",
    "rescript": "res", "solidity": "sol", "tlaplus": "tla", "objc": "m mm", "bash": "sh bash", "vue": "vue", "html": "html htm",
    "embedded_template": "ejs erb", "css": "css", "json": "json", "yaml": "yaml yml", "toml": "toml", "systemrdl": "rdl", "ql": "ql", "elisp": "el",
}
#: Suffixes that get a language but are not parsed.
FILE_ONLY = {
    "twig": "twig", "markdown": "md mdx markdown",
    "eda": "kicad_pcb kicad_sch kicad_pro kicad_mod kicad_sym kicad_wks kicad_dru sch brd lbr dcm net pro plt drl xln gbr gbl gtl gbs gts gbo gto gko gm1 gml",
}
#: File names without suffix that are Ruby.
RUBY_NAMES = "gemfile rakefile guardfile capfile brewfile vagrantfile podfile fastfile appfile matchfile dangerfile berksfile thorfile"
#: Suffixes of files that are never text.
BINARY = (
    "png jpg jpeg gif bmp ico webp tiff svg avif heic pdf mp4 mov avi webm mkv mp3 wav flac ogg m4a woff woff2 ttf otf eot "
    "zip tar gz tgz bz2 xz zst rar 7z jar war ear class so dylib dll exe bin dat wasm node pyc pyo o a lib obj parquet avro orc "
    "db sqlite sqlite3 mdb lock psd ai sketch"
)


def suffix_map() -> dict[str, str]:
    return {s: lang for lang, listed in chain(FILE_ONLY.items(), SUFFIXES.items()) for s in listed.split()}


def detect_language(path: Column) -> Column:
    """The language of a path; ``other`` for unknown text, null for a known binary.

    A name that only begins with a dot has no suffix.
    """
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)
    dotted = name.rlike(r"(?s)^.+\.[^.]*$")
    known = F.create_map(*[F.lit(x) for pair in sorted(suffix_map().items()) for x in pair])
    bare = F.when(name.isin(*RUBY_NAMES.split()), F.lit("ruby")).otherwise(F.lit("other"))
    by_suffix = F.when(suffix.isin(*BINARY.split()), F.lit(None).cast("string")).otherwise(F.coalesce(known[suffix], F.lit("other")))
    return F.when(name.endswith(".blade.php"), F.lit("blade")).when(dotted, by_suffix).otherwise(bare)


#: Languages that an exchanged graph may name.
EXCHANGED = sorted({*SUFFIXES, *FILE_ONLY, "blade", "scss", "svelte", "sql", "graphql", "other"})


def checked_language(language: Column) -> Column:
    """A language of an exchanged graph; unknown ones become ``other``."""
    return F.when(language.isin(*EXCHANGED), language).otherwise(F.lit("other"))
