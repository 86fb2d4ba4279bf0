"""Parsing source text to symbols, imports and calls, and resolving import specifiers to candidate paths.

Python is parsed by its own grammar (``ast``).  Other languages are read in two
steps.  One linear pass blanks comments and literals (each language has its own)
and pairs brackets: a brace closes what is open inside it, other brackets never
reach across a brace.  Then one table of patterns per language finds definitions
with their kind, imports and calls in what is left; how deep a definition lies,
where its head and block end and whether a name before parentheses is a
definition or a call follow from the brackets.  Extraction is less exact than a
full grammar's, but nesting, literals that hold brackets and heads of several
lines don't mislead it.

A file has ``SECONDS``; one that takes longer, or that can't be parsed, yields
nothing but the reason (``failed``), and its neighbours are parsed.

``register`` adds a language.
"""

from __future__ import annotations

import ast
import time
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normalized, parent_dir
from graphloom.operators.model import PARSED


@dataclass(frozen=True)
class Language:
    """``symbols``: (kind, pattern with ``name``); ``imports`` and ``calls``: patterns with one group.

    ``top_only`` keeps definitions that start at the outermost level.
    ``block`` is ``brace``, ``indent``, ``end`` or ``line``.
    """

    symbols: tuple[tuple[str, str], ...] = ()
    imports: tuple[str, ...] = ()
    calls: tuple[str, ...] = ()
    exported: Callable[[str, str], bool] = lambda name, head: True
    top_only: bool = False
    block: str = "brace"
    comment: str = r"//[^\n]*|/\*.*?\*/"


_CALL = (r"\b([A-Za-z_$][\w$]*+)\s*+(?:<[^<>(){};]*+>)?+\(",)
_ID = r"(?P<name>[A-Za-z_$][\w$]*)"
_HASH = r"#[^\n]*"
#: Words before a parenthesis that are no calls.
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "def", "match", "when", "elif", "sizeof", "new", "await", "typeof", "import", "using", "lock", "foreach", "synchronized", "throw", "in", "of", "and", "or", "not"}
#: Those of them that no method is named.
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "sizeof", "new", "using", "lock", "foreach", "synchronized", "throw"}
_IS_EXPORT, _IS_PUBLIC = re.compile(r"\s*export\b"), re.compile(r"\bpublic\b")
_EXPORT = lambda name, head: _IS_EXPORT.match(head) is not None
_PUBLIC = lambda name, head: _IS_PUBLIC.search(head) is not None
_JS_SYMBOLS = (
    ("function", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}"),
    ("class", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_ID}"),
    ("const", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+{_ID}"),
)
_TS_SYMBOLS = (*_JS_SYMBOLS, ("interface", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+{_ID}"), ("type", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+{_ID}\s*[=<]"), ("type", rf"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+{_ID}"))
_JS_IMPORTS = (r"\bimport\s+(?:[^'\";]*?\sfrom\s+)?['\"]([^'\"]+)['\"]", r"\bexport\s+[^'\";]*?\sfrom\s+['\"]([^'\"]+)['\"]", r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]")
_JS = Language(_JS_SYMBOLS, _JS_IMPORTS, _CALL, _EXPORT, True)
_C_FUNCTION = ("function", rf"^[ \t]*(?!(?:return|else|if|while|for|switch|typedef|using|namespace|new|throw|case|goto|delete|do)\b)[A-Za-z_][\w\s\*&:<>,~]*?\b{_ID}\s*\(")
_C_CONST = ("const", rf"^[ \t]*(?!(?:return|else|goto|case|typedef|using)\b)(?:[A-Za-z_]\w*[ \t]+)*[A-Za-z_]\w*[ \t\*]+{_ID}(?:\[[^\]\n]*\])*[ \t]*=(?!=)")
_MODIFIERS = "public|private|protected|internal|static|final|abstract|synchronized|native|default|async|override|virtual|sealed|extern|unsafe|partial|readonly"
_TYPED_METHOD = ("function", rf"(?:^|(?<=[{{}};]))[ \t]*(?!(?:return|new|else|throw|case|assert|package|import|yield|await|goto|using|do)\b)(?:@\w++\s++)*(?:[\w.<>\[\],?]++\s++)*?(?!(?:{_MODIFIERS})\b)[\w.<>\[\],?]++\s++{_ID}\s*\(")
_INCLUDE = (r"^[ \t]*#[ \t]*include\s*([\"<][^\">]+[\">])",)
_DOTTED_IMPORT = (r"^\s*import\s+(?:static\s+)?(\w+(?:\.\w+)*(?:\.\*)?)\s*;?",)

LANGUAGES: dict[str, Language] = {
    "typescript": Language(_TS_SYMBOLS, _JS_IMPORTS, _CALL, _EXPORT, True),
    "javascript": _JS,
    "go": Language((("function", rf"^func\s+(?:\([^)]*\)\s*)?{_ID}"), ("type", rf"^type\s+{_ID}")), (r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$",), _CALL, lambda n, h: n[:1].isupper(), True),
    "rust": Language((("function", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+{_ID}"), ("class", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_ID}"), ("type", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_ID}"), ("interface", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_ID}"), ("const", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?const\s+{_ID}\s*:")), (r"^\s*(?:pub\s+)?use\s+([\w:]+)",), _CALL, lambda n, h: h.lstrip().startswith("pub")),
    "java": Language((("class", rf"\bclass\s+{_ID}"), ("interface", rf"\binterface\s+{_ID}"), ("type", rf"\benum\s+{_ID}"), _TYPED_METHOD), _DOTTED_IMPORT, _CALL, _PUBLIC),
    "c": Language((_C_FUNCTION, ("class", rf"\bstruct\s+{_ID}\s*\{{"), ("type", rf"\b(?:union|enum)\s+{_ID}\s*\{{"), ("type", rf"^\s*typedef\b[^;{{]*\b{_ID}\s*;"), _C_CONST), _INCLUDE, _CALL),
    "cpp": Language((_C_FUNCTION, ("class", rf"\b(?<!\benum\s+)(?:class|struct)\s+{_ID}[^;{{]*\{{"), ("type", rf"\b(?:union|enum(?:\s+(?:class|struct))?)\s+{_ID}[^;{{]*\{{")), _INCLUDE, (r"(?:\b[\w]+::)*\b([A-Za-z_]\w*)\s*\(",)),
    "csharp": Language((("class", rf"\b(?:class|struct)\s+{_ID}"), ("interface", rf"\binterface\s+{_ID}"), ("type", rf"\benum\s+{_ID}"), ("function", rf"\bdelegate\s+[\w<>\[\],.?]+\s+{_ID}\s*(?:<[^>]*>)?\s*(?=\()"), _TYPED_METHOD, ("const", rf"^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|abstract|required)\s+)+[\w<>\[\],.?]+\s+{_ID}\s*\{{\s*(?:(?:private|protected|internal)\s+)?(?:get|set|init)\b")), (r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",), _CALL, _PUBLIC),
    "kotlin": Language((("class", rf"\b(?:class|object)\s+{_ID}"), ("function", rf"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_ID}\s*\("), ("const", rf"^[ \t]*(?:\w+\s+)*va[lr]\s+{_ID}"), ("type", rf"\btypealias\s+{_ID}")), (r"^\s*import\s+([\w.]+)",), _CALL, _PUBLIC),
    "ruby": Language((("function", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!]?)"), ("class", r"^\s*(?:class|module)\s+(?P<name>\w+)")), (r"^\s*require(?:_relative)?\s*\(?['\"]([^'\"]+)['\"]",), (r"\b([a-z_]\w*[?!]?)\s*\(",), block="end", comment=_HASH),
    "php": Language((("function", rf"\bfunction\s+&?{_ID}"), ("class", rf"\b(?:class|trait)\s+{_ID}"), ("interface", rf"\binterface\s+{_ID}"), ("type", rf"\benum\s+{_ID}"), ("const", rf"\bconst\s+{_ID}\s*=")), (r"\b(?:include|require)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]", r"^\s*use\s+([\w\\]+)"), _CALL, comment=r"//[^\n]*|#[^\n\[]*|/\*.*?\*/"),
    "swift": Language((("function", rf"\bfunc\s+{_ID}"), ("class", rf"\b(?:class|struct)\s+{_ID}"), ("interface", rf"\bprotocol\s+{_ID}")), (r"^\s*import\s+(\w+)",), _CALL),
    "scala": Language((("class", rf"\b(?:class|object)\s+{_ID}"), ("interface", rf"\btrait\s+{_ID}"), ("function", rf"\bdef\s+{_ID}")), (r"^\s*import\s+([\w.]+)",), _CALL),
    "dart": Language((("class", rf"\b(?:class|enum|mixin)\s+{_ID}"), ("function", rf"^[ \t]*(?:[\w<>?]+\s+)+{_ID}\s*\([^;]*\)\s*(?:async\s*)?\{{")), (r"^\s*(?:import|export)\s+['\"]([^'\"]+)['\"]",)),
    "zig": Language((("function", rf"\bfn\s+{_ID}"), ("const", rf"^\s*(?:pub\s+)?(?:const|var)\s+{_ID}")), (r"@import\(\"([^\"]+)\"\)",), _CALL, comment=r"//[^\n]*"),
    "lua": Language((("function", r"\bfunction\s+(?P<name>[\w.:]+)"),), top_only=True, block="end", comment=r"--[^\n]*"),
    "r": Language((("function", r"^\s*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\b"),), (), _CALL, comment=_HASH),
    "elixir": Language((("function", r"^\s*defp?\s+(?P<name>\w+[?!]?)"), ("function", r"^\s*defmodule\s+(?P<name>[\w.]+)")), (), (r"\b([a-z_]\w*[?!]?)\(",), block="end", comment=_HASH),
    "elm": Language((("function", r"^(?!(?:type|import|module|port)\b)(?P<name>[a-z]\w*)(?:\s+[\w_]+)*\s*="), ("type", r"^type\s+(?:alias\s+)?(?P<name>\w+)")), (r"^import\s+([\w.]+)",), (), block="indent", comment=r"--[^\n]*"),
    "ocaml": Language((("const", r"^\s*let\s+(?:rec\s+)?(?P<name>\w+)"), ("class", r"^\s*class\s+(?P<name>\w+)")), (r"^\s*(?:open|include)\s+([\w.]+)",), block="indent", comment=r"\(\*.*?\*\)"),
    "rescript": Language((("const", r"^\s*let\s+(?:rec\s+)?(?P<name>\w+)"), ("class", r"^\s*module\s+(?P<name>\w+)")), (r"^\s*open\s+([\w.]+)",)),
    "solidity": Language((("class", rf"\bcontract\s+{_ID}"),), (r"^\s*import\s+(?:[^'\";]*\sfrom\s+)?['\"]([^'\"]+)['\"]",), _CALL),
    "objc": Language((("class", r"^\s*@(?:interface|implementation)\s+(?P<name>\w+)"),), (r"^[ \t]*#[ \t]*(?:import|include)\s*([\"<][^\">]+[\">])",), block="line"),
    "bash": Language((("function", r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)"), ("const", r"^(?:export\s+|readonly\s+)?(?P<name>[A-Za-z_]\w*)=")), (r"^\s*(?:source|\.)\s+['\"]?([^'\"\s;]+)",), (r"^\s*([\w-]+)\b(?!=|\s*\(\))",), top_only=True, comment=r"(?<!\S)#[^\n]*"),
    "css": Language((("type", r"(?P<name>[.#][A-Za-z_-][\w-]*)(?=[^{};]*\{)"), ("type", r"^(?P<name>[a-z][a-z0-9]*)(?=[^{};]*\{)")), comment=r"/\*.*?\*/"),
    "json": Language((("const", r'^(?:  |\t)"(?P<name>[^"]+)"\s*:'),), block="line", comment=r"(?!)"),
    "yaml": Language((("const", r"^(?P<name>[\w.-]+)\s*:"),), block="indent", comment=_HASH),
    "toml": Language((("class", r"^\s*\[+(?P<name>[^\]]+)\]+"), ("const", r"^(?P<name>[\w.-]+)\s*=")), block="line", comment=_HASH),
    "ql": Language((("class", rf"\b(?:class|module)\s+{_ID}"), ("function", rf"^[ \t]*(?:predicate|[\w:]+)\s+{_ID}\s*\([^;]*\)\s*\{{")), (r"^\s*import\s+([\w.]+)",)),
    "elisp": Language((("function", r"\(defun\s+(?P<name>[^\s()]+)"), ("const", r"\(def(?:var|const|custom)\s+(?P<name>[^\s()]+)")), (r"\(require\s+'([\w-]+)",), block="line", comment=r";[^\n]*"),
    **{name: Language() for name in ("vue", "html", "embedded_template", "systemrdl", "tlaplus")},
}
#: Languages that are not parsed unless asked for.
DISABLED = {"swift"}


def register(name: str, language: Language) -> None:
    LANGUAGES[name] = language


_SPACE, _HEAD, _MARGIN = re.compile(r"\s+"), re.compile(r"[^{\n]*"), re.compile(r"[ \t]*")


def short_signature(text: str) -> str:
    flat = _SPACE.sub(" ", _HEAD.match(text)[0]).strip()
    return flat if len(flat) <= 200 else flat[:197] + "…"


#: Seconds that a file may take, and files whose results are held at once.
SECONDS, PARSED_AT_ONCE = 20.0, 500
_STRING, _LONG_STRING, _CHAR = r'"(?:\\.|[^"\\\n])*+"', r'"(?:\\[\s\S]|[^"\\])*+"', r"'(?:\\[^\n][^'\n]{0,8}|[^'\\\n])'"
_QUOTED, _LONG_QUOTED = r"'(?:\\.|[^'\\\n])*+'", r"'(?:\\[\s\S]|[^'\\])*+'"
_TRIPLE, _BACKTICK = r'"""[\s\S]*?"""', r"`(?:\\[\s\S]|[^`\\])*+`"
_DOCUMENT = r"<<[<~-]?[ \t]*(?P<mark>['\"]?)(?P<doc>[A-Z_]\w*)(?P=mark)[^\n]*\n[\s\S]*?\n[ \t]*(?P=doc)\b"
_PATTERN = r"(?<=[=(,:\[!&|?;{}\n][ \t]*|\breturn[ \t]+)/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/"
_SCRIPT = (_STRING, _QUOTED, _BACKTICK, _PATTERN)
#: What a language's literals look like; strings in either quotes and backticks unless given.
LITERALS = {
    "typescript": _SCRIPT, "javascript": _SCRIPT, "go": (_STRING, r"`[^`]*+`", _CHAR), "c": (_STRING, _CHAR), "zig": (_STRING, _CHAR), "ocaml": (_LONG_STRING, _CHAR), "elm": (_TRIPLE, _STRING, _CHAR),
    "rust": (r'\bb?r(?P<hashes>#*)"[\s\S]*?"(?P=hashes)', _LONG_STRING, _CHAR), "cpp": (r'R"(?P<tag>[^()\\\s]{0,16})\([\s\S]*?\)(?P=tag)"', _STRING, r"(?<!\d)" + _CHAR),
    "java": (_TRIPLE, _STRING, _CHAR), "kotlin": (_TRIPLE, _STRING, _CHAR), "scala": (_TRIPLE, _STRING, _CHAR), "swift": (_TRIPLE, _STRING), "csharp": (r'\$?@\$?"(?:""|[^"])*+"', _TRIPLE, _STRING, _CHAR),
    "php": (_DOCUMENT, _LONG_STRING, _LONG_QUOTED), "ruby": (_DOCUMENT, _LONG_STRING, _LONG_QUOTED), "bash": (_DOCUMENT, _LONG_STRING, _LONG_QUOTED), "lua": (r"\[(?P<eq>=*)\[[\s\S]*?\](?P=eq)\]", _STRING, _QUOTED), "elisp": (_LONG_STRING,),
}
_NESTED = r"//[^\n]*|(?P<nested>/\*(?:[^*/]++|\*(?!/)|/(?!\*)|(?&nested))*+(?:\*/|\Z))"
#: Comments that differ from what the table of languages says: those that nest.
COMMENTS = {name: _NESTED for name in ("rust", "kotlin", "swift", "scala", "dart")} | {"lua": r"--\[(?P<level>=*)\[[\s\S]*?\](?P=level)\]|--[^\n]*"}
#: Languages in which a line's end doesn't end a statement, and those in which a body after parentheses makes a definition.
SEMICOLONS = {"c", "cpp", "java", "csharp", "rust", "php", "solidity", "dart", "zig", "ql"}
BODIED = {"typescript", "javascript", "java", "csharp", "c", "cpp", "php", "dart", "solidity"}
TYPED = {"java", "csharp", "c", "cpp", "dart"}
_AFTER_HEAD = r"(?:\s|\bthrows\b[\w\s,.]++|\b(?:const|noexcept|override|final|async)\b|->[\w:<>&*\s]++|\bwhere\b[^{};]++|:\s*\w[\w.<>\[\]|,:()\s]*+)*+"
_BODY = re.compile(_AFTER_HEAD + r"\{")
#: What makes a typed head a definition: a body, an arrow, in Java and C# a semicolon too.
_DEFINES = {name: re.compile(_AFTER_HEAD + (r"(?:\{|=>|;)" if name in ("java", "csharp") else r"(?:\{|=>)")) for name in TYPED}
_BEFORE = re.compile(r"(?:^|[{};(\n])[ \t]*(?P<words>(?:[\w@]+[ \t]+)*)$")
#: Words before a name with parentheses that say it is defined there, and those that may stand before a call.
_DEFINING, _CALLING = re.compile(r"\b(?:fn|fun|func|function|def|defp|sub)\s+$"), re.compile(r"\b(?:return|new|else|throw|await|yield|case|in|do|and|or|not|delete|goto|is|as|when|assert|co_return|co_await)\s+$")
_TYPE_BEFORE = re.compile(r"(?:[\w\]]|\w>)\s+$")
_BRACKET, _STOP, _UNDONE = re.compile(r"[()\[\]{}]"), re.compile(r"[({\[;\n})\]]"), re.compile(r"(?:[,=(&|?:+*.\[-]|=>)\s*$")
_OPENER = {")": "(", "]": "[", "}": "{"}
_GOES_ON = re.compile(r"\s*(?:[{.:,=&|?)\]+*<>-]|(?:where|extends|implements|throws|with|as)\b)")


@lru_cache(maxsize=None)
def _compiled(pattern: str) -> re.Pattern:
    """Of each pattern once: the library's own cache takes longer to look up than most patterns to run."""
    return re.compile(pattern, re.M)


def _blank(text: str) -> str:
    """Spaces for all but line breaks."""
    return " " * len(text) if "\n" not in text else "\n".join(" " * len(line) for line in text.split("\n"))


@lru_cache(maxsize=None)
def _hidden(name: str, comment: str) -> re.Pattern:
    return re.compile(f"(?P<literal>{'|'.join(LITERALS.get(name, (_STRING, _QUOTED, _BACKTICK)))})|(?:{COMMENTS.get(name, comment)})", re.S if name not in COMMENTS else 0)


class Code:
    """A text with comments and literals blanked (``code``), or comments alone (``told``), and its brackets in pairs."""

    def __init__(self, name: str, language: Language, text: str, seconds: float = SECONDS):
        self.name, self.language, self.text, self.until = name, language, text, time.monotonic() + seconds
        code, told, at = [], [], 0
        for m in _hidden(name, language.comment).finditer(text, timeout=seconds):
            blank = _blank(m[0])
            code += [text[at : m.start()], blank]
            told += [text[at : m.start()], blank if m["literal"] is None else m[0]]
            at = m.end()
        self.code, self.told = "".join([*code, text[at:]]), "".join([*told, text[at:]])
        self.breaks, at = [], text.find("\n")
        while at >= 0:
            self.breaks.append(at)
            at = text.find("\n", at + 1)
        self.partner: dict[int, int] = {}
        self.places, self.depths, stack, n_open = [], [], [], {"(": 0, "[": 0, "{": 0}
        for m in _BRACKET.finditer(self.code):
            c, at = m[0], m.start()
            if c in n_open:
                stack.append((c, at))
                n_open[c] += 1
            else:
                opener = _OPENER[c]
                k = len(stack) - 1
                while n_open[opener] and k >= 0 and stack[k][0] != opener and (c == "}" or stack[k][0] != "{"):
                    k -= 1
                if not n_open[opener] or k < 0 or stack[k][0] != opener:
                    continue  # closes nothing
                for inner, place in stack[k:]:
                    self.partner[place] = at
                    n_open[inner] -= 1
                del stack[k:]
            self.places.append(at)
            self.depths.append(len(stack))
        self.partner.update((at, len(text)) for _, at in stack)

    def found(self, pattern: str, source: str):
        """Matches, within the time that is left."""
        return _compiled(pattern).finditer(source, timeout=max(0.001, self.until - time.monotonic()))

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def depth(self, at: int) -> int:
        """How many brackets are open before a place."""
        k = bisect_left(self.places, at)
        return self.depths[k - 1] if k else 0

    def has_body(self, at: int, after: re.Pattern | None = None) -> bool:
        """Whether a body (or what ``after`` says) follows the parentheses that open at a place."""
        close = self.partner.get(at)
        return close is not None and (after or _BODY).match(self.code, close + 1, close + 400) is not None

    def begin(self, at: int) -> int:
        """Where a definition begins on its line, with the modifiers before it."""
        before = _BEFORE.search(self.code, max(0, self.code.rfind("\n", 0, at)), at)
        return before.start("words") if before else at

    def end(self, at: int, kind: str) -> int:
        """Where the definition that begins at a place ends: with its block, its semicolon, or a line that nothing goes on from."""
        code, i = self.code, at
        while m := _STOP.search(code, i):
            c, i = m[0], m.start()
            if c in "([" or c == "{" and kind == "const" and self.name != "csharp":
                i = self.partner[i] + 1
            elif c == "{":
                return min(self.partner[i], len(code) - 1)
            elif c == ";":
                return i
            elif c in "})]":
                return max(at, len(code[:i].rstrip()) - 1) if i - at < 2000 else i
            elif self.name not in SEMICOLONS and not _GOES_ON.match(code, i) and not _UNDONE.search(code, max(at, i - 80), i):
                return i
            else:
                i += 1
        return len(code) - 1


def _margin_end(code: str, at: int, style: str) -> int:
    """Where a definition ends whose block is what stands further in (``indent``; ``end``: and its closing line), or its line."""
    line_end = code.find("\n", at)
    line_end = len(code) if line_end < 0 else line_end
    if style not in ("indent", "end"):
        return line_end
    begin = code.rfind("\n", 0, at) + 1
    margin = _MARGIN.match(code, begin).end() - begin
    last, pos = line_end, line_end + 1
    while pos < len(code):
        stop = code.find("\n", pos)
        stop = len(code) if stop < 0 else stop
        line = code[pos:stop]
        if line.strip():
            inner = len(line) - len(line.lstrip(" \t"))
            if inner <= margin:
                return stop if style == "end" and line.strip().startswith("end") else last
            last = stop
        pos = stop + 1
    return last


#: What is read from a file, and the fields of a symbol.
PARTS = ("symbols", "imports", "calls")
SYMBOL = ("name", "kind", "signature", "start_line", "end_line", "exported")


def parse_text(language: str, text: str, seconds: float = SECONDS) -> dict:
    """``symbols``, ``imports`` and ``calls`` of one file, and ``failed``: why there are none."""
    symbols, imports, calls, failed = _read(language, text, seconds)
    return {"symbols": [dict(zip(SYMBOL, s, strict=True)) for s in symbols], "imports": imports, "calls": [{"callee": c, "line": n} for c, n in calls], "failed": failed}


def _read(language: str, text: str, seconds: float, parts: tuple[str, ...] = PARTS) -> tuple[list, list, list, str | None]:
    """Tuples of symbols in order of their lines, imports, tuples of calls, and why there are none; what isn't among ``parts`` may be left out."""
    try:
        symbols, imports, calls = _python(text) if language == "python" else _patterns(Code(language, LANGUAGES[language], text, seconds), parts)
        return sorted(symbols, key=lambda s: s[3]), list(imports), calls, None
    except TimeoutError:
        reason = "time"
    except (SyntaxError, ValueError, KeyError, RecursionError, MemoryError) as error:
        reason = type(error).__name__
    return [], [], [], reason


def _python(text: str) -> tuple[list, dict, list]:
    tree, lines = ast.parse(text), text.split("\n")
    symbols, imports, calls = [], {}, []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            symbols.append((node.name, kind, short_signature(lines[node.lineno - 1]), node.lineno, node.end_lineno, not node.name.startswith("_")))
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports.update(dict.fromkeys(a.name for a in node.names))
        elif isinstance(node, ast.ImportFrom):
            imports["." * node.level + (node.module or "")] = None
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                calls.append((name, node.lineno))
    return symbols, imports, sorted(calls, key=lambda c: c[1])


def _patterns(tree: Code, parts: tuple[str, ...]) -> tuple[list, dict, list]:
    language, name, text, code = tree.language, tree.name, tree.text, tree.code
    symbols, seen, defined = [], set(), set()
    for kind, pattern in language.symbols:
        source = tree.told if '"' in pattern else code
        for m in tree.found(pattern, source):
            at = tree.begin(m.start() + len(m[0]) - len(m[0].lstrip()))
            opens = m.end() - 1 if m[0].endswith("(") else None
            if kind == "function" and name in TYPED and opens is not None:
                if m["name"] in _CONTROL or not tree.has_body(opens, _DEFINES[name]):
                    continue
            defined.add(m.start("name"))
            if "symbols" not in parts:
                continue
            if language.top_only and (tree.depth(at) > 0 or language.block != "brace" and at != source.rfind("\n", 0, at) + 1):
                continue
            start = tree.line(at)
            if (m["name"], start) in seen:
                continue
            seen.add((m["name"], start))
            stop = text.find("\n", at)
            head = text[at : stop if stop >= 0 else len(text)]
            end = tree.end(at, kind) if language.block == "brace" else _margin_end(source, at, language.block)
            symbols.append((m["name"], kind, short_signature(text[at : at + 1000]), start, max(start, tree.line(end)), language.exported(m["name"], head)))
    imports: dict[str, None] = {}
    for pattern in language.imports if "imports" in parts else ():
        imports.update(dict.fromkeys(s for m in tree.found(pattern, tree.told) if (s := m[1].strip())))
    calls = []
    for pattern in language.calls if "calls" in parts else ():
        for m in tree.found(pattern, code):
            at = m.start(1)
            before = code[max(0, at - 40) : at]
            if m[1] in _NOT_CALLS or at in defined or _DEFINING.search(before):
                continue
            if m[0].endswith("(") and not _CALLING.search(before):
                if name in BODIED and tree.has_body(m.end() - 1) or name in TYPED and _TYPE_BEFORE.search(before):
                    continue  # a method, or what is only declared
            calls.append((m[1], at))
    return symbols, imports, [(c, tree.line(at)) for c, at in sorted(set(calls), key=lambda c: c[1])]


def parse_files(files: DataFrame, enabled: set[str] | None = None, seconds: float = SECONDS, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """``sha, language, symbols, imports, calls, failed``: each distinct content of a language is parsed once, for ``parts``; the others are empty."""
    wanted = ((set(LANGUAGES) | {"python"}) - DISABLED) | (enabled or set())

    kinds = {"symbols": [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()], "calls": [pa.string(), pa.int32()]}
    names = {"symbols": SYMBOL, "calls": ("callee", "line")}

    def listed(of: str, lists: list[list[tuple]]) -> pa.Array:
        ends = list(accumulate(map(len, lists), initial=0))
        columns = list(zip(*chain.from_iterable(lists), strict=True)) or [()] * len(kinds[of])
        fields = [pa.array(c, kind) for c, kind in zip(columns, kinds[of], strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names[of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            first = [k for k, key in enumerate(keys) if key != (keys[k - 1] if k else last)]
            last = keys[-1] if keys else last
            for i in range(0, len(first), PARSED_AT_ONCE):
                part = batch.take(pa.array(first[i : i + PARSED_AT_ONCE], pa.int64()))
                found = [_read(lang.as_py(), text.as_py() or "", seconds, parts) for lang, text in zip(part.column(1), part.column(2), strict=True)]
                symbols, imports, calls = ([f[k] if of in parts else [] for f in found] for k, of in enumerate(PARTS))
                failed = [f[3] for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), listed("symbols", symbols), pa.array(imports, pa.list_(pa.string())), listed("calls", calls), pa.array(failed, pa.string())], ["sha", "language", "symbols", "imports", "calls", "failed"])

    # Equal contents come one after the other, so the first of them is parsed; contents move and are sorted once.
    # Parsing takes far longer than its bytes tell, so the number of tasks is given: else small ones are put together.
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo = files.where(F.col("language").isin(sorted(wanted))).select("sha", "language", "content")
    dealt = todo.repartition(n, "sha", "language").sortWithinPartitions("sha", "language")
    return dealt.mapInArrow(run, f"sha string, language string, {PARSED}, failed string")


def tables(files: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``symbols`` (with ``pos``), ``raw_imports`` and ``raw_calls`` by file id."""
    joined = files.select(F.col("id").alias("file_id"), "sha", "language").join(parsed, ["sha", "language"])
    symbols = joined.select("file_id", F.posexplode("symbols").alias("pos", "s")).select("file_id", "pos", "s.*")
    calls = joined.select("file_id", F.posexplode("calls").alias("n", "c")).select(F.concat_ws("-", "file_id", "n").alias("call_id"), "file_id", "c.callee", "c.line")
    return symbols, joined.select("file_id", F.explode("imports").alias("specifier")), calls


#: What is tried, in order, after a specifier's own path.
TRIED = {
    "typescript": ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"],
    "javascript": ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"],
    "c": ["", ".h", ".c"], "cpp": ["", ".hpp", ".h", ".cpp"], "objc": ["", ".h", ".m", ".mm"], "ruby": [".rb", ""], "php": [".php", ".inc", ""],
    "zig": [".zig", ""], "solidity": ["", ".sol"], "bash": [".sh", ".bash", ""], "dart": ["", ".dart"], "elisp": ["", ".el"], "lua": [".lua", ""],
}


def candidates(language: Column, path: Column, specifier: Column) -> Column:
    """Paths to try for an import, in order."""
    here = parent_dir(path)
    bare = F.regexp_replace(specifier, r'^["<]|[">]$', "")
    beside = normalized(F.concat(here, F.lit("/"), bare))
    none = F.array().cast("array<string>")

    def tried(base: Column, endings: list[str]) -> Column:
        return F.array(*[F.concat(base, F.lit(e)) for e in endings])

    relative = bare.startswith(".")
    script = F.when(relative, F.concat(tried(beside, TRIED["typescript"]), tried(F.regexp_replace(beside, r"\.[cm]?jsx?$", ""), [".ts", ".tsx"]))).otherwise(tried(normalized(bare), TRIED["typescript"]))
    # Python: n dots go n - 1 folders up.
    dots = F.length(F.regexp_extract(specifier, r"^\.*", 0))
    rest = F.replace(F.regexp_replace(specifier, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.concat(here, F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))))
    module = normalized(F.when(dots > 0, F.concat(up, F.lit("/"), rest)).otherwise(rest))
    python = F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")))
    crate = F.replace(F.regexp_replace(specifier, "^(crate|self|super)::", ""), F.lit("::"), F.lit("/"))
    rust_ends = [".rs", "/mod.rs", "/index.rs"]
    rust = F.concat(tried(normalized(F.concat(here, F.lit("/"), crate)), rust_ends), tried(crate, rust_ends))
    slashed = F.replace(F.regexp_replace(specifier, r"\.\*$", ""), F.lit("."), F.lit("/"))
    package = lambda e: F.array(F.concat(slashed, F.lit(e)))
    out = F.when(language.isin("typescript", "javascript"), script).when(language == "python", python).when(language == "rust", rust)
    for name, ending in (("java", ".java"), ("kotlin", ".kt"), ("scala", ".scala"), ("csharp", ".cs"), ("elm", ".elm"), ("ql", ".ql")):
        out = out.when(language == name, package(ending))
    for name in ("c", "cpp", "objc", "ruby", "solidity", "bash", "zig", "elisp", "php"):
        out = out.when(language == name, tried(beside, TRIED[name]))
    dart = F.when(bare.startswith("package:"), F.regexp_replace(bare, "^package:[^/]*/", "")).otherwise(beside)
    return out.when(language == "dart", tried(dart, TRIED["dart"])).when(language == "lua", tried(slashed, TRIED["lua"])).when(language == "tlaplus", tried(bare, [".tla"])).otherwise(none)
