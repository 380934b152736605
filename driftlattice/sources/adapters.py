"""Feature records out of source files, by one lexer and a table of rules for each language.

No parser library is needed: comments and string contents are blanked out at the same places, brackets are matched in
what is left, and the constructs are found by patterns over it. Spans follow the construct to its closing bracket. What
is approximate: a construct's span ends with its own brackets or line, and macros are not expanded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from driftlattice.functions.scalars import string_content

RECORD = (
    "path string, language string, imports array<string>, exports array<string>, signatures array<string>, "
    "pattern_hints array<struct<node_kind:string,start_byte:bigint,end_byte:bigint,start_row:bigint,start_col:bigint,text:string>>"
)
CLOSERS = {"(": ")", "[": "]", "{": "}"}


class Source:
    """A text, its blanked copy, and the places of matching brackets."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.strings: list[tuple[int, int]] = []
        self.plain = self._blank()
        self.match = self._brackets()
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def _blank(self) -> str:
        text, out, i = self.text, list(self.text), 0
        hashes = self.language == "python"
        quotes = "\"'" if hashes else "\"'`" if self.language in ("typescript", "javascript", "go") else "\""
        while i < len(text):
            c, end, inner = text[i], i, False
            if hashes and c == "#" or not hashes and text.startswith("//", i):
                end = text.find("\n", i)
                end = len(text) if end < 0 else end
            elif not hashes and text.startswith("/*", i):
                end = text.find("*/", i + 2)
                end = len(text) if end < 0 else end + 2
            elif hashes and text[i : i + 3] in ('"""', "'''"):
                end = text.find(text[i : i + 3], i + 3)
                end, inner = (len(text) if end < 0 else end + 3), True
            elif self.language == "rust" and (m := re.compile(r'r(#*)"').match(text, i)) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")):
                end = text.find('"' + m[1], m.end())
                end, inner = (len(text) if end < 0 else end + 1 + len(m[1])), True
            elif self.language in ("rust", "java") and c == "'":
                m = re.compile(r"'(?:\\.[^']*|[^\\'])'").match(text, i)
                end, inner = (m.end(), True) if m else (i, False)
            elif c in quotes:
                end, inner = i + 1, True
                while end < len(text) and text[end] != c and not (text[end] == "\n" and c in "\"'" and self.language != "rust"):
                    end += 2 if text[end] == "\\" and not (c == "`" and self.language == "go") else 1
                end = min(end + 1, len(text))
            if end > i:
                if inner:
                    self.strings.append((i, end))
                for k in range(i + inner, end - inner):
                    out[k] = "\n" if text[k] == "\n" else " "
                i = end
            else:
                i += 1
        return "".join(out)

    def _brackets(self) -> dict[int, int]:
        stack, out = [], {}
        for i, c in enumerate(self.plain):
            if c in "([{":
                stack.append(i)
            elif c in ")]}":
                while stack and CLOSERS[self.plain[stack[-1]]] != c:
                    stack.pop()
                if stack:
                    out[stack.pop()] = i
        return out

    def close(self, at: int) -> int:
        """The place after the bracket that closes the one at `at`."""
        return self.match.get(at, len(self.text) - 1) + 1

    def after_block(self, at: int) -> int:
        """The place after the next block in braces (or statement) from `at`."""
        i = at
        while i < len(self.plain):
            c = self.plain[i]
            if c == "{":
                return self.close(i)
            if c in "([":
                i = self.close(i)
                continue
            if c == ";":
                return i + 1
            i += 1
        return len(self.plain)

    def indented(self, at: int) -> int:
        """The end of the Python statement that begins at `at`, with its suite."""
        start = self.plain.rfind("\n", 0, at) + 1
        depth = len(re.match(r"[ \t]*", self.plain[start:])[0])
        end = at
        for m in re.compile(r"[^\n]*\n?").finditer(self.plain, self.plain.find("\n", at) + 1 or len(self.plain)):
            line = m[0]
            if not line:
                break
            if line.strip() and len(re.match(r"[ \t]*", line)[0]) <= depth and line.strip()[0] not in ")]}":
                break
            end = m.end() if line.strip() else end
        first = self.plain.find("\n", at)
        first = len(self.plain) if first < 0 else first
        return max(len(self.text[: max(end, first)].rstrip()), at + 1)

    def literal(self, at: int) -> str | None:
        """The content of the string that begins at or after `at`, over spaces only."""
        at += len(self.plain[at:]) - len(self.plain[at:].lstrip())
        return next((string_content(self.text[a:b]) for a, b in self.strings if a == at), None)

    def hint(self, kind: str, start: int, end: int) -> dict:
        before = self.text[:start]
        row = before.count("\n")
        raw = self.text[start:end].encode()
        return {
            "node_kind": kind,
            "start_byte": len(before.encode()),
            "end_byte": len(before.encode()) + len(raw),
            "start_row": row,
            "start_col": len(before[before.rfind("\n") + 1 :].encode()),
            "text": raw[:256].decode("utf-8", "ignore"),
        }


def chain_start(plain: str, at: int) -> int:
    """Where the receiver chain begins whose call's bracket stands at `at` (names, dots and closed brackets)."""
    i = at
    while i > 0:
        c = plain[i - 1]
        if c.isalnum() or c in "_$.?!":
            i -= 1
        elif c in ")]":
            depth, i = 1, i - 1
            while i > 0 and depth:
                i -= 1
                depth += (plain[i] in ")]") - (plain[i] in "([")
        elif c == ":" and plain[i - 2 : i] == "::":
            i -= 2
        else:
            break
    return i


NOT_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "match", "func", "super", "constructor", "print_", "elif", "and", "or", "not", "in", "def", "class", "select", "go", "defer", "except", "lambda", "async", "await"}


def calls(s: Source, kind: str):
    for at in (m.start() for m in re.finditer(r"(?<=[\w\])$>])\(", s.plain)):
        start = chain_start(s.plain, at)
        name = s.plain[start:at]
        head = s.plain[max(0, start - 12) : start].rstrip()
        if not name.strip() or re.split(r"\W", name)[-1] in NOT_CALLS or re.search(r"\b(function|func|def|class|new)\*?$", head):
            continue
        end = s.close(at)
        if s.language in ("typescript", "javascript") and re.match(r"\s*(?::[^={;]+)?\{", s.plain[end:]) and "." not in name and head[-1:] in ("", "{", "}", ";"):
            continue  # a method's own declaration
        yield s.hint(kind, start, end)


@dataclass
class Rules:
    language: str
    extensions: tuple[str, ...]
    #: node kind, pattern (group 0 begins the span), how the span ends: block, line, bracket or match
    hints: list[tuple[str, str, str]] = field(default_factory=list)
    call: str | None = None


TS_HINTS = [
    ("try_statement", r"\btry\s*(?=\{)", "try"),
    ("await_expression", r"\bawait\b", "line"),
    ("arrow_function", r"(?:\basync\s+)?(?:\([^()]*\)|\b[\w$]+)(?:\s*:\s*[\w<>\[\]. |]+)?\s*=>", "arrow"),
    ("decorator", r"(?<![\w.])@[\w$.]+", "call"),
    ("generator_function", r"(?<=[=(,:])\s*function\s*\*", "block"),
    ("generator_function_declaration", r"(?m)^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?(?=function\s*\*)", "block"),
    ("abstract_class_declaration", r"\babstract\s+class\s+\w+", "block"),
    ("class_declaration", r"(?<!abstract )(?<![=(,] )\bclass\s+\w+", "block"),
    ("interface_declaration", r"\binterface\s+\w+", "block"),
    ("optional_chain", r"\?\.(?!\d)", "match"),
    ("non_null_expression", r"[\w$\])]!(?=[.;,)\]\s])(?!\s*=)", "match"),
]
LANGUAGES = (
    Rules(
        "rust",
        (".rs",),
        [
            ("try_expression", r"\?(?=\s*[;.,)\]}?])", "try_operator"),
            ("match_expression", r"\bmatch\b(?!\s*[,;=)])", "block"),
            ("macro_invocation", r"\b[\w:]+!\s*(?=[(\[{])", "bracket"),
            ("await_expression", r"\.await\b", "await"),
            ("closure_expression", r"(?:\bmove\s*)?(?<![|\w)])\|[^|\n]*\|(?!\|)", "line"),
            ("impl_item", r"(?m)^\s*(?:unsafe\s+)?impl\b", "block"),
        ],
    ),
    Rules(
        "python",
        (".py",),
        [
            ("try_statement", r"(?m)^[ \t]*try\s*:", "suite"),
            ("except_clause", r"(?m)^[ \t]*except\b[^\n]*:", "suite"),
            ("with_statement", r"(?m)^[ \t]*(?:async\s+)?with\b", "suite"),
            ("await", r"\bawait\b", "line"),
            ("lambda", r"\blambda\b", "line"),
            ("decorated_definition", r"(?m)^[ \t]*@[\w.]+[^\n]*(?:\n[ \t]*@[^\n]*)*", "decorated"),
            ("class_definition", r"(?m)^[ \t]*class\s+\w+", "suite"),
        ],
        "call",
    ),
    Rules("typescript", (".ts", ".tsx"), TS_HINTS, "call_expression"),
    Rules("javascript", (".js", ".mjs"), [h for h in TS_HINTS if h[0] not in ("abstract_class_declaration", "interface_declaration", "non_null_expression")], "call_expression"),
    Rules(
        "go",
        (".go",),
        [
            ("go_statement", r"\bgo\s+(?=\w)", "line"),
            ("defer_statement", r"\bdefer\s+(?=\w)", "line"),
            ("select_statement", r"\bselect\s*(?=\{)", "block"),
            ("type_switch_statement", r"\bswitch\b[^{\n]*\.\(type\)", "block"),
        ],
        "call_expression",
    ),
    Rules(
        "java",
        (".java",),
        [
            ("try_with_resources_statement", r"\btry\s*(?=\()", "try"),
            ("try_statement", r"\btry\s*(?=\{)", "try"),
            ("catch_clause", r"\bcatch\s*(?=\()", "block"),
            ("lambda_expression", r"(?:\([^()]*\)|\b\w+)\s*->", "line"),
            ("enhanced_for_statement", r"\bfor\s*\([^;()]*:[^;]*\)", "block"),
            ("throw_statement", r"\bthrow\b", "line"),
            ("class_declaration", r"(?m)^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*class\s+\w+", "block"),
            ("interface_declaration", r"(?m)^[ \t]*(?:(?:public|private|protected|static|abstract|sealed)\s+)*interface\s+\w+", "block"),
        ],
    ),
)
BY_EXTENSION = {e: r for r in LANGUAGES for e in r.extensions}


@dataclass
class Adapter:
    """A language of the user's own. parse(path, text) gives some of imports, exports, signatures (lists of texts) and
    pattern_hints (dicts with node_kind, text and the span's place); what it leaves out is empty."""

    language: str
    extensions: tuple[str, ...]
    parse: Callable[[str, str], dict]


def languages_by_extension(adapters: Iterable[Adapter] = ()) -> dict[str, str]:
    """The language of each extension; the first adapter that names an extension has it, the user's before the own ones."""
    out: dict[str, str] = {}
    for x in (*adapters, *LANGUAGES):
        for e in x.extensions:
            out.setdefault(e, x.language)
    return out


def statement_end(s: Source, at: int) -> int:
    """The end of an expression: the closing bracket around it, or the end of its statement."""
    i = at
    while i < len(s.plain):
        c = s.plain[i]
        if c in "([{":
            i = s.close(i)
            continue
        if c in ")]},;" or c == "\n" and s.language in ("python", "go"):
            return i
        i += 1
    return len(s.plain)


def span_end(s: Source, m: re.Match, how: str) -> int:
    end = m.end()
    if how == "block":
        return s.after_block(end)
    if how == "try":
        end = s.after_block(end)
        while n := re.compile(r"\s*(?:catch|finally)\b").match(s.plain, end):
            end = s.after_block(n.end())
        return end
    if how == "bracket":
        return s.close(end)
    if how == "call":
        return s.close(end) if s.plain[end : end + 1] == "(" else end
    if how == "suite":
        end = s.indented(m.start() + len(m[0]) - len(m[0].lstrip()))
        while m[0].strip().startswith("try") and (n := re.compile(r"\s*\n[ \t]*(?:except\b|else\s*:|finally\s*:)").match(s.plain, end)):
            end = s.indented(n.end() - 1)
        return end
    if how == "decorated":
        return s.indented(end + 1 + len(s.plain[end + 1 :]) - len(s.plain[end + 1 :].lstrip()))
    if how == "arrow":
        n = re.compile(r"\s*\{").match(s.plain, end)
        return s.close(n.end() - 1) if n else statement_end(s, end)
    return statement_end(s, end) if how == "line" else end


def comprehensions(s: Source):
    for a, b in s.match.items():
        inner = s.plain[a + 1 : b]
        flat, depth = [], 0
        for c in inner:
            depth -= c in ")]}"
            flat.append(c if depth == 0 else " ")
            depth += c in "([{"
        top = "".join(flat)
        m = re.search(r"\bfor\b.+\bin\b", top, re.S)
        if not m or not top[: m.start()].strip():
            continue
        opener = s.plain[a]
        kind = "list_comprehension" if opener == "[" else "generator_expression" if opener == "(" else "dictionary_comprehension" if ":" in top[: m.start()] else "set_comprehension"
        yield s.hint(kind, a, b + 1)


def hints(s: Source, rules: Rules) -> list[dict]:
    out = []
    for kind, pattern, how in rules.hints:
        for m in re.finditer(pattern, s.plain):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if how in ("try_operator", "await"):
                start = chain_start(s.plain, m.start())
                how_end = m.end()
            else:
                how_end = span_end(s, m, how)
            out.append(s.hint(kind, start, how_end))
    if rules.call:
        out += calls(s, rules.call)
    if rules.language == "python":
        out += comprehensions(s)
    # siblings come in reverse, so later constructs stand first
    return sorted(out, key=lambda h: (-h["start_byte"], -h["end_byte"], h["node_kind"]))


def top_level(s: Source) -> str:
    """The blanked text without what stands in brackets."""
    out, depth = [], 0
    for c in s.plain:
        depth = max(0, depth - (c in ")]}"))
        out.append(c if depth == 0 or c == "\n" else " ")
        depth += c in "([{"
    return "".join(out)


def imports(s: Source) -> list[str]:
    text, plain, lang = s.text, s.plain, s.language
    if lang == "rust":
        return [" ".join(x.split()) if "\n" in x else x for x in (text[m.start(1) : m.end(1)].strip() for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", plain))]
    if lang == "python":
        out = []
        for m in re.finditer(r"(?m)^[ \t]*(?:import[ \t]+([^\n;]+)|from[ \t]+(\.*)[ \t]*([\w.]*)[ \t]+import\b)", plain):
            if m[1] is not None:
                out += [x.strip().split()[0] for x in m[1].replace("\\", " ").split(",") if x.strip()]
            elif m[3] != "__future__":
                out.append(m[2] + m[3])
        return out
    if lang in ("typescript", "javascript"):
        found = []
        for m in re.finditer(r"(?m)^\s*import\b(?!\s*\()([^;'\"]*?)(?=['\"])", plain):
            found.append((m.start(), s.literal(m.end())))
        if lang == "javascript":
            found += [(m.start(), s.literal(m.end())) for m in re.finditer(r"(?<![\w.$])(?:require|import)\s*\(", plain)]
        return [x for _, x in sorted(found) if x]
    if lang == "go":
        found = []
        for m in re.finditer(r"(?m)^\s*import\b\s*(\()?", plain):
            end = s.close(m.end() - 1) if m[1] else (plain.find("\n", m.end()) + 1 or len(plain))
            found += [string_content(text[a:b]) for a, b in s.strings if m.end() <= a < end]
        return [x for x in found if x]
    out = []
    for m in re.finditer(r"(?m)^\s*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", plain):
        name = m[2]
        out.append((name if m[3] else name.rpartition(".")[0] or name) if m[1] else name + (m[3] or ""))
    return out


def exports(s: Source) -> list[str]:
    lang, top = s.language, top_level(s)
    if lang == "rust":
        return [m[1] for m in re.finditer(r"(?m)^\s*pub(?:\([^)]*\))?\s+(?:(?:async|unsafe|const|extern\s*(?:\"\s*\")?)\s+)*(?:fn|struct|enum|trait|type|const|static|mod)\s+(?:mut\s+)?(\w+)", s.plain)]
    if lang == "python":
        return [m[1] for m in re.finditer(r"(?m)^(?:async\s+)?(?:def|class)\s+([^\W_]\w*)", s.plain)]
    if lang in ("typescript", "javascript"):
        out = [(m.start(), m[1]) for m in re.finditer(r"(?m)^\s*export\s+(?:default\s+)?(?:declare\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\s*\*?|class|interface|enum|type|const|let|var)\s+([\w$]+)", s.plain)]
        for m in re.finditer(r"\bexport\s*(?:type\s*)?\{([^}]*)\}", s.plain):
            out += [(m.start(), x.split()[0]) for x in m[1].split(",") if x.split()]
        return [x for _, x in sorted(out, key=lambda y: y[0])]
    if lang == "go":
        return [m[1] for m in re.finditer(r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Z]\w*)", s.plain)]
    return [m[1] for m in re.finditer(r"(?m)^\s*(?:(?:public|static|final|abstract|sealed|strictfp)\s+)*?public\s+(?:(?:static|final|abstract|sealed|strictfp)\s+)*(?:class|interface|enum|@interface|record)\s+(\w+)", top)]


def signatures(s: Source) -> list[str]:
    lang, plain = s.language, s.plain
    patterns = {
        "rust": r"(?:\bpub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const)\s+)*\bfn\s+\w+",
        "python": r"(?m)(?:(?<=^)|(?<=[ \t]))(?:async\s+)?(?:def|class)\s+\w+",
        "go": r"(?m)^func\s+(?:\([^)]*\)\s*)?\w+",
        "java": r"(?m)^\s*(?:(?:static|final|abstract|synchronized|default)\s+)*public\s+(?:(?:static|final|abstract|synchronized|default)\s+)*(?:[\w<>\[\], .?]+\s+)?\w+\s*(?=\()",
    }
    pattern = patterns.get(lang, r"(?:\basync\s+)?\bfunction\s*\*?\s*[\w$]+|(?m:^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)[\w$]+(?=\([^()]*\)\s*(?::[^={;]+)?\{))")
    out = []
    for m in re.finditer(pattern, plain):
        i = m.end()
        while i < len(plain) and plain[i] not in ("{;" if lang != "python" else ":"):
            i = s.close(i) if plain[i] in "([" else i + 1
        out.append(s.text[m.start() : i].strip())
    return out


def parse_file(path: str, content: str, language: str | None = None, adapters: Iterable[Adapter] = ()) -> dict | None:
    """The feature record of a file; None for a language that is not known."""
    dot = path.rpartition("/")[2].rfind(".")
    for a in adapters:
        if dot >= 0 and path.rpartition("/")[2][dot:] in a.extensions:
            return {"path": path, "language": a.language, "imports": [], "exports": [], "signatures": [], "pattern_hints": []} | a.parse(path, content)
    rules = BY_EXTENSION.get(path.rpartition("/")[2][dot:]) if dot >= 0 else None
    if rules is None:
        return None
    s = Source(content, rules.language)
    return {"path": path, "language": language or rules.language, "imports": imports(s), "exports": exports(s), "signatures": signatures(s), "pattern_hints": hints(s, rules)}


def feature_records(files: DataFrame, adapters: Iterable[Adapter] = ()) -> DataFrame:
    """Records of files(path, content): one Python pass over each file; what is not UTF-8 or not known drops out."""
    adapters = tuple(adapters)

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    found = parse_file(path, bytes(content).decode(), adapters=adapters)
                except UnicodeDecodeError:
                    continue
                if found:
                    rows.append(found)
            yield pd.DataFrame(rows, columns=["path", "language", "imports", "exports", "signatures", "pattern_hints"])

    return files.select("path", "content").mapInPandas(run, RECORD)
