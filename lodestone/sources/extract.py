"""Symbols, calls, imports and routes of source files, one file a row.

Each language has a scanner of its own. Scanners work on a copy of the text in
which strings and comments are blanked (lines and columns stay), so braces and
names in them are not seen. A file that a scanner can't read gives nothing.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import line_of

SCHEMA = (
    "path string, record string, name string, qualified_name string, kind string, start_line int, end_line int, signature string, doc string, exported int,"
    " extends string, implements string, receiver string, enclosing string, line int, source string, specifiers array<string>, is_dynamic boolean"
)


@dataclass
class Found:
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)


def blanked(text: str, line_comments: tuple[str, ...], quotes: str, blocks: tuple[tuple[str, str], ...] = (), keep_strings: bool = False) -> str:
    """The text with comments (and what strings hold) as spaces; newlines stay."""
    out, at, n = list(text), 0, len(text)
    blank = lambda a, b: out.__setitem__(slice(a, b), [c if c == "\n" else " " for c in out[a:b]])
    while at < n:
        block = next((b for b in blocks if text.startswith(b[0], at)), None)
        comment = next((c for c in line_comments if text.startswith(c, at)), None)
        if block:
            end = text.find(block[1], at + len(block[0]))
            end = n if end < 0 else end + len(block[1])
            blank(at, end)
            at = end
        elif comment:
            end = text.find("\n", at)
            end = n if end < 0 else end
            blank(at, end)
            at = end
        elif text[at] in quotes:
            quote, end = text[at], at + 1
            while end < n and text[end] != quote and (quote == "`" or text[end] != "\n"):
                end += 2 if text[end] == "\\" else 1
            if not keep_strings:
                blank(at + 1, min(end, n))
            at = end + 1
        else:
            at += 1
    return "".join(out)


class Lines:
    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def of(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)


def closing(code: str, at: int, pair: str = "{}") -> int:
    """The place of the bracket that closes the one at `at` (the end, if none does)."""
    depth = 0
    for k in range(at, len(code)):
        if code[k] == pair[0]:
            depth += 1
        elif code[k] == pair[1]:
            depth -= 1
            if not depth:
                return k
    return len(code) - 1


# Python

PYTHON_WORDS = {"if", "elif", "while", "for", "return", "and", "or", "not", "in", "is", "print", "with", "assert", "yield", "lambda", "del", "raise"}


def python(path: str, text: str) -> Found:
    """By lines and indentation: nested definitions are methods, `async def` is none, the first base class counts."""
    found = Found()
    lines = text.split("\n")
    indent = lambda s: len(s.expandtabs(4)) - len(s.expandtabs(4).lstrip())
    scopes: list[tuple[int, str]] = []
    for k, line in enumerate(lines):
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        depth = indent(line)
        while scopes and scopes[-1][0] >= depth:
            scopes.pop()
        if m := re.match(r"(class|def)\s+(\w+)\s*(?:\(([^)]*)\)?)?", body):
            end = k
            for j in range(k + 1, len(lines)):
                if lines[j].strip() and indent(lines[j]) <= depth:
                    break
                end = j
            kind = "class" if m[1] == "class" else "method" if scopes else "function"
            bases = [b.strip() for b in (m[3] or "").split(",") if b.strip() and "=" not in b] if kind == "class" else []
            doc = re.match(r'\s*(?:"""|\'\'\')(.*?)(?:"""|\'\'\'|$)', lines[k + 1], re.DOTALL) if k + 1 < len(lines) else None
            found.symbols.append(
                {
                    "name": m[2],
                    "qualified_name": f"{path}::" + ".".join([*(s for _, s in scopes), m[2]]),
                    "kind": kind,
                    "start_line": k + 1,
                    "end_line": end + 1,
                    "signature": body.rstrip(":"),
                    "doc": doc[1].strip() if doc and doc[1].strip() else None,
                    "exported": int(depth == 0 and (kind == "class" or not m[2].startswith("_"))),
                    "extends": bases[0] if bases else None,
                }
            )
            scopes.append((depth, m[2]))
            continue
        if m := re.match(r"from\s+([\w.]+)\s+import\s+(.+)", body):
            names = [n.strip().split(" as ")[0].strip() for n in m[2].strip("()").split(",")]
            found.imports.append({"source": m[1], "line": k + 1, "specifiers": [n for n in names if n], "is_dynamic": False})
            continue
        if m := re.match(r"import\s+(.+)", body):
            for name in m[1].split(","):
                found.imports.append({"source": name.strip().split(" as ")[0], "line": k + 1, "specifiers": [], "is_dynamic": False})
            continue
        code = blanked(line, ("#",), "\"'")
        for m in re.finditer(r"(?:(\w+)\.)?(\w+)\s*\(", code):
            if m[2] not in PYTHON_WORDS:
                found.calls.append({"name": m[2], "receiver": m[1], "line": k + 1, "enclosing": f"{path}::" + ".".join(s for _, s in scopes) if scopes else None})
    return found


# C and C++

C_WORDS = {"if", "for", "while", "switch", "return", "sizeof", "catch", "defined", "else", "do", "case", "new", "delete", "throw", "alignof", "decltype", "typeid"}
C_FUNCTION = re.compile(r"^[ \t]*((?:[\w:*&<>,~]+[ \t*&]+)+|)([\w:~]+)[ \t]*\(([^;{}()]*(?:\([^()]*\)[^;{}()]*)*)\)[ \t]*(?:const)?[ \t]*(?:noexcept)?[ \t]*(?:override)?\s*(?::[^{;]*)?\{", re.M)


def c_family(path: str, text: str, cpp: bool) -> Found:
    found = Found()
    code = blanked(text, ("//",), "\"'", (("/*", "*/"),))
    lines = Lines(text)
    for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]', text, re.M):
        found.imports.append({"source": m[1], "line": lines.of(m.start()), "specifiers": [m[1]], "is_dynamic": False})
    code = re.sub(r"^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: re.sub(r"[^\n]", " ", m[0]), code, flags=re.M)
    spans: list[tuple[int, int, str]] = []

    def symbol(name: str, kind: str, start: int, end: int, signature: str, exported: int = 1, extends: str | None = None) -> str:
        scope = ".".join(s for a, b, s in spans if a < start <= b)
        qualified = f"{path}::{scope + '.' if scope else ''}{name}"
        found.symbols.append({"name": name, "qualified_name": qualified, "kind": kind, "start_line": lines.of(start), "end_line": lines.of(end), "signature": " ".join(signature.split()), "doc": None, "exported": exported, "extends": extends})
        return qualified

    kinds = r"namespace|class|struct|union|enum(?:[ \t]+class)?" if cpp else r"struct|union|enum"
    for m in re.finditer(rf"\b({kinds})[ \t]+(\w+)[ \t]*(?:final[ \t]*)?(?::[ \t]*(?:public|private|protected)?[ \t]*([\w:]+)[^{{;]*)?\{{", code):
        end = closing(code, m.end() - 1)
        kind = {"struct": "struct", "union": "struct", "namespace": "namespace", "class": "class"}.get(m[1].split()[0], "enum")
        symbol(m[2], kind, m.start(), end, m[0].rstrip("{"), extends=m[3])
        if kind in ("namespace", "class"):
            spans.append((m.start(), end, m[2]))
    for m in re.finditer(r"\btypedef\b[^;{}]*(?:\{[^{}]*\})?[^;{}]*?\b(\w+)[ \t]*;", code):
        symbol(m[1], "type_alias", m.start(), m.end(), text[m.start() : m.end()].split("{")[0])
    for m in C_FUNCTION.finditer(code):
        name = m[2].split("::")[-1]
        if name in C_WORDS or re.match(r"\s*(else|return|new|case)\b", m[1]):
            continue
        end = closing(code, m.end() - 1)
        inside = any(a < m.start() <= b for a, b, _ in spans if code.startswith("class", a))
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        qualified = symbol(name, "method" if inside or "::" in m[2] else "function", at, end, text[at : m.end() - 1], 0 if "static" in m[1].split() else 1)
        for c in re.finditer(r"(?:(\w+)(?:\.|->|::))?(\w+)[ \t]*\(", code[m.end() : end]):
            if c[2] not in C_WORDS:
                found.calls.append({"name": c[2], "receiver": c[1], "line": lines.of(m.end() + c.start()), "enclosing": qualified})
    return found


# shells

SHELL_WORDS = {"if", "then", "else", "elif", "fi", "for", "while", "until", "do", "done", "case", "esac", "in", "function", "return", "local", "export", "readonly", "declare", "set", "unset", "shift", "exit", "break", "continue", "echo", "printf", "cd", "test", "true", "false", "[", "[[", "{", "}", "trap", "eval", "exec", "source", ".", "alias", "read", "let"}
SHELL_PREFIXES = {"sudo", "nohup", "time", "command", "builtin", "env"}


def shell(path: str, text: str) -> Found:
    found = Found()
    code = blanked(text, (), "\"'")
    code = re.sub(r"(?m)(^|\s)#[^\n]*", lambda m: m[1] + " " * (len(m[0]) - len(m[1])), code)
    lines, bodies = Lines(text), []
    for m in re.finditer(r"(?m)^[ \t]*(?:function[ \t]+([\w-]+)[ \t]*(?:\(\))?|([\w-]+)[ \t]*\(\))\s*\{", code):
        name, end = m[1] or m[2], closing(code, m.end() - 1)
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        found.symbols.append({"name": name, "qualified_name": f"{path}::{name}", "kind": "function", "start_line": lines.of(at), "end_line": lines.of(end), "signature": f"{name}()", "doc": None, "exported": 1})
        bodies.append((m.end(), end, f"{path}::{name}"))
    for m in re.finditer(r"(?m)^[ \t]*alias[ \t]+([\w-]+)=", code):
        n = lines.of(m.start())
        found.symbols.append({"name": m[1], "qualified_name": f"{path}::{m[1]}", "kind": "variable", "start_line": n, "end_line": n, "signature": text[m.start() : m.end()].strip(), "doc": None, "exported": 1})
    for m in re.finditer(r"(?m)^[ \t]*(?:source|\.)[ \t]+[\"']?([^\s\"';]+)", text):
        found.imports.append({"source": m[1], "line": lines.of(m.start()), "specifiers": [m[1]], "is_dynamic": False})
    at = 0
    for piece in re.split(r"([|;&\n]+|\{|\}|\$\(|`)", code):
        words = piece.split()
        while words and (words[0] in SHELL_PREFIXES or re.match(r"\w+=", words[0]) or words[0] in ("if", "then", "else", "elif", "while", "until", "do", "!")):
            words.pop(0)
        if words and re.fullmatch(r"[A-Za-z_][\w-]*", words[0]) and words[0] not in SHELL_WORDS and not (len(words) > 1 and words[1].startswith("()")):
            place = at + piece.find(words[0])
            inside = [q for a, b, q in bodies if a <= place <= b]
            found.calls.append({"name": words[0], "receiver": None, "line": lines.of(place), "enclosing": inside[-1] if inside else None})
        at += len(piece)
    return found


def powershell(path: str, text: str) -> Found:
    found = Found()
    code = blanked(text, ("#",), "\"'", (("<#", "#>"),))
    lines, bodies = Lines(text), []
    for m in re.finditer(r"(?im)^[ \t]*(function|filter|class|enum)[ \t]+([\w-]+)(?:[ \t]*:[ \t]*(\w+))?[^{\n]*\s*\{", code):
        end, at = closing(code, m.end() - 1), m.start() + len(m[0]) - len(m[0].lstrip())
        kind = {"class": "class", "enum": "enum"}.get(m[1].lower(), "function")
        found.symbols.append({"name": m[2], "qualified_name": f"{path}::{m[2]}", "kind": kind, "start_line": lines.of(at), "end_line": lines.of(end), "signature": " ".join(m[0].rstrip("{").split()), "doc": None, "exported": 1, "extends": m[3]})
        bodies.append((m.end(), end, f"{path}::{m[2]}"))
    for m in re.finditer(r"(?im)^[ \t]*(?:Import-Module|using[ \t]+module|\.)[ \t]+[\"']?([^\s\"']+)", text):
        found.imports.append({"source": m[1], "line": lines.of(m.start()), "specifiers": [m[1]], "is_dynamic": False})
    for m in re.finditer(r"(?m)(?:^|[|;{(=&]|\breturn\b)[ \t]*([A-Za-z][\w-]*)", code):
        name = m[1]
        if ("-" in name or name[0].isupper()) and name.lower() not in ("import-module", "function", "param", "class", "enum"):
            inside = [q for a, b, q in bodies if a <= m.start(1) <= b]
            found.calls.append({"name": name, "receiver": None, "line": lines.of(m.start(1)), "enclosing": inside[-1] if inside else None})
    return found


# JavaScript and TypeScript


def block_before(text: str, at: int) -> str | None:
    """What the block comment says that stands right before a place; none for an empty one. (That of an export belongs to the export, not to its symbol.)"""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    begin = text.rfind("/*", 0, at - 2) if text.endswith("*/", 0, at) else -1
    return text[begin + 2 : at - 2].strip() or None if begin >= 0 else None


JS_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "import", "super", "new", "delete", "void", "in", "of", "constructor", "require", "else", "do", "yield", "throw", "async", "with"}


def javascript(path: str, text: str) -> Found:
    found = Found()
    with_strings = blanked(text, ("//",), "\"'`", (("/*", "*/"),), keep_strings=True)
    code = blanked(text, ("//",), "\"'`", (("/*", "*/"),))
    lines, scopes = Lines(text), []

    def symbol(name: str, kind: str, start: int, end: int, exported: bool, extends: str | None = None, implements: str | None = None, within: str = "") -> None:
        qualified = f"{path}::{within}{name}"
        signature = " ".join(text[start : min(end, start + 200)].split("{")[0].split())
        doc = None if exported else block_before(text, start)
        found.symbols.append({"name": name, "qualified_name": qualified, "kind": kind, "start_line": lines.of(start), "end_line": lines.of(end), "signature": signature, "doc": doc, "exported": int(exported), "extends": extends, "implements": implements})
        scopes.append((start, end, qualified))

    def body_end(at: int) -> int:
        """Of what begins there: a block, or an expression up to the end of its statement."""
        brace, stop = code.find("{", at), re.compile(r"[;\n]").search(code, at)
        if brace >= 0 and (not stop or brace < stop.start()):
            return closing(code, brace)
        return stop.start() if stop else len(code) - 1

    export = r"(?:(export)[ \t]+(?:default[ \t]+)?)?"
    for m in re.finditer(rf"(?m)^[ \t]*{export}(?:async[ \t]+)?function[ \t]*\*?[ \t]*(\w+)[^(\n]*\(", code):
        paren = closing(code, m.end() - 1, "()")
        symbol(m[2], "function", m.start() + len(m[0]) - len(m[0].lstrip()), body_end(paren), bool(m[1]))
    for m in re.finditer(rf"(?m)^[ \t]*{export}(?:const|let|var)[ \t]+(\w+)[^=\n]*=[ \t]*", code):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if re.match(r"(?:async[ \t]*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)[^=\n{]*=>|\w+[ \t]*=>)", code[m.end() :]):
            symbol(m[2], "function", start, body_end(m.end()), bool(m[1]))
        elif m[1]:
            symbol(m[2], "variable", start, body_end(m.end()), True)
    for m in re.finditer(rf"(?m)^[ \t]*{export}(?:abstract[ \t]+)?class[ \t]+(\w+)(?:<[^>{{]*>)?(?:[ \t]+extends[ \t]+([\w.]+)(?:<[^>{{]*>)?)?(?:[ \t]+implements[ \t]+([\w., \t]+))?\s*\{{", code):
        end = closing(code, m.end() - 1)
        symbol(m[2], "class", m.start() + len(m[0]) - len(m[0].lstrip()), end, bool(m[1]), m[3], m[4].strip() if m[4] else None)
        at = m.end()
        while at < end:  # members stand at the depth of the class
            part = re.compile(r"(?:(?:public|private|protected|static|readonly|async|override|get|set)[ \t]+)*\*?[ \t]*#?(\w+)[ \t]*(?:<[^>(]*>)?[ \t]*(\(|=[ \t]*(?:async[ \t]*)?(?:\([^()]*\)|\w+)[^=;\n{]*=>)").match(code, at)
            if part and part[1] not in JS_WORDS - {"constructor"}:
                close = closing(code, part.end() - 1, "()") if part[2] == "(" else part.end()
                last = body_end(close)
                symbol(part[1], "method", at, min(last, end), False, within=f"{m[2]}.")
                at = last + 1
            elif code[at] == "{":
                at = closing(code, at) + 1
            elif code[at] in "(=":
                at = body_end(at) + 1
            elif code[at].isalnum() or code[at] in "_#":
                at = re.compile(r"[\w#]+").match(code, at).end()
            else:
                at += 1
    for m in re.finditer(rf"(?m)^[ \t]*{export}(interface|enum|type)[ \t]+(\w+)(?:<[^>{{=]*>)?(?:[ \t]+extends[ \t]+([\w.]+))?[^{{=\n]*[{{=]", code):
        kind = {"interface": "interface", "enum": "enum", "type": "type_alias"}[m[2]]
        symbol(m[3], kind, m.start() + len(m[0]) - len(m[0].lstrip()), body_end(m.end() - 1), bool(m[1]), m[4])
    for m in re.finditer(r"(?m)^[ \t]*import[ \t]+(?:type[ \t]+)?([^'\"\n;]*?)(?:[ \t]+from[ \t]+)?['\"]([^'\"\n]+)['\"]", with_strings):
        names = [re.sub(r"^type[ \t]+", "", n.strip()).split(" as ")[0].strip() for n in re.sub(r"[{}]", ",", m[1]).split(",")]
        found.imports.append({"source": m[2], "line": lines.of(m.start()), "specifiers": [n for n in names if n], "is_dynamic": False})
    for m in re.finditer(r"(?m)^[ \t]*export[ \t]*\{([^}]*)\}[ \t]*from[ \t]*['\"]([^'\"\n]+)['\"]", with_strings):
        names = [n.strip().split(" as ") for n in m[1].split(",") if n.strip()]
        found.imports.append({"source": m[2], "line": lines.of(m.start()), "specifiers": [n[0].strip() for n in names], "is_dynamic": False})
        for n in names:
            symbol(n[-1].strip(), "variable", m.start(), m.end(), True)
    for m in re.finditer(r"\b(?:import|require)[ \t]*\([ \t]*['\"]([^'\"\n]+)['\"]", with_strings):
        found.imports.append({"source": m[1], "line": lines.of(m.start()), "specifiers": [], "is_dynamic": True})
    starts = {(s["start_line"], s["name"]) for s in found.symbols}
    for m in re.finditer(r"(?:(\w+)[ \t]*\??\.[ \t]*|(?<![\w.]))(\w+)[ \t]*(?:<[\w, \t]*>)?\(", code):
        line = lines.of(m.start(2))
        if m[2] in JS_WORDS or (line, m[2]) in starts or re.search(r"function[ \t]*\*?[ \t]*$", code[max(0, m.start() - 12) : m.start()]):
            continue
        inside = [(b - a, q) for a, b, q in scopes if a <= m.start() <= b]
        found.calls.append({"name": m[2], "receiver": m[1], "line": line, "enclosing": min(inside)[1] if inside else None})
    return found


def extract(path: str, language: str, text: str) -> Found:
    """What a file has; nothing for other languages and for what can't be read."""
    try:
        if language in ("javascript", "jsx", "typescript", "tsx"):
            return javascript(path, text)
        if language == "python":
            return python(path, text)
        if language in ("c", "cpp"):
            return c_family(path, text, language == "cpp")
        if language == "shell":
            return shell(path, text)
        if language == "powershell":
            return powershell(path, text)
    except (ValueError, IndexError, RecursionError):
        pass
    return Found()


def extract_files(files: DataFrame) -> DataFrame:
    """One row per symbol, call and import (column record) of files (path, language, content)."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for path, language, content in zip(batch.path, batch.language, batch.content, strict=True):
                found = extract(path, language, content or "")
                for record, items in (("symbol", found.symbols), ("call", found.calls), ("import", found.imports)):
                    out += [{"path": path, "record": record, **item} for item in items]
            frame = pd.DataFrame(out).reindex(columns=names).astype(object)
            yield frame.where(frame.notna(), None)

    return files.select("path", "language", "content").mapInPandas(rows, SCHEMA)


# web routes

#: The languages of scripts, and how each framework writes a route (quotes of all three kinds).
SCRIPTS = ("javascript", "jsx", "typescript", "tsx")
EXPRESS = re.compile(r"""(?:app|router|server)\.(?P<method>get|post|put|delete|patch|all|use)\s*\(\s*['"`](?P<pattern>[^'"`]+)['"`]\s*,\s*(?:.*?,\s*)?(?P<handler>\w+)""", re.I)
REACT = re.compile(r"""<Route\s+[^>]*path\s*=\s*['"`{](?P<q>['"`]?)(?P<pattern>[^'"`}]+)(?P=q)[^>]*(?:component\s*=\s*\{?(?P<handler>\w+)\}?|element\s*=\s*\{?\s*<(?P<element>\w+))""", re.I)
FLASK = re.compile(r"""@\w+\.route\s*\(\s*['"`](?P<pattern>[^'"`]+)['"`](?:.*?methods\s*=\s*\[(?P<methods>[^\]]*)\])?\s*\)""", re.I)
FASTAPI = re.compile(r"""@\w+\.(?P<method>get|post|put|delete|patch|options|head)\s*\(\s*['"`](?P<pattern>[^'"`]+)['"`]""", re.I)
DJANGO = re.compile(r"""(?:path|re_path|url)\s*\(\s*r?['"`](?P<pattern>[^'"`]*)['"`]\s*,\s*(?:views\.)?(?P<handler>\w+(?:\.\w+)*)""", re.I)
NEXT_PAGES, NEXT_APP = re.compile(r"pages/(.+)\.(?:tsx?|jsx?|mdx?)$"), re.compile(r"app/(.+)/(?:page|route|layout)\.(?:tsx?|jsx?|mdx?)$")
DEFINED = re.compile(r"def\s+(\w+)")
UNKNOWN = "unknown"


def page_route(path: str) -> str | None:
    """The pattern of a file that is a page by its place; None for others."""
    place = NEXT_PAGES.search(path) or NEXT_APP.search(path)
    if place is None:
        return None
    return "/" + re.sub(r"\[(\w+)\]", r":\1", re.sub(r"\[\.\.\.(\w+)\]", r"*\1", place[1].removesuffix("/index")))


def routes_of(path: str, language: str | None, text: str) -> list[tuple[str, str, str, int, str]]:
    """(method, pattern, handler, line, framework) of each route of a file, in the order of the frameworks and of their places."""
    out, lines = [], Lines(text)

    def below(end: int) -> str:
        """The function that is defined next."""
        m = DEFINED.search(text, end)
        return m[1] if m else UNKNOWN

    if pattern := page_route(path):
        default = re.search(r"export\s+default\s+(?:function\s+)?(\w+)", text)
        out.append(("*", pattern, default[1] if default else "default", 1, "nextjs"))
    if language in SCRIPTS:
        out += [(m["method"].upper(), m["pattern"], m["handler"], lines.of(m.start()), "express") for m in EXPRESS.finditer(text)]
        out += [("*", m["pattern"], m["handler"] or m["element"] or UNKNOWN, lines.of(m.start()), "react-router") for m in REACT.finditer(text)]
    if language == "python":
        for m in FLASK.finditer(text):
            methods = re.sub(r"""['"`\s]""", "", m["methods"]).upper() if m["methods"] else "GET"
            out.append((methods, m["pattern"], below(m.end()), lines.of(m.start()), "flask"))
        out += [(m["method"].upper(), m["pattern"], below(m.end()), lines.of(m.start()), "fastapi") for m in FASTAPI.finditer(text)]
        out += [("*", "/" + m["pattern"], m["handler"], lines.of(m.start()), "django") for m in DJANGO.finditer(text)]
    return out


def routes(files: DataFrame) -> DataFrame:
    """(path, method, pattern, handler, line, framework) of web routes; two equal routes of a file are two rows."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(path, *route) for path, language, content in zip(batch.path, batch.language, batch.content, strict=True) for route in routes_of(path, language, content or "")]
            yield pd.DataFrame(found, columns=["path", "method", "pattern", "handler", "line", "framework"])

    return files.select("path", "language", "content").mapInPandas(rows, "path string, method string, pattern string, handler string, line int, framework string")


# calls that only show at run time

#: Functions that take a callback, by the kind of what calls it back.
REGISTRATIONS = {
    "event-emitter": ("addEventListener", "on", "once", "addListener", "subscribe"),
    "promise": ("then", "catch", "finally"),
    "react-render": ("useEffect", "useMemo", "useCallback", "useLayoutEffect"),
    "hof": ("map", "filter", "forEach", "reduce", "find", "findIndex", "some", "every", "flatMap", "sort"),
    "callback": ("removeEventListener", "off", "removeListener", "unsubscribe", "setTimeout", "setInterval", "setImmediate", "requestAnimationFrame"),
}


def registration_calls(found: DataFrame) -> DataFrame:
    """(path, source_qname, target_name, kind, via, line): calls (rows of extract_files) to a function that takes a callback, inside a symbol; the target is that function."""
    kinds = F.create_map(*[F.lit(x) for kind, names in REGISTRATIONS.items() for name in names for x in (name, kind)])
    calls = found.filter("record = 'call' AND enclosing IS NOT NULL").withColumn("by", kinds[F.col("name")]).filter("by IS NOT NULL")
    via = F.when(F.coalesce("receiver", F.lit("")) != "", F.concat_ws(".", "receiver", "name")).otherwise(F.col("name"))
    return calls.select("path", F.col("enclosing").alias("source_qname"), F.col("name").alias("target_name"), F.col("by").alias("kind"), via.alias("via"), "line")


def rendered_components(files: DataFrame, components: DataFrame) -> DataFrame:
    """(path, source_qname, target_name, line): the components that a file's component (path, name) renders, each by its first place."""
    tag = F.explode(F.regexp_extract_all("content", F.lit(r"<([A-Z]\w+)[\s/>]"), 1)).alias("target_name")
    tags = files.join(components.select("path", F.col("name").alias("component")), "path").select("path", "component", "content", tag).groupBy("path", "component", "target_name").agg(F.first("content").alias("content"))
    place = F.regexp_instr("content", F.concat(F.lit("<"), "target_name", F.lit(r"[\s/>]")), 0)
    return tags.select("path", F.concat("path", F.lit("::"), "component").alias("source_qname"), "target_name", line_of(F.col("content"), place - 1).cast("int").alias("line"))
