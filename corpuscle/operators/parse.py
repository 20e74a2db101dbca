"""Parsing files into code elements: one file in, any number of elements out."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from dataclasses import astuple, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.arrow import map_columns
from corpuscle.functions.lang import LANGUAGES, PARSED
from corpuscle.functions.lexing import JS_KINDS, Tokens, lex_js, partners

ELEMENTS = "repo_path string, path string, language string, seq int, type string, name string, start_line int, end_line int, content string, docstring string, decorators array<string>, parent_class string, parameters array<string>, return_type string"
TYPES = ("import", "class", "function", "method")


@dataclass
class Element:
    """A code element; lines count from 1."""

    type: str
    name: str
    start_line: int
    end_line: int
    content: str
    docstring: str | None = None
    decorators: list[str] = field(default_factory=list)
    parent_class: str | None = None
    parameters: list[str] = field(default_factory=list)
    return_type: str | None = None


def parse_python(text: str) -> list[Element]:
    """Imports (one element an alias), classes, functions and the methods of classes' own bodies.

    Only the module's top level is looked at: nothing nested, nothing under a condition. Parameters are
    the plain positional ones. A text that does not parse has no elements.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = text.split("\n")

    def source(node: ast.stmt) -> str:
        # the node's own lines; columns are UTF-8 offsets
        first, last = node.lineno - 1, node.end_lineno - 1
        part = lines[first : last + 1]
        part[-1] = part[-1].encode()[: node.end_col_offset].decode("utf-8", "replace")
        part[0] = part[0].encode()[node.col_offset :].decode("utf-8", "replace") if first != last else part[0].encode()[node.col_offset : node.end_col_offset].decode("utf-8", "replace")
        return "\n".join(part)

    out: list[Element] = []

    def function(node: ast.FunctionDef | ast.AsyncFunctionDef, parent: str | None) -> None:
        out.append(Element("method" if parent else "function", node.name, node.lineno, node.end_lineno, source(node), ast.get_docstring(node), [ast.unparse(d) for d in node.decorator_list], parent, [a.arg for a in node.args.args], ast.unparse(node.returns) if node.returns else None))

    for node in tree.body:
        if isinstance(node, ast.Import):
            out += [Element("import", a.name, node.lineno, node.end_lineno, source(node)) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [Element("import", f"{node.module}.{a.name}" if node.module else a.name, node.lineno, node.end_lineno, source(node)) for a in node.names]
        elif isinstance(node, ast.ClassDef):
            out.append(Element("class", node.name, node.lineno, node.end_lineno, source(node), ast.get_docstring(node), [ast.unparse(d) for d in node.decorator_list], None, [ast.unparse(b) for b in node.bases]))
            for member in node.body:
                if isinstance(member, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(member, node.name)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node, None)
    return out


_K = JS_KINDS
_VALUES = set(_K.values())
_MEMBER_WORDS = {_K[w] for w in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "declare", "override")}


class _Script:
    """Top-level scan of a JavaScript or TypeScript token sequence; tolerant, as bracket pairs are all it needs."""

    def __init__(self, text: str, jsx: bool, typed: bool):
        self.text, self.typed = text, typed
        toks: Tokens = lex_js(text, jsx)
        self.k, self.spans, self.breaks = toks.kinds, toks.spans, toks.breaks
        self.mate, _ = partners(self.k)
        self.comments = {e: (s, e) for s, e in toks.comments}
        self.n = len(self.spans)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.out: list[Element] = []

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def word(self, i: int) -> str:
        return self.text[self.spans[i][0] : self.spans[i][1]]

    def part(self, a: int, b: int) -> str:
        return self.text[self.spans[a][0] : self.spans[min(b, self.n - 1)][1]]

    def after(self, i: int) -> int:
        return self.mate[i] + 1 if self.k[i] in "([{" and self.mate[i] >= 0 else i + 1

    def until(self, i: int, stop: str) -> int:
        while i < self.n and self.k[i] not in stop:
            i = self.after(i)
        return i

    def doc(self, i: int) -> str | None:
        """The ``/** */`` comment that directly precedes token ``i`` (white space aside)."""
        end = self.spans[i][0]
        while end and self.text[end - 1].isspace():
            end -= 1
        c = self.comments.get(end)
        text = self.text[c[0] : c[1]] if c else ""
        return text if text.startswith("/**") else None

    def emit(self, kind: str, name: str, a: int, b: int, doc_at: int, **rest: object) -> None:
        self.out.append(Element(kind, name, self.line(self.spans[a][0]), self.line(self.spans[min(b, self.n - 1)][1] - 1), self.part(a, b), self.doc(doc_at), **rest))

    def parameters(self, p: int) -> list[str]:
        """The source of each parameter of the list at ``p``, which may be a bare name."""
        if self.k[p] != "(":
            return [self.word(p)]
        out, a, i = [], p + 1, p + 1
        depth = 0
        while i < self.mate[p]:
            depth += (self.k[i] == "<") - (self.k[i] == ">")
            if self.k[i] == "," and depth <= 0:
                out.append(self.part(a, i - 1))
                a = i + 1
            i = self.after(i)
        if a < self.mate[p]:
            out.append(self.part(a, self.mate[p] - 1))
        return out

    def result(self, i: int, stop: str) -> tuple[str | None, int]:
        """(return type, token behind it) where one may stand at ``i``."""
        if self.k[i] != ":":
            return None, i
        a = i = i + 1
        while i < self.n and not (self.k[i] in stop and (i > a or self.k[i] != "{") and self.k[i - 1] not in ":|&<,F=("):
            if self.k[i] == ";":
                break
            i = self.after(i)
        return (self.part(a, i - 1) if i > a else None), i

    def end_of_statement(self, i: int) -> int:
        """The last token of the statement that goes on at ``i``."""
        while i < self.n and self.k[i] != ";":
            nxt = self.after(i)
            if nxt >= self.n or self.breaks[nxt] == "1" and self.k[nxt] not in ".?=+-*&|BFQ,:([A" and self.k[nxt - 1] not in "=,.:+-*&|BFA(":
                return nxt - 1
            i = nxt
        return min(i, self.n - 1)

    def run(self) -> list[Element]:
        i = 0
        decorators: list[str] = []
        first_decorator = -1
        while i < self.n:
            k = self.k
            doc_at = i if first_decorator < 0 else first_decorator
            if k[i] == "@":
                a, i = i, i + 1
                while i < self.n and (k[i] in "i." or k[i] in _VALUES and self.breaks[i] == "0"):
                    i += 1
                if k[i] == "(":
                    i = self.mate[i] + 1
                decorators.append(self.part(a, i - 1))
                first_decorator = a if first_decorator < 0 else first_decorator
                continue
            exported = k[i] == _K["export"]
            if exported:
                i += 1
                if k[i] == _K["default"]:
                    i += 1
            i = self.declaration(i, -1 if exported else doc_at, decorators if self.typed else [])
            decorators, first_decorator = [], -1
        return self.out

    def declaration(self, i: int, doc_at: int, decorators: list[str]) -> int:
        k, a = self.k, i
        doc_at = a if doc_at < 0 else doc_at
        if k[i] == _K["import"] and k[i + 1] not in "(.":
            end = self.end_of_statement(i)
            strings = [j for j in range(i, end + 1) if k[j] == "s"]
            self.out.append(Element("import", self.word(strings[-1]).strip("'\"") if strings else self.part(a, end), self.line(self.spans[a][0]), self.line(self.spans[end][1] - 1), self.part(a, end)))
            return end + 1
        if k[i] == _K["declare"] and k[i + 1] in _VALUES:
            i += 1
        if k[i] in (_K["async"], _K["abstract"]) and k[i + 1] in (_K["function"], _K["class"]):
            i += 1
        if k[i] == _K["function"] and k[i + 1] != "*":
            name = self.word(i + 1) if k[i + 1] != "(" and i + 1 < self.n else "<anonymous>"
            p = self.until(i, "(")
            if p < self.n and self.mate[p] >= 0:
                returned, b = self.result(self.mate[p] + 1, "{")
                if k[b] == "{" and self.mate[b] >= 0:
                    self.emit("function", name, a, self.mate[b], doc_at, parameters=self.parameters(p), return_type=returned if self.typed else None)
                    return self.mate[b] + 1
        if k[i] == _K["class"]:
            b = self.until(i, "{")
            if b < self.n and self.mate[b] >= 0:
                name = self.word(i + 1) if k[i + 1] == "i" or k[i + 1] in _VALUES and k[i + 1] != _K["extends"] else "<anonymous>"
                self.emit("class", name, a, self.mate[b], doc_at, decorators=decorators)
                self.members(b + 1, self.mate[b], name)
                return self.mate[b] + 1
        if self.typed and k[i] == _K["interface"] and k[i + 1] not in "=.(":
            b = self.until(i, "{")
            if b < self.n and self.mate[b] >= 0:
                self.emit("class", self.word(i + 1), a, self.mate[b], doc_at)
                return self.mate[b] + 1
        if k[i] in (_K["const"], _K["let"]):
            return self.constants(a, i, doc_at)
        return self.end_of_statement(i) + 1

    def constants(self, a: int, i: int, doc_at: int) -> int:
        """Arrow functions and function expressions of a declaration; each has the whole declaration as content."""
        k, found = self.k, []
        i += 1
        end = i
        while i < self.n:
            name = i
            e = self.until(i, "=,;") if k[i + 1] == ":" else i + 1
            if k[e] == "=":
                p = e + 1
                if k[p] == _K["async"]:
                    p += 1
                if k[p] == "<":
                    p = self.until(p, "(")
                arrow = k[p] == _K["function"] and k[p + 1] != "*"
                if arrow:
                    p = self.until(p, "(")
                if p < self.n and (k[p] == "(" and self.mate[p] >= 0 or k[p] == "i" or k[p] in _VALUES):
                    returned, b = self.result(self.mate[p] + 1, "F{") if k[p] == "(" else (None, p + 1)
                    if k[b] == "F" or arrow:
                        found.append((name, p, returned))
            # to the comma or the end of this declarator
            j = e
            while j < self.n and k[j] not in ",;":
                nxt = self.after(j)
                if nxt < self.n and self.breaks[nxt] == "1" and k[nxt] not in ".?=+-*&|BFQ,:([A" and k[nxt - 1] not in "=,.:+-*&|BFA(":
                    j = nxt - 1
                    break
                j = nxt
            end = min(j, self.n - 1)
            if j < self.n and k[j] == ",":
                i = j + 1
                continue
            break
        for name, p, returned in found:
            self.emit("function", self.word(name), a, end, doc_at, parameters=self.parameters(p), return_type=returned if self.typed else None)
        return end + 1

    def members(self, i: int, end: int, parent: str) -> None:
        k = self.k
        decorators: list[str] = []
        doc_at = -1
        while i < end:
            if k[i] == "@":
                a, i = i, i + 1
                while i < end and (k[i] == "." or k[i] == "i" and (k[i - 1] in "@.")):
                    i += 1
                if k[i] == "(":
                    i = self.mate[i] + 1
                decorators.append(self.part(a, i - 1))
                doc_at = a if doc_at < 0 else doc_at
                continue
            a = i
            while k[i] in _MEMBER_WORDS and k[i + 1] not in "(=;:?!},<":
                i += 1
            generator = k[i] == "*"
            i += generator
            name = i
            i = self.after(i) if k[i] == "[" else i + 1
            if i < end and k[i] in "?!":
                i += 1
            if i < end and k[i] == "<":
                i = self.until(i, "(")
            if i < end and k[i] == "(" and self.mate[i] >= 0:
                p = i
                returned, b = self.result(self.mate[p] + 1, "{")
                if b < end and k[b] == "{" and self.mate[b] >= 0:
                    self.emit("method", self.word(name) if k[name] != "[" else self.part(name, self.mate[name]), a, self.mate[b], doc_at if doc_at >= 0 else a, decorators=decorators if self.typed else [], parent_class=parent, parameters=self.parameters(p), return_type=returned if self.typed else None)
                    i = self.mate[b] + 1
                    decorators, doc_at = [], -1
                    continue
            i = max(self.end_of_statement(min(i, self.n - 1)) + 1, a + 1)
            decorators, doc_at = [], -1


def parse_javascript(text: str) -> list[Element]:
    """Imports, classes, functions, arrow constants and methods of a JavaScript text."""
    return _Script(text, True, False).run()


def parse_typescript(text: str, tsx: bool = False) -> list[Element]:
    """The same of TypeScript, with interfaces as classes, decorators and return types."""
    return _Script(text, tsx, True).run()


#: Language -> parser; extend it to add a language (and name the language's suffixes in LANGUAGES).
PARSERS = {"python": parse_python, "javascript": parse_javascript, "typescript": parse_typescript, "tsx": lambda t: parse_typescript(t, True)}


def parse_text(text: str, language: str) -> list[Element]:
    """Elements of one text; none for a language without a parser."""
    parser = PARSERS.get(language)
    return parser(text) if parser else []


def language_of_path(path: str | None) -> str | None:
    """The language of a path on the Python side."""
    name = (path or "").rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return LANGUAGES.get(name[dot:].lower()) if dot > 0 else None


def parse_files(sources: DataFrame) -> DataFrame:
    """Elements of every file with content in a parsed language (F7, F8, P1-P17), in source order by ``seq``.

    Files with null content, of other languages, empty or (Python) not valid give no rows. Texts cross
    to Python once; nothing is shuffled.
    """
    names = [c.strip().split(" ")[0] for c in ELEMENTS.split(", ")]

    def run(repos: list, paths: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in names}
        for repo, path, text in zip(repos, paths, texts):
            language = language_of_path(path)
            if text is None or language not in PARSED:
                continue
            for seq, e in enumerate(parse_text(text, language)):
                for n, v in zip(names, (repo, path, language, seq, *astuple(e))):
                    out[n].append(v)
        return out

    return map_columns(sources.filter(F.col("content").isNotNull()), ["repo_path", "path", "content"], run, ELEMENTS)


def parsed_files(elements: DataFrame) -> DataFrame:
    """One row a file with its elements and the four lists by type, each in source order."""
    kept = [c for c in elements.columns if c not in ("repo_path", "path", "language")]
    row = F.struct("seq", *[c for c in kept if c != "seq"])
    grouped = elements.groupBy("repo_path", F.col("path").alias("file_path"), "language").agg(F.array_sort(F.collect_list(row)).alias("elements"))

    def only(kind: str) -> Column:
        return F.filter("elements", lambda e: e["type"] == kind)

    return grouped.select("*", *(only(t).alias({"import": "imports", "class": "classes", "function": "functions", "method": "methods"}[t]) for t in TYPES))
