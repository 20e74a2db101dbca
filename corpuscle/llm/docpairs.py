"""Problem 5: functions paired with their documentation.

Candidate comments are matched to functions by parameter tags, names and distance with an optimal
bipartite assignment; implausible links and uninformative descriptions are rejected. Documentation is
by definition what ends directly above, so of the links only those count.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import lexing as L
from corpuscle.functions.arrow import map_columns
from corpuscle.functions.lexing import partners
from corpuscle.llm.grammars import check_tokens, syntax_of
from corpuscle.llm.peg import allow_nesting
from corpuscle.session import spread

_K = L.JS_KINDS
_MODS = {_K[w] for w in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "declare", "override")}
_NAMES = {"i", "s", "n", *_K.values()}
#: Wording of placeholders, whole descriptions.
_PLACEHOLDERS = set("todo|fixme|xxx|tbd|hack|wip|n/a|na|none|null|nil|description|desc|documentation|docs|doc|docstring|comment|summary|placeholder|no description|no documentation|no docs|no comment|undocumented|missing docstring|missing documentation|missing|add description|add docs|add documentation|add docstring|write docs|write me|document me|describe me|document this|describe this|describe|document|to do|to be done|to be defined|to be documented|auto generated|autogenerated|auto generated stub|auto generated method stub|autogenerated stub|generated|generated stub|generated method stub|stub|insert description here|description here|your description here|see above|see below|see name|self explanatory|noqa|nolint|eslint disable|lorem ipsum|beschreibung|keine beschreibung|descripción|sin descripción|pas de description|à faire|pendiente|ohne beschreibung".split("|"))
_TODO = re.compile(r"(?i)^\W*(?:to[- ]?do|fixme|xxx|tbd|hack)\b[\s:.\-()\w]{0,40}$")
#: Words that name the kind of a thing or hold a phrase together.
_KIND = set("a an the this that it is are of for to and or in on with by from as function functions func method methods class member constructor initializer initialiser init getter setter helper helpers util utility utilities wrapper handler callback procedure routine property accessor operation does do performs perform executes execute runs run main async static private public def defines define implementation implements implement here just simple simply self explanatory called named die der das eine ein funktion methode klasse hilfsfunktion la el los las una un función funcion método metodo clase le les une fonction méthode classe".split())
_TAG = re.compile(r"(?m)^[ \t]*(?:@(?P<at>[A-Za-z]+)|:(?P<colon>[a-z]+)(?=[ :]))[ \t:]*(?:\{[^}\n]*\})?[ \t]*(?P<rest>.*)$")
_SECTION = re.compile(r"(?im)^[ \t]*(args|arguments|parameters|params|returns?|raises|yields|attributes|kwargs|parámetros|paramètres|parameter)[ \t]*:?[ \t]*$(?:\n[ \t]*-{3,}[ \t]*$)?")
_CODE_LINE = re.compile(r"^\s*(?:(?:return|if|for|while|else|elif|try|except|import|from|const|let|var|def|class|switch|case|break|continue|pass|raise|throw|await|yield|print|console|assert|del|with)\b.*[()=:;{}\[\]].*|(?:return|break|continue|pass)\b\s*[\w.\"'()\[\]-]*;?|[\w.$\[\]\"']+\s*(?:[-+*/|&]?=)(?!=)\s*\S.*|[\w.$]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:\.[\w.]+\(.*\))?\s*[;{]?|[{}()\[\];,]+|\}\s*else\s*\{|@\w+(?:\(.*\))?)\s*$")


@dataclass
class Function:
    """A function, method or arrow constant: where it is and what it says about itself."""

    name: str
    line: int
    start: int
    end: int
    parameters: list[str] = field(default_factory=list)
    docstring: str | None = None


@dataclass
class Comment:
    """A comment block that stands alone on its lines."""

    first: int
    last: int
    text: str


def python_functions(text: str) -> list[Function] | None:
    """Top-level functions and methods of top-level classes, or None if the text does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out = []
    for node in tree.body:
        for f in [node] if not isinstance(node, ast.ClassDef) else node.body:
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = f.args
                doc = ast.get_docstring(f, clean=True) if f.body else None
                out.append(Function(f.name, f.lineno, f.lineno, f.end_lineno or f.lineno, [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)], doc))
    return out


def script_functions(text: str, jsx: bool) -> tuple[list[Function], L.Tokens] | None:
    """The same of JavaScript or TypeScript, with arrow constants; None if the text does not parse."""
    allow_nesting(len(text))
    toks = L.lex_js(text, jsx, holes=True)
    if not check_tokens(text, "javascript" if jsx else "typescript", toks).valid:
        return None
    k, spans = toks.kinds, toks.spans
    m = toks.mate or partners(k)[0]
    starts = _line_starts(text)
    word = lambda i: text[spans[i][0] : spans[i][1]]
    out: list[Function] = []

    def add(name_at: int, line_at: int, params_at: int, last: int) -> None:
        params = []
        if k[params_at] == "(":
            i, fresh = params_at + 1, True
            while i < m[params_at]:
                if fresh and (k[i] == "i" or k[i] in _K.values()):
                    params.append(word(i))
                    fresh = False
                elif k[i] == ",":
                    fresh = True
                i = m[i] + 1 if k[i] in "([{" else i + 1
        elif k[params_at] == "i":
            params.append(word(params_at))
        out.append(Function(word(name_at).strip("'\""), _line(starts, spans[line_at][0]), spans[name_at][0], _line(starts, spans[min(last, len(spans) - 1)][0]), params))

    def skip_type(i: int, stop: str) -> int:
        while i < len(spans) and k[i] not in stop:
            i = m[i] + 1 if k[i] in "([{" and m[i] >= 0 else i + 1
        return i

    def members(i: int, end: int) -> None:
        while i < end:
            if k[i] == "@":
                i += 1
                while k[i] in "i." or k[i] in _K.values():
                    i += 1
                if k[i] == "(":
                    i = m[i] + 1
                continue
            while k[i] in _MODS and k[i + 1] not in "(=;:?!},<" or k[i] == "*":
                i += 1
            if k[i] in _NAMES or k[i] == "[":
                name = i
                i = m[i] + 1 if k[i] == "[" else i + 1
                if k[i] in "?!":
                    i += 1
                if k[i] == "<":
                    i = skip_type(i, "(")
                if k[i] == "(":
                    params, i = i, m[i] + 1
                    if k[i] == ":":
                        i = _body(k, m, i + 1, end)
                    if i < end and k[i] == "{":
                        if k[name] != "[":
                            add(name, name, params, m[i])
                        i = m[i] + 1
                        continue
            # a field, an overload or an index signature: to the end of its statement
            while i < end and k[i] != ";":
                i = m[i] + 1 if k[i] in "([{" else i + 1
                if i < end and toks.breaks[i] == "1" and k[i] not in ".?=+-*&|BF,:(" and k[i - 1] not in "=,.:+-*&|BF(":
                    break
            i += i < end and k[i] == ";"

    i = 0
    while i < len(spans):
        begin = i
        if k[i] == _K["export"]:
            i += 1
            if k[i] == _K["default"]:
                i += 1
        while k[i] in (_K["async"], _K["abstract"], _K["declare"]) and k[i + 1] in (_K["function"], _K["class"]):
            i += 1
        if k[i] == _K["function"]:
            at = i
            i += 1
            if k[i] == "*":
                i += 1
            name = i
            p = skip_type(i, "(")
            if k[p] == "(":
                e = m[p] + 1
                if k[e] == ":":
                    e = _body(k, m, e + 1, len(spans))
                if k[name] != "(" and e < len(spans) and k[e] == "{":
                    add(name, at, p, m[e])
                    i = m[e] + 1
                    continue
                i = e
                continue
        if k[i] == _K["class"]:
            b = skip_type(i, "{")
            if b < len(spans):
                members(b + 1, m[b])
                i = m[b] + 1
                continue
        if k[i] == _K["const"] and (k[i + 1] == "i" or k[i + 1] in _K.values()):
            at, name = i, i + 1
            e = i + 2
            if k[e] == ":":
                e = skip_type(e, "=;")
            if k[e] == "=":
                p = e + 1
                if k[p] == _K["async"]:
                    p += 1
                if k[p] == "<":
                    p = skip_type(p, "(")
                a = m[p] + 1 if k[p] == "(" else p + 1
                if k[p] == "(" and k[a] == ":":
                    a = skip_type(a, "F;")
                if k[a] == "F":
                    last = m[a + 1] if k[a + 1] == "{" else a + 1
                    add(name, at, p, last)
                    i = last + 1
                    continue
        # anything else: to its end at this depth
        i = max(i, begin)
        i = m[i] + 1 if k[i] in "([{" and m[i] >= 0 else i + 1
    return out, toks


def _body(k: str, m: list[int], i: int, end: int) -> int:
    """Where the body of a function with a return type starting at ``i`` begins."""
    first = True
    while i < end and k[i] != ";":
        if k[i] == "{" and not first and k[i - 1] not in ":|&<,F=(":
            return i
        i = m[i] + 1 if k[i] in "([{" and m[i] >= 0 else i + 1
        first = False
    return i


def _line_starts(text: str) -> list[int]:
    return [0, *(x.end() for x in re.finditer("\n", text))]


def _line(starts: list[int], at: int) -> int:
    lo, hi = 0, len(starts)
    while lo < hi:
        mid = (lo + hi) // 2
        if starts[mid] <= at:
            lo = mid + 1
        else:
            hi = mid
    return lo


def comments(text: str, toks: L.Tokens) -> list[Comment]:
    """Comments alone on their lines; adjoining ``//`` lines are one."""
    starts = _line_starts(text)
    out: list[Comment] = []
    for s, e in toks.comments:
        line = _line(starts, s)
        if text[starts[line - 1] : s].strip():
            continue
        raw, last = text[s:e], _line(starts, e - 1)
        single = raw.startswith("//")
        if single and out and out[-1].last == line - 1 and out[-1].text.startswith("//"):
            out[-1].last, out[-1].text = last, out[-1].text + "\n" + raw
        else:
            out.append(Comment(line, last, raw))
    return out


def assign(functions: list[Function], found: list[Comment]) -> dict[int, Comment]:
    """The assignment of comments to functions of the highest total weight (function number -> comment).

    Candidates are comments that end at most three lines above a function. The weight rewards
    nearness, tags that name its parameters, and mention of its name. Functions are taken in order of
    lines; as candidates lie within three lines, what earlier ones took of the comments that a function
    can still reach is all that matters, so the best of each such state is kept and nothing is cut.
    """
    edges: dict[int, list[tuple[float, int]]] = {}
    by_last: dict[int, list[int]] = {}
    for j, c in enumerate(found):
        by_last.setdefault(c.last, []).append(j)
    for i, f in enumerate(functions):
        for gap in (1, 2, 3):
            for j in by_last.get(f.line - gap, ()):
                tags = set(re.findall(r"@param\s+(?:\{[^}]*\}\s*)?\[?([\w$]+)", found[j].text))
                fit = len(tags & set(f.parameters)) - len(tags - set(f.parameters))
                named = bool(re.search(rf"\b{re.escape(f.name)}\b", found[j].text))
                edges.setdefault(i, []).append((10.0 / gap + fit + named, j))
    order = sorted(edges, key=lambda i: (functions[i].line, i))
    states: dict[frozenset[int], tuple[float, tuple | None]] = {frozenset(): (0.0, None)}
    for n, i in enumerate(order):
        reach = functions[order[n + 1]].line - 3 if n + 1 < len(order) else None
        after: dict[frozenset[int], tuple[float, tuple | None]] = {}
        for taken, (total, links) in states.items():
            options = [(total, links, taken)]
            options += [(total + w, (i, j, links), taken | {j}) for w, j in edges[i] if w > 0 and j not in taken]
            for weight, chosen, now in options:
                left = frozenset(j for j in now if reach is not None and found[j].last >= reach)
                if left not in after or weight > after[left][0]:
                    after[left] = (weight, chosen)
        states = after
    links = max(states.values(), key=lambda x: x[0])[1]
    out: dict[int, Comment] = {}
    while links:
        i, j, links = links
        out[i] = found[j]
    return out


def clean(comment: str) -> str:
    """The wording of a raw comment without its marks."""
    s = comment.strip()
    if s.startswith("/*"):
        s = re.sub(r"(?m)^[ \t]*\*+(?:[ \t]|$)?", "", re.sub(r"\*+/\Z", "", re.sub(r"\A/\*+!?", "", s)))
    else:
        s = re.sub(r"(?m)^[ \t]*(?://+!?|#+)[ \t]?", "", s)
    return "\n".join(x.rstrip() for x in s.split("\n")).strip()


def _stem(w: str) -> str:
    for end in ("ing", "ies", "es", "ed", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


_KIND_STEMS = {_stem(w) for w in _KIND}


def _words(s: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", s))]


def informative(doc: str | None, name: str, parameters: list[str]) -> bool:
    """Whether a description says more than nothing: see the module's problem for what is trivial.

    Wording in any language, garbled letters included, counts as wording.
    """
    if not doc or not re.search(r"[^\W\d_]|[^\x00-\x7f]", doc):
        return False
    if "".join(re.findall(r"[^\W_]+", doc.lower())) == "".join(re.findall(r"[^\W_]+", name.lower())):
        return False
    known = {_stem(w) for w in _words(name)} | _KIND_STEMS
    said: list[str] = []
    text = doc
    for m in _TAG.finditer(doc):
        tag, rest = (m["at"] or m["colon"]).lower(), m["rest"]
        if tag in ("param", "arg", "argument", "property", "prop", "template", "type", "rtype", "keyword", "key"):
            rest = re.sub(r"^\s*\[?[\w$.=*]+\]?\s*[:\-–]*\s*", "", rest)
            about = [w for w in _words(rest) if _stem(w) not in known and w not in {p.lower() for p in parameters}]
            said += about
        elif tag in ("return", "returns", "throws", "raises", "yields", "yield", "deprecated", "summary", "description", "see", "note", "remarks"):
            rest = re.sub(r"^\s*[\w.]*:\s*", "", rest)
            said += [w for w in _words(rest) if _stem(w) not in known and w not in ("nothing", "none", "void", "value", "result", "null", "undefined", "any", "str", "int", "string", "number", "bool", "boolean", "object")]
    text = _TAG.sub("", text)
    parts = _SECTION.split(text)
    main = parts[0]
    for section in parts[2::2]:
        for line in section.split("\n"):
            rest = re.sub(r"^\s*[-*]?\s*`?[\w*]+`?\s*(?:\([^)]*\))?\s*(?::|--|-|–|$)\s*", "", line)
            said += [w for w in _words(rest) if _stem(w) not in known and w not in {p.lower() for p in parameters}]
    flat = " ".join(main.split()).strip(" .:!-*=#~_").lower()
    bare = " ".join(re.sub(r"[^\w\s/]", " ", flat.replace("_", " ")).split())
    if bare in _PLACEHOLDERS or _TODO.match(flat):
        main = ""
    lines = [x for x in main.split("\n") if x.strip()]
    if lines and all(_CODE_LINE.match(x) for x in lines):
        main = ""
    main_words = [w for w in _words(main) if w not in {p.lower() for p in parameters} or len(_words(main)) > 3]
    new = [w for w in main_words if _stem(w) not in known]
    if main and re.search(r"[^\x00-\x7f]", main) and len(re.findall(r"[^\x00-\x7f─-╿•·—–…=*-]", main)) >= 2:
        return True
    return bool(new) or len(said) >= 1


def pairs(text: str, path: str) -> list[tuple[str, int, str, str]]:
    """(name, start_line, code, description) of each documented function of a file; none if it does not parse."""
    language = syntax_of(path)
    lines = text.split("\n")
    out = []
    if language == "python":
        for f in python_functions(text) or []:
            if informative(f.docstring, f.name, f.parameters):
                out.append((f.name, f.line, "\n".join(lines[f.line - 1 : f.end]), f.docstring))
    elif language in ("javascript", "typescript"):
        got = script_functions(text, language == "javascript")
        if got:
            functions, toks = got
            linked = assign(functions, comments(text, toks))
            for i, f in enumerate(functions):
                c = linked.get(i)
                if c is None or c.last != f.line - 1 or c.text.startswith("/*!"):  # a notice is no documentation
                    continue
                doc = clean(c.text)
                if informative(doc, f.name, f.parameters):
                    out.append((f.name, f.line, "\n".join(lines[f.line - 1 : f.end]), doc))
    return out


_KEYS = "repo_path string, path string, name string, start_line int"
_PAIRS = _KEYS + ", code string, description string"


def documented_functions(sources: DataFrame, texts: bool = True) -> DataFrame:
    """(repo_path, path, name, start_line, code, description) of functions with documentation that says something.

    Without ``texts`` only the four keys come out. Files that do not parse give none. Null contents and
    paths are passed over; repeated scans that agree fold into one row under ``distinct()``. Files are
    read whole, in place.
    """
    schema = _PAIRS if texts else _KEYS
    names = [c.split()[0] for c in schema.split(", ")]

    def run(repos: list, paths: list, contents: list) -> dict[str, list]:
        rows = [(r, p, *x) for r, p, t in zip(repos, paths, contents) for x in pairs(t, p)]
        return {n: [x[i] for x in rows] for i, n in enumerate(names)}

    wanted = sources.select("repo_path", "path", "content").filter((F.length("content") > 0) & F.lower("path").rlike(r"\.(py|jsx?|ts)$"))
    return map_columns(spread(wanted), ["repo_path", "path", "content"], run, schema)
