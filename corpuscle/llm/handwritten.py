"""Problem 3: generated, minified, vendored and data files among source code.

Each program file is lexed and emitted again in a canonical layout, one statement a line, and that is
compared with the layout it has: extreme expansion without white space marks minified code, perfect
uniformity of the emitted lines a generator, dominance of literals a block of data. Copies of
third-party libraries are known by their place or notice, and by having the same canonical text as a
file that is. Which of these told is the ``signal`` of a file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.arrow import map_columns
from corpuscle.session import checkpoint, spread

#: Canonical lines for each line of code, and share of white space in the code below it, from which a file counts as minified.
EXPANSION, TIGHT = 4.0, 0.15
#: Distinct shapes for each canonical line below which a file counts as generated, and lines of which that can be said.
UNIFORMITY, UNIFORM_LINES = 0.19, 12
#: What makes more than a small table: literals for each other word, their number and characters.
LITERALS_A_WORD, TABLE_LITERALS, DATA_CHARS = 12.0, 40, 1200
#: Share and characters for each other word from which literals of any number are data.
DATA_SHARE, CHARS_A_WORD = 0.9, 240
#: Canonical lines of which equal texts are copies rather than chance.
BODY_LINES = 8

_PROGRAM = {"py", "js", "jsx", "mjs", "cjs", "ts", "tsx", "go", "java"}
_BRACES = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|(?<=[(,=:[!&|?{};+\n])[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_PYTHON = re.compile(r"#[^\n]*|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_NUMBER = re.compile(r"\b(?:0[xX][0-9a-fA-F]+|\d[\w.]*)")
_WORD = re.compile(r"[^\W\d]\w*(?!\w*\s*:)")
#: Words that surround a table without being code.
_AROUND = set("const let var export default static final public private int long float double byte String new return true false null None True False module exports package var byte string func".split())
_DIGITS = re.compile(r"\d+")
_VENDOR_DIR = re.compile(r"(?:^|/)(?:_?vendor|third[_-]?party|node_modules|externals?|extern|deps|bower_components|site-packages|Pods|Godeps)/")
_LOCK = re.compile(r"(?:^|/)(?:package-lock|npm-shrinkwrap|composer\.lock|yarn\.lock|poetry\.lock|Pipfile\.lock|Cargo\.lock|go\.sum|pnpm-lock|uv\.lock|Gemfile\.lock)")
_LOCK_BODY = re.compile(r"\A\s*\{\s*\"(?:lockfileVersion|name)\"[\s\S]{0,400}?\"(?:lockfileVersion|packages|dependencies)\"|\A# yarn lockfile|\A# This file is automatically @generated|\AlockfileVersion:")
#: Wording of a library's notice, beyond a mere copyright line.
_NOTICE = re.compile(r"(?i)@licen[sc]e\b.*\d|@preserve|copied (?:unchanged|verbatim) from|upstream (?:at|:)|\bv?\d+\.\d+(?:\.\d+)?\s*\|\s*(?:\(c\)|licen|mit|bsd|apache)|\(c\) .*contributors|redistribution (?:and use )?in source|released under the .* licen|part of the [\w.-]+ (?:distribution|library|package)|vendored from")
_LEADING = re.compile(r"\s*(?:#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->)")
#: Wording of a generator's mark.
_MARK = re.compile(r"(?i)code generated by|do not (?:edit|modify|change)|@generated|<auto-?generated|auto-?generated (?:file|by|from)|autogenerated|(?:file|source) (?:was |is )?(?:automatically |auto-?)(?:generated|produced|created)|generated (?:source|file|by|from|with)|machine-(?:written|generated)|automatically (?:generated|produced|created)|@Generated\(")
#: The same marks where a sentence begins, and what makes the sentence one about generated code elsewhere.
_AFFIRMS = re.compile(r"(?im)(?:^[\s#/*!;=-]*<?!?-{0,2}\s*<?|[.!:;,(-][ \t]+)(?:(?P<own>(?:this|the following) (?:\w+ ){0,2}?(?:file|source|code|class|module|package|parser|client|schema|model)s? (?:(?:was|is|were|are|has been|have been) )?(?:(?:auto(?:matically)?[- ]?)?(?:generated|produced|created)|machine-written) |@Generated\(|warning[:!] (?:auto-?)?generated|do not (?:edit|modify|change)(?=\s*(?:[.!*;,>-]|$| this file| manually| by hand| directly)))|(?:code generated by|@generated\b|auto-?generated\b(?! \w+s\b)|generated (?:source|file|code|by|from|with)\b|machine-(?:written|generated)|automatically (?:generated|produced|created)))(?P<rest>[^.;!\n]*)")
_QUOTED = re.compile(r"(?<!\w)(?:'[^'\n]*'|\"[^\"\n]*\"|`[^`\n]*`)(?!\w)")
_ABOUT = re.compile(r"(?i)\b(?:is|are|lives?|goes|go|must|should|can|may|will|gets?|means|stays?|lands?|markers?|marks?|tags?|headers?|annotations?|skipped|ignored)\b")


@dataclass(frozen=True)
class Layout:
    """What comparing a file with its canonical layout says."""

    lines: int  #: of code, as it stands
    canonical: int
    shapes: float  #: distinct canonical lines, digits aside, for each
    kept: float  #: share of the lines that the canonical layout has too
    space: float  #: share of white space in the code
    literals: int
    words: int
    literal_share: float
    body: str  #: hash of the canonical text
    data_share: float  #: without docstrings
    data_chars: int


_STRUCTURE = re.compile(r"[;{}()\[\]\n]")
#: After these a line goes on.
_GOES_ON = tuple(",=+-*/%&|^?:.<(!~")


def emit(code: str, python: bool) -> list[str]:
    """The canonical lines of a code without comments, its strings folded: a statement each, single spaces, indented by braces.

    In brace languages a line ends behind ``;`` and braces outside parentheses, and at a line break
    outside them behind which a statement may begin; in Python where a logical line does.
    """
    out: list[str] = []
    stack: list[str] = []
    start = 0

    def flush(end: int) -> None:
        statement = " ".join(code[start:end].split())
        if statement and statement != ";":
            out.append(" " * (0 if python else stack.count("{")) + statement)

    for m in _STRUCTURE.finditer(code):
        c, top = m[0], stack[-1] if stack else ""
        if c in "([" or python and c == "{":
            stack.append(c)
        elif c in ")]" or python and c == "}":
            if top and (python or top != "{"):
                stack.pop()
        elif c == "{":
            flush(m.end())
            stack.append(c)
            start = m.end()
        elif c == "}":
            flush(m.start())
            while stack and stack.pop() != "{":
                pass
            start = m.start()
            flush(m.end())
            start = m.end()
        elif top not in ("(", "[") and not (python and top):
            if c == "\n" and not python and code[start : m.start()].rstrip().endswith(_GOES_ON):
                continue
            flush(m.end() if c == ";" and not python else m.start())
            start = m.end()
    flush(len(code))
    return out


def layout(text: str, suffix: str) -> Layout:
    """Lex a program text, emit it in the canonical layout and compare the two."""
    python = suffix == "py"
    code, strings, literal_chars, at, last, doc_chars = [], 0, 0, 0, "", 0
    for m in (_PYTHON if python else _BRACES).finditer(text):
        code.append(text[at : m.start()])
        last = code[-1].rstrip()[-1:] or last
        at = m.end()
        c = m[0].lstrip()[:2]
        if c[0] == "#" or c in ("//", "/*"):
            continue
        strings += 1
        literal_chars += len(m[0])
        if python and last in ("", ":") and m[0][:3] in ('"""', "'''"):
            doc_chars += len(m[0])
        else:
            last = '"'
        code.append('""')
    code.append(text[at:])
    bare = "".join(code)
    numbers = _NUMBER.findall(bare)
    literal_chars += sum(map(len, numbers))
    words = sum(w not in _AROUND for w in _WORD.findall(bare))
    rows = [x for x in map(str.strip, bare.split("\n")) if x]
    lines = emit(bare, python)
    bodies = [x.lstrip() for x in lines]
    known = set(bodies)
    shapes = len({_DIGITS.sub("0", x) for x in bodies}) / max(len(bodies), 1)
    inked = sum(map(len, bare.split()))
    dense = inked + literal_chars
    body = xxhash.xxh3_128_hexdigest("".join("".join(bodies).split()).encode("utf-8", "replace"))
    return Layout(len(rows), len(lines), shapes, sum(x in known for x in rows) / max(len(rows), 1), 1 - inked / max(len(bare.strip()), 1), strings + len(numbers), words, literal_chars / max(dense, 1), body, (literal_chars - doc_chars) / max(dense - doc_chars, 1), literal_chars - doc_chars)


def _head(text: str) -> str:
    """The comments before any code."""
    at = 0
    while m := _LEADING.match(text, at):
        at = m.end()
    return text[:at]


def _affirms(head: str) -> bool:
    """Whether a head says of its own file that it is generated, rather than mention such a mark."""
    said = _QUOTED.sub("''", head)
    return any(m["own"] or not _ABOUT.search(m["rest"]) for m in _AFFIRMS.finditer(said))


@dataclass(frozen=True)
class Judgement:
    """A file's kind and what told it, whether its place or notice says third party, and its comparison if it was lexed."""

    kind: str | None
    signal: str | None
    third_party: bool
    layout: Layout | None = None

    @property
    def body(self) -> str | None:
        return self.layout.body if self.layout and self.layout.canonical >= BODY_LINES else None


def judge(path: str, text: str) -> Judgement:
    """What a file is by itself; copies of other files' text are found among the judgements of all."""
    name = path.rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    head = _head(text)
    told = "place" if _VENDOR_DIR.search(path) else "notice" if _NOTICE.search(head) else None
    vendored = told is not None
    if suffix not in _PROGRAM:
        if _LOCK.search(path) or _LOCK_BODY.match(text):
            return Judgement("generated", "lock", vendored)
        if _MARK.search(head) and suffix != "md":
            return Judgement("generated", "mark", vendored)
        return Judgement("vendored", told, True) if vendored and suffix not in ("md", "") else Judgement(None, None, vendored)
    if text.lstrip()[:1] in ("{", "["):  # bare JSON: only its suffix is wrong
        return Judgement("generated", "lock", vendored) if _LOCK_BODY.match(text) else Judgement("vendored", told, True) if vendored else Judgement(None, None, False)
    s = layout(text, suffix)
    if s.canonical >= EXPANSION * max(s.lines, 1) and s.space < TIGHT:
        kind = "minified"
    elif s.literals >= TABLE_LITERALS and s.literals >= LITERALS_A_WORD * s.words and s.literal_share >= 0.4 and len(text) >= DATA_CHARS:
        kind = "data"
    elif s.data_share >= DATA_SHARE and s.data_chars >= DATA_CHARS and s.data_chars >= CHARS_A_WORD * s.words:
        kind = "data"
    elif s.canonical >= UNIFORM_LINES and s.shapes < UNIFORMITY:
        kind = "generated"
    elif _affirms(head):
        return Judgement("generated", "mark", vendored, s)
    else:
        return Judgement("vendored" if vendored else None, told, vendored, s)
    return Judgement(kind, "layout", vendored, s)


_SCHEMA = "repo_path string, path string, kind string, signal string, third_party boolean, body string"


def _judge(repos: list, paths: list, contents: list) -> dict[str, list]:
    got = [judge(p, t) for p, t in zip(paths, contents)]
    return {"repo_path": repos, "path": paths, "kind": [j.kind for j in got], "signal": [j.signal for j in got], "third_party": [j.third_party for j in got], "body": [j.body for j in got]}


def file_kinds(sources: DataFrame) -> DataFrame:
    """(repo_path, path, kind, signal): generated, minified, vendored or data; hand-written files have no row.

    ``signal`` is what told: layout, mark, lock, place, notice or body. A file whose canonical text
    (comments and layout aside) equals that of a file known as a
    third-party copy by place or notice is a copy too: bodies are pre-aggregated to one flag each
    before they are joined, so a body with any number of copies shuffles one row. Empty and null
    contents have no kind; null paths neither. Repeated scans fold into one row, the first by name.
    """
    wanted = sources.select("repo_path", "path", "content").filter((F.length("content") > 0) & F.col("path").isNotNull())
    judged = checkpoint(map_columns(spread(wanted), ["repo_path", "path", "content"], _judge, _SCHEMA))
    known = judged.filter("third_party and body is not null").select("body").distinct().withColumn("copy", F.lit(True))
    told = F.coalesce(F.when(F.col("kind").isNotNull(), F.struct("kind", "signal")), F.when(F.col("copy"), F.struct(F.lit("vendored").alias("kind"), F.lit("body").alias("signal"))))
    return judged.join(known, "body", "left").withColumn("told", told).filter("told is not null").groupBy("repo_path", "path").agg(F.min("told").alias("told")).select("repo_path", "path", "told.*")
