"""The lexer for JavaScript and TypeScript.

A token is (kind, start, end); kinds are single characters so that a file's tokens form a string.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

#: Kind of the token behind the last.
END = "\0"
_OPEN, _CLOSE = "([{", ")]}"

#: Reserved and contextual words of the languages.
JS_RESERVED = "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split()
JS_CONTEXT = "let static async await yield of get set as from type interface implements namespace module declare abstract public private protected readonly override accessor keyof infer unique is asserts satisfies global undefined".split()


def codes(words: list[str], base: int) -> dict[str, str]:
    """A kind of its own for each word."""
    return {w: chr(base + j) for j, w in enumerate(words)}


JS_KINDS = codes(JS_RESERVED + JS_CONTEXT, 0x4E00)

_STR2 = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
_STR1 = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
NUMBER = r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?"
_WORD = r"[^\W\d][\w$]*|[$#][\w$]+|\$"

#: Operators that stand for themselves or share a kind.
JS_OPS = {"=>": "F", "...": "E", "?.": "Q", "++": "U", "--": "U", ">=": "G", "+": "+", "-": "-", "!": "!", "~": "~", "*": "*", "|": "|", "&": "&", "<": "<", ">": ">", "=": "=", "?": "?", ":": ":", ".": ".", ",": ",", ";": ";", "@": "@", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}"}
JS_BINARY = "/ % ** == != === !== <= && || ?? ^ <<".split()
JS_ASSIGN = "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split()


def operators(single: dict[str, str], binary: list[str], assign: list[str]) -> tuple[dict[str, str], str]:
    """(kind of each operator, the pattern of all)."""
    table = single | dict.fromkeys(binary, "B") | dict.fromkeys(assign, "A")
    return table, "|".join(re.escape(o) for o in sorted(table, key=lambda o: -len(o)))


_JS_OPS, _js = operators(JS_OPS, JS_BINARY, JS_ASSIGN)
_JS_SPACE = r"[ \t\r\f\v﻿ ]"
_JS = re.compile(rf"{_JS_SPACE}*(?:(?P<nl>\n\s*|[  ])|(?P<w>{_WORD})|(?P<c>//[^\n]*|/\*[\s\S]*?\*/|<!--[^\n]*)|(?P<s>{_STR2}|{_STR1})|(?P<n>{NUMBER})|(?P<o>{_js})|(?P<t>`)|(?P<bad>[\s\S])|(?P<end>\Z))", re.U)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`]*\})*`")
#: After these kinds an operator follows, so that "/" divides and "<" compares.
_AFTER_VALUE = set("insrtx)]}U") | {JS_KINDS[w] for w in JS_CONTEXT if w not in ("await", "yield", "of")} | {JS_KINDS[w] for w in ("this", "super", "null", "true", "false")}

_HEADS = {JS_KINDS[w] for w in ("if", "while", "for", "with")}


@dataclass
class Tokens:
    """Kinds (ended by END), where each token starts and ends, a line-break flag each, comments, where lexing failed, bracket partners once known, code within templates and JSX."""

    kinds: str = END
    breaks: str = "1"
    spans: list[tuple[int, int]] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)
    error: int = -1
    mate: list[int] | None = None
    holes: list[Hole] = field(default_factory=list)
    closed: bool = False


@dataclass
class Hole:
    """Code in braces within a template (kind t) or JSX element (v: an attribute's value, s: attributes spread, c: a child): its tokens and where its brace closes, -1 if lexing did not reach that."""

    kind: str
    start: int
    toks: Tokens
    end: int = -1


#: Names and members, which are an expression whatever stands around.
_PLAIN_HOLE = re.compile(r"\s*([A-Za-z_$][\w$]*)(?:\.[A-Za-z_$][\w$]*)*\s*\}")
_TEMPLATE_CHARS = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")


class _Within:
    """Ends of templates and JSX elements by lexing the code within them, each position once."""

    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx = text, jsx
        self.known: dict[tuple[str, int], tuple[int, list[Hole]]] = {}
        self.lexed: dict[int, tuple[Tokens, int]] = {}
        self.open = -1  # the last brace known not to be closed, so none around it is

    def end(self, kind: str, at: int) -> tuple[int, list[Hole]]:
        """(end of the template (t) or element (x) at ``at``, -1 if there is none, and the code within)."""
        got = self.known.get((kind, at))
        if got is None:
            holes: list[Hole] = []
            e = (self._template if kind == "t" else self._element)(at, holes)
            got = self.known[kind, at] = (e, holes)
        return got

    def _hole(self, at: int, kind: str, holes: list[Hole]) -> int:
        """End of the braces whose code starts at ``at``; if it cannot be lexed, where brackets alone put it."""
        m = _PLAIN_HOLE.match(self.text, at)
        if m and m[1] not in JS_KINDS and kind != "s":
            return m.end()
        got = self.lexed.get(at)
        if got is None:
            toks = _lex_js(self.text, self.jsx, at, self)
            got = self.lexed[at] = (toks, toks.spans.pop()[1] - 1 if toks.closed else -1)
            if got[1] >= 0:
                toks.kinds, toks.breaks = toks.kinds[:-2] + END, toks.breaks[:-2] + "1"
        holes.append(Hole(kind, at, *got))
        if got[1] >= 0:
            return got[1] + 1
        end = _braces(self.text, at - 1) if at > self.open else -1
        if end < 0:
            self.open = max(self.open, at)
        return end

    def _template(self, at: int, holes: list[Hole]) -> int:
        text = self.text
        at += 1
        while True:
            at = _TEMPLATE_CHARS.match(text, at).end()
            if text[at : at + 1] == "`":
                return at + 1
            if text[at : at + 2] != "${":
                return -1
            at = self._hole(at + 2, "t", holes)
            if at < 0:
                return -1

    def _element(self, at: int, holes: list[Hole]) -> int:
        return _jsx(self.text, at, lambda a, kind: self._hole(a + 1, kind, holes))


def _template(text: str, at: int) -> int:
    """End of the template literal at ``at``, which may nest; -1 if it is not closed."""
    m = _TEMPLATE.match(text, at)
    if m:
        return m.end()
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "`":
            return i + 1
        if c == "\\":
            i += 2
        elif c == "$" and text[i + 1 : i + 2] == "{":
            depth, i = 1, i + 2
            while i < n and depth:
                c = text[i]
                if c == "`":
                    i = _template(text, i)
                    if i < 0:
                        return -1
                    continue
                if c in "'\"":
                    m = re.compile(_STR1 if c == "'" else _STR2).match(text, i)
                    if m:
                        i = m.end()
                        continue
                depth += (c == "{") - (c == "}")
                i += 1
        else:
            i += 1
    return -1


_TAG = re.compile(r"<(/?)([A-Za-z_$][\w$.:-]*)?")
_ATTR = re.compile(r"\s*(?:[\w$:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(\{)))?|(\{))")


def _braces(text: str, at: int) -> int:
    depth, n = 0, len(text)
    while at < n:
        c = text[at]
        if c == "`":
            at = _template(text, at)
            if at < 0:
                return -1
            continue
        depth += (c == "{") - (c == "}")
        at += 1
        if not depth:
            return at
    return -1


def _jsx(text: str, at: int, hole: Callable[[int, str], int] | None = None) -> int:
    """End of the JSX element at ``at``; -1 if there is none. ``hole`` ends the braces at a place, given what they are."""
    hole = hole or (lambda a, _: _braces(text, a))
    stack: list[str] = []
    n = len(text)
    while at < n:
        if text[at] == "<":
            m = _TAG.match(text, at)
            name, at = m[2] or "", m.end()
            while not m[1]:
                a = _ATTR.match(text, at)
                if not a or a.end() == at:
                    break
                at = a.end()
                if a[1] or a[2]:
                    at = hole(at - 1, "v" if a[1] else "s")
                    if at < 0:
                        return -1
            e = re.compile(r"\s*(/?)>").match(text, at)
            if not e:
                return -1
            at = e.end()
            if m[1]:
                if not stack or stack.pop() != name:
                    return -1
            elif not e[1]:
                stack.append(name)
            if not stack:
                return at
        elif text[at] == "{":
            at = hole(at, "c")
            if at < 0:
                return -1
        else:
            at += 1
    return -1


def lex_js(text: str, jsx: bool = True, holes: bool = False) -> Tokens:
    """JavaScript and TypeScript tokens; regular expressions, templates and JSX elements are one token each.

    With ``holes`` the code within templates and JSX elements is lexed too.
    """
    return _lex_js(text, jsx, -1, _Within(text, jsx) if holes else None)


def _lex_js(text: str, jsx: bool, start: int, within: _Within | None) -> Tokens:
    """Tokens from ``start`` to the first "}" without a partner, or of a whole text if ``start`` is -1."""
    out = Tokens()
    kinds, breaks, spans = [], [], out.spans
    pos, n, last, brk = max(start, 0), len(text), ";" if start < 0 else "(", "1"
    heads: list[bool] = []
    depth = -1 if start < 0 else 0
    if start < 0 and text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else n
    words = JS_KINDS
    while pos < n:
        restart = -1
        end = pos
        for m in _JS.finditer(text, pos):
            if m.start() != end:
                break
            end = m.end()
            g = m.lastgroup
            if g == "nl":
                brk = "1"
                continue
            if g == "end":
                continue
            span = m.span(g)
            if g == "bad":
                end = span[0]
                break
            if g == "w":
                k = words.get(m[g], "i") if last not in ".Q" else "i"
            elif g == "o":
                s = m[g]
                if s[0] == "/" and last not in _AFTER_VALUE:
                    r = _REGEX.match(text, span[0])
                    if not r:
                        end = span[0]
                        break
                    kinds.append("r")
                    breaks.append(brk)
                    spans.append(r.span())
                    last, brk, restart = "r", "0", r.end()
                    break
                if s[0] == "<" and jsx and last not in _AFTER_VALUE and re.match(r"<(?:>|[A-Za-z])", text[span[0] : span[0] + 2]):
                    e, inner = within.end("x", span[0]) if within else (_jsx(text, span[0]), [])
                    if e > 0:
                        out.holes += inner
                        kinds.append("x")
                        breaks.append(brk)
                        spans.append((span[0], e))
                        last, brk, restart = "x", "0", e
                        break
                    if within and 0 <= start < within.open:  # no brace around can be closed
                        end = span[0]
                        break
                k = _JS_OPS[s]
                if depth >= 0 and k in "{}":
                    depth += 1 if k == "{" else -1
                    if depth < 0:
                        kinds.append(k)
                        breaks.append(brk)
                        spans.append(span)
                        out.closed, end = True, n
                        break
                if k == "(":
                    heads.append(last in _HEADS)
                elif k == ")" and heads and heads.pop():  # a statement follows, so "/" opens a regular expression
                    kinds.append(k)
                    breaks.append(brk)
                    spans.append(span)
                    last, brk = ";", "0"
                    continue
            elif g == "c":
                out.comments.append(span)
                if "\n" in m[g]:
                    brk = "1"
                continue
            elif g == "t":
                e, inner = within.end("t", span[0]) if within else (_template(text, span[0]), [])
                if e < 0:
                    end = span[0]
                    break
                out.holes += inner
                kinds.append("t")
                breaks.append(brk)
                spans.append((span[0], e))
                last, brk, restart = "t", "0", e
                break
            else:
                k = g
            kinds.append(k)
            breaks.append(brk)
            spans.append(span)
            last, brk = k, "0"
        if restart >= 0:
            pos = restart
        elif end >= n:
            break
        else:
            out.error = end
            break
    out.kinds, out.breaks = "".join(kinds) + END, "".join(breaks) + "1"
    return out


def partners(kinds: str) -> tuple[list[int], int]:
    """For each opening bracket the number of its partner (-1 elsewhere), and the first misfit (-1: none)."""
    out, stack = [-1] * len(kinds), []
    for m in re.finditer(r"[()\[\]{}]", kinds):
        c, i = m[0], m.start()
        if c in _OPEN:
            stack.append(i)
        elif not stack or _OPEN.index(kinds[stack[-1]]) != _CLOSE.index(c):
            return out, i
        else:
            out[stack.pop()] = i
    return out, (len(kinds) - 1 if stack else -1)
