"""Lexers for Go, Java and JSON, in the token kinds of :mod:`corpuscle.functions.lexing`."""

from __future__ import annotations

import re

from corpuscle.functions.lexing import END, NUMBER, Tokens, codes, operators

#: Reserved and contextual words of the languages.
GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
JAVA_RESERVED = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
JAVA_CONTEXT = "record var yield sealed permits non when".split()
GO_KINDS = codes(GO_WORDS, 0x5000)
JAVA_KINDS = codes(JAVA_RESERVED + JAVA_CONTEXT, 0x5200)

#: Operators that stand for themselves or share a kind.
GO_OPS = {":=": "D", "...": "E", "++": "U", "--": "U", "<-": "R", "&": "&", "*": "*", "+": "+", "-": "-", "!": "!", "^": "^", "~": "~", "|": "|", "=": "=", ":": ":", ".": ".", ",": ",", ";": ";", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}"}
GO_BINARY = "/ % == != < <= > >= && || << >> &^".split()
GO_ASSIGN = "+= -= *= /= %= &= |= ^= <<= >>= &^=".split()
JAVA_OPS = {"->": "F", "...": "E", "::": "C", "++": "U", "--": "U", ">=": "G", "+": "+", "-": "-", "!": "!", "~": "~", "*": "*", "|": "|", "&": "&", "<": "<", ">": ">", "=": "=", "?": "?", ":": ":", ".": ".", ",": ",", ";": ";", "@": "@", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}"}
JAVA_BINARY = "/ % == != <= && || ^ <<".split()
JAVA_ASSIGN = "+= -= *= /= %= &= |= ^= <<=".split()

GO_TABLE, _go = operators(GO_OPS, GO_BINARY, GO_ASSIGN)
JAVA_TABLE, _java = operators(JAVA_OPS, JAVA_BINARY, JAVA_ASSIGN)
_GO = re.compile(rf"(?P<ws>[ \t\r﻿]+)|(?P<nl>\n)|(?P<w>[^\W\d]\w*)|(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n][^'\n]*)')|(?P<n>(?:{NUMBER})i?)|(?P<o>{_go})")
_JAVA = re.compile(rf'(?P<ws>[ \t\r\f﻿]+)|(?P<nl>\n\s*)|(?P<w>[^\W\d]\w*|\$[\w$]*)|(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|(?P<s>"""[\s\S]*?(?<!\\)"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\[^\n][^\'\n]*)\')|(?P<n>(?:{NUMBER})[lLfFdD]?)|(?P<o>{_java})')
_JSON = re.compile(r'(?P<ws>[ \t\r\n]+)|(?P<s>"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(?P<n>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<w>true|false|null)|(?P<o>[\[\]{},:])')


def lex_go(text: str) -> Tokens:
    """Go tokens with the semicolons that line ends imply."""
    out = Tokens()
    kinds, spans, end, last = [], out.spans, 0, ";"
    closing = set("ins)]}U") | {GO_KINDS[w] for w in ("break", "continue", "fallthrough", "return")}
    for m in _GO.finditer(text):
        if m.start() != end:
            break
        g, end = m.lastgroup, m.end()
        if g == "ws":
            continue
        if g == "nl" or g == "c" and (m[0].startswith("//") is False and "\n" in m[0]):
            if last in closing:
                kinds.append(";")
                spans.append(m.span())
                last = ";"
            if g == "c":
                out.comments.append(m.span())
            continue
        if g == "c":
            out.comments.append(m.span())
            continue
        k = GO_KINDS.get(m[0], "i") if g == "w" else GO_TABLE[m[0]] if g == "o" else g
        kinds.append(k)
        spans.append(m.span())
        last = k
    if end != len(text):
        out.error = end
    if last in closing:
        kinds.append(";")
        spans.append((len(text), len(text)))
    out.kinds, out.breaks = "".join(kinds) + END, "0" * (len(kinds) + 1)
    return out


def _lex_plain(pattern: re.Pattern, words: dict[str, str], ops: dict[str, str], text: str) -> Tokens:
    out = Tokens()
    kinds, spans, end = [], out.spans, 0
    for m in pattern.finditer(text):
        if m.start() != end:
            break
        g, end = m.lastgroup, m.end()
        if g in ("ws", "nl"):
            continue
        if g == "c":
            out.comments.append(m.span())
            continue
        kinds.append(words.get(m[0], "i") if g == "w" else ops.get(m[0], m[0]) if g == "o" else g)
        spans.append(m.span())
    if end != len(text):
        out.error = end
    out.kinds, out.breaks = "".join(kinds) + END, "0" * (len(kinds) + 1)
    return out


def lex_java(text: str) -> Tokens:
    """Java tokens."""
    return _lex_plain(_JAVA, JAVA_KINDS, JAVA_TABLE, text)


def lex_json(text: str) -> Tokens:
    """JSON tokens (RFC 8259); a leading byte-order mark is passed over."""
    return _lex_plain(_JSON, {"true": "w", "false": "w", "null": "w"}, {}, text.removeprefix("﻿"))
