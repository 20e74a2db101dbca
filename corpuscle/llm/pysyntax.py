"""Python 3: a lexer with logical lines, and a parsing-expression grammar over its token kinds.

A logical line that holds a simple statement begins with a token of its own (``BEGIN``) whose partner
is the line's end; the first word of a compound statement's head has that partner too. So the grammar's
groups are brackets and whole lines, and the packrat memo shares both between files.
"""

from __future__ import annotations

import re
import unicodedata

from corpuscle.functions.lexing import END, Hole, Tokens

#: Reserved words, and words that are so only where a statement of theirs stands.
RESERVED = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
SOFT = "type match case".split()
KINDS = {w: chr(0x5400 + i) for i, w in enumerate(RESERVED + SOFT)}
NEWLINE, INDENT, DEDENT, BEGIN = "L", "I", "D", "B"
#: Operators that stand for themselves or share a kind.
OPS = {"->": "F", "...": "E", ":=": "W", "**": "P", "*": "*", "+": "+", "-": "-", "~": "~", "|": "|", "@": "@", "=": "=", ":": ":", ".": ".", ",": ",", ";": ";", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}"}
OPS |= dict.fromkeys("/", "/") | dict.fromkeys("// % << >> & ^".split(), "O") | dict.fromkeys("== != <= >= < >".split(), "C") | dict.fromkeys("+= -= *= /= //= %= @= &= |= ^= <<= >>= **=".split(), "A")
_OP = "|".join(re.escape(o) for o in sorted(OPS, key=lambda o: -len(o)))
_NUM = r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?"
_STR = r"(?P<p>[rRbBuUfF]{0,2})(?P<q>\"\"\"|'''|\"|')"
_TOKEN = re.compile(rf"[ \t\f]*(?:(?P<nl>\r?\n|\r)|(?P<c>#[^\r\n]*)|(?P<s>{_STR})|(?P<w>[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)|(?P<n>{_NUM})|(?P<o>{_OP})|(?P<j>\\(?:\r?\n|\r))|(?P<end>\Z))")
_REST = {q: re.compile(rf"[^\\{q[0]}\r\n]*(?:\\(?:\r\n|[\s\S])[^\\{q[0]}\r\n]*)*{q}") if len(q) == 1 else re.compile(rf"[^\\{q[0]}]*(?:(?:\\[\s\S]|{q[0]}(?!{q[0] * 2}))[^\\{q[0]}]*)*{q}") for q in ("'", '"', "'''", '"""')}
#: The prefixes that a string may have, in lower case.
_PREFIXES = {"", "r", "b", "u", "f", "br", "rb", "fr", "rf"}
_INDENT = re.compile(r"[ \t\f]*")
_BLANK = re.compile(r"[ \t\f]*(?:#[^\r\n]*)?(?:\r?\n|\r|\Z)")
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{0,2})|u([0-9a-fA-F]{0,4})|U([0-9a-fA-F]{0,8})|N(\{[^}]*\}?)?|[\s\S])")
_OCTAL, _WORD_BEHIND = re.compile(r"0[0-9_]+"), re.compile(r"(?:and|else|for|if|in|is|not|or)\b")
#: Fixed value: brackets that the language's reader takes within each other.
_DEEPEST = 200
_LEADS = {KINDS[w] for w in ("if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class", "async")} | {"@"}


class _Stop(Exception):
    """Where lexing can't go on."""


def _escapes_hold(body: str, binary: bool) -> bool:
    for m in _ESCAPE.finditer(body):
        c = m[0][1:2]
        if c == "x" and len(m[1]) < 2 or not binary and (c == "u" and len(m[2]) < 4 or c == "U" and (len(m[3]) < 8 or int(m[3], 16) > 0x10FFFF)):
            return False
        if c == "N" and not binary:
            try:
                if not (m[4] and m[4].endswith("}")):
                    return False
                unicodedata.lookup(m[4][1:-1])
            except KeyError:
                return False
    return True


class _Lexer:
    def __init__(self, text: str):
        self.text, self.out = text, Tokens()
        self.kinds: list[str] = []
        self.spans = self.out.spans

    def emit(self, kind: str, a: int, b: int) -> None:
        self.kinds.append(kind)
        self.spans.append((a, b))

    def string(self, m: re.Match) -> tuple[int, str]:
        """(end, kind) of the string that ``m`` opens."""
        prefix, q = m["p"].lower(), m["q"]
        if prefix not in _PREFIXES:
            raise _Stop(m.start("s"))
        if "f" in prefix:
            return self.formatted(m.end(), q, "r" in prefix, m.start("s")), "s"
        r = _REST[q].match(self.text, m.end())
        if not r:
            raise _Stop(m.start("s"))
        body = r[0][: -len(q)]
        binary = "b" in prefix
        if binary and not body.isascii() or "r" not in prefix and "\\" in body and not _escapes_hold(body, binary):
            raise _Stop(m.start("s"))
        return r.end(), "b" if binary else "s"

    def formatted(self, at: int, q: str, raw: bool, start: int, spec: bool = False) -> int:
        """End of the formatted string whose inside starts at ``at``, or of a format specification (at its brace)."""
        text, n = self.text, len(self.text)
        long = len(q) == 3
        while at < n:
            c = text[at]
            if text.startswith(q, at):
                if spec:
                    raise _Stop(at)
                return at + len(q)
            if c in "\r\n" and not long:
                raise _Stop(start)
            if c == "\\" and not raw:
                e = _ESCAPE.match(text, at)
                if not e or text[at + 1 : at + 2] not in "{}" and not _escapes_hold(e[0], False):
                    raise _Stop(at)
                at = e.end() if text[at + 1] not in "{}" else at + 1
            elif c == "\\" and text[at + 1 : at + 2] not in "{}":
                at += 2
            elif c == "{":
                if text.startswith("{{", at) and not spec:
                    at += 2
                else:
                    at = self.field(at + 1, q, raw, start)
            elif c == "}":
                if spec:
                    return at
                if not text.startswith("}}", at):
                    raise _Stop(at)
                at += 2
            else:
                at += 1
        raise _Stop(start)

    def field(self, at: int, q: str, raw: bool, start: int) -> int:
        """End of the replacement field whose expression starts at ``at``."""
        inner = _Lexer(self.text)
        begin = at
        depth, text = 0, self.text
        lambdas = False
        while True:
            m = _TOKEN.match(text, at)
            if not m or m.lastgroup == "end":
                if m is None and text[at : at + 1] == "!" or text[_skip(text, at) : _skip(text, at) + 1] == "!":
                    at = _skip(text, at)
                    break
                raise _Stop(at)
            g = "s" if m["s"] else m.lastgroup
            a = m.start(g)
            if g in ("nl", "c", "j"):
                at = m.end()
                continue
            if g == "s":
                end, kind = inner.string(m)
                inner.emit(kind, a, end)
                at = end
                continue
            value = m[g]
            if g == "o":
                if not depth:
                    if value[0] in ":}" or value == "=":
                        at = a
                        break
                depth += (value in "([{") - (value in ")]}")
                if depth < 0:
                    raise _Stop(a)
            k = OPS[value] if g == "o" else KINDS.get(value, "i") if g == "w" else "n"
            lambdas |= k == KINDS["lambda"] and not depth
            inner.emit(k, a, m.end())
            at = m.end()
        if not inner.kinds or lambdas:
            raise _Stop(at)
        inner.out.kinds = "".join(inner.kinds) + END
        self.out.holes.append(Hole("f", begin, inner.out, at))
        if text[at] == "=":
            at = _skip(text, at + 1)
        if text[at : at + 1] == "!":
            m = re.compile(r"!\s*[rsa](?!\w)\s*").match(text, at)
            if not m:
                raise _Stop(at)
            at = m.end()
        if text[at : at + 1] == ":":
            at = self.formatted(at + 1, q, raw, start, True)
        if text[at : at + 1] != "}":
            raise _Stop(at)
        return at + 1

    def run(self) -> None:
        text, n = self.text, len(self.text)
        at = 0
        depth: list[str] = []
        levels: list[tuple[int, int]] = [(0, 0)]
        blocks: list[bool] = [False]  # whether a block holds the cases of a match
        fresh, first, after_match = True, 0, False
        match, words, kind, span = _TOKEN.match, KINDS, self.kinds.append, self.spans.append
        while True:
            if fresh and not depth:
                b = _BLANK.match(text, at)
                while b and b.end() > at:
                    at = b.end()
                    b = _BLANK.match(text, at)
                if at >= n:
                    break
                lead = _INDENT.match(text, at)
                width = wide = lead.end() - at
                if lead[0].strip(" "):
                    width = wide = 0
                    for c in lead[0]:
                        if c == "\t":
                            width, wide = width // 8 * 8 + 8, wide + 1
                        elif c == " ":
                            width, wide = width + 1, wide + 1
                        else:
                            width = wide = 0
                if (width, wide) != levels[-1]:
                    if width > levels[-1][0] and wide > levels[-1][1]:
                        levels.append((width, wide))
                        blocks.append(after_match)
                        if len(levels) > 100:
                            raise _Stop(at)
                        self.emit(INDENT, at, at)
                    else:
                        while levels[-1][0] > width:
                            levels.pop()
                            blocks.pop()
                            self.emit(DEDENT, at, at)
                        if levels[-1] != (width, wide):
                            raise _Stop(at)
                after_match = False
                at, fresh, first = lead.end(), False, len(self.kinds)
            m = match(text, at)
            if not m:
                raise _Stop(_skip(text, at))
            g = m.lastgroup
            a, at = m.span(g)
            if g == "w":
                value = m[g]
                k = words.get(value, "i")
                if k == "i" and not value.isascii() and not unicodedata.normalize("NFKC", value).isidentifier():
                    raise _Stop(a)
            elif g == "o":
                k = OPS[m[g]]
                if k in "([{":
                    depth.append(k)
                    if len(depth) > _DEEPEST:
                        raise _Stop(a)
                elif k in ")]}":
                    if not depth or "([{".index(depth.pop()) != ")]}".index(k):
                        raise _Stop(a)
            elif g in ("nl", "end"):
                if not depth:
                    after_match = self.line(first, a, at, blocks[-1])
                    fresh = True
                elif g == "end":
                    raise _Stop(n)
                if g == "end":
                    break
                continue
            elif g == "s":
                at, k = self.string(m)
            elif g == "n":
                value, k = m[g], "n"
                behind = text[at : at + 1]
                if value[0] == "0" and _OCTAL.fullmatch(value) and value.strip("0_") or behind == "_" or behind.isalnum() and not _WORD_BEHIND.match(text, at):
                    raise _Stop(a)
            else:
                if g == "j" and at >= n:
                    raise _Stop(at)
                continue
            kind(k)
            span((a, at))
        while len(levels) > 1:
            levels.pop()
            self.emit(DEDENT, n, n)

    def line(self, first: int, a: int, b: int, cases: bool) -> bool:
        """End a logical line and mark its beginning; whether it is the head of a match statement."""
        kinds = self.kinds
        k = kinds[first]
        last = kinds[-1]
        soft = False
        if k == KINDS["match"] and last == ":" and len(kinds) > first + 2:
            soft = True
        elif k == KINDS["case"]:
            soft = cases
        if not (k in _LEADS or soft):
            kinds.insert(first, BEGIN)
            self.spans.insert(first, (self.spans[first][0], self.spans[first][0]))
        elif soft:
            kinds[first] = "M" if k == KINDS["match"] else "K"
        self.emit(NEWLINE, a, b)
        return soft and k == KINDS["match"]


def _skip(text: str, at: int) -> int:
    while text[at : at + 1] in (" ", "\t", "\f", "\n", "\r") and at < len(text):
        at += 1
    return at


def lex_python(text: str) -> Tokens:
    """Tokens of a Python text; ``error`` is where lexing failed, ``mate`` the partners of brackets and line beginnings."""
    x = _Lexer(text)
    try:
        if "\0" in text:
            raise _Stop(text.index("\0"))
        x.run()
    except _Stop as e:
        x.out.error = e.args[0]
    out = x.out
    out.kinds = "".join(x.kinds) + END
    out.breaks = "0" * len(out.kinds)
    out.mate = mates(out.kinds)
    return out


def mates(kinds: str) -> list[int]:
    """Partners of brackets, and of the first token of each logical line its end."""
    out, stack = [-1] * len(kinds), []
    for m in _BRACKET.finditer(kinds):
        if m[0] in "([{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    for m in _LOGICAL.finditer(kinds):
        out[m.start()] = m.end() - 1
    return out


_BRACKET = re.compile(r"[()\[\]{}]")
_LOGICAL = re.compile(r"[^IDL\0][^L\0]*L")


GRAMMAR = """
File <- Stmt* END
Stmt <- SimpleLine / If / For / While / Try / With / Def / Class / Decorated / Match
@group SimpleLine <- BEGIN Simples NEWLINE
Simples <- Simple (';' Simple)* ';'?
Suite <- INDENT Stmt+ DEDENT
If <- (IfOpen Suite / IfInline) ((ElifOpen Suite / ElifInline))* Else?
@group IfOpen <- 'if' Named ':' NEWLINE
@group IfInline <- 'if' Named ':' Simples NEWLINE
@group ElifOpen <- 'elif' Named ':' NEWLINE
@group ElifInline <- 'elif' Named ':' Simples NEWLINE
Else <- ElseOpen Suite / ElseInline
@group ElseOpen <- 'else' ':' NEWLINE
@group ElseInline <- 'else' ':' Simples NEWLINE
While <- (WhileOpen Suite / WhileInline) Else?
@group WhileOpen <- 'while' Named ':' NEWLINE
@group WhileInline <- 'while' Named ':' Simples NEWLINE
For <- (ForOpen Suite / ForInline) Else?
@group ForOpen <- 'async'? 'for' TargetList 'in' StarExprs ':' NEWLINE
@group ForInline <- 'async'? 'for' TargetList 'in' StarExprs ':' Simples NEWLINE
Try <- (TryOpen Suite / TryInline) ((ExceptOpen Suite / ExceptInline)+ Else? Finally? / Finally)
@group TryOpen <- 'try' ':' NEWLINE
@group TryInline <- 'try' ':' Simples NEWLINE
@group ExceptOpen <- 'except' ('*'? Test ('as' ID)?)? ':' NEWLINE
@group ExceptInline <- 'except' ('*'? Test ('as' ID)?)? ':' Simples NEWLINE
Finally <- FinallyOpen Suite / FinallyInline
@group FinallyOpen <- 'finally' ':' NEWLINE
@group FinallyInline <- 'finally' ':' Simples NEWLINE
With <- WithOpen Suite / WithInline
@group WithOpen <- 'async'? 'with' (WithParen ':' / WithItem (',' WithItem)* ':') NEWLINE
@group WithInline <- 'async'? 'with' (WithParen ':' / WithItem (',' WithItem)* ':') Simples NEWLINE
@group WithParen <- '(' WithItem (',' WithItem)* ','? ')'
WithItem <- Test 'as' StarTarget &(',' / ')' / ':') / Test
Def <- DefOpen Suite / DefInline
@group DefOpen <- 'async'? 'def' ID TypeParams? Params ('->' Test)? ':' NEWLINE
@group DefInline <- 'async'? 'def' ID TypeParams? Params ('->' Test)? ':' Simples NEWLINE
Class <- ClassOpen Suite / ClassInline
@group ClassOpen <- 'class' ID TypeParams? Args? ':' NEWLINE
@group ClassInline <- 'class' ID TypeParams? Args? ':' Simples NEWLINE
Decorated <- Decorator+ (Def / Class)
@group Decorator <- '@' Named NEWLINE
Match <- MatchHead INDENT Case+ DEDENT
@group MatchHead <- MATCH (StarNamed ',' (StarNamed (',' StarNamed)* ','?)? / Named) ':' NEWLINE
Case <- CaseOpen Suite / CaseInline
@group CaseOpen <- CASE Patterns ('if' Named)? ':' NEWLINE
@group CaseInline <- CASE Patterns ('if' Named)? ':' Simples NEWLINE
Patterns <- PatternItem ',' (PatternItem (',' PatternItem)* ','?)? / AsPattern
PatternItem <- '*' ID / AsPattern
AsPattern <- Pattern ('|' Pattern)* ('as' ID)?
Pattern <- '-'? NUM (('+' / '-') NUM)? / STRINGS / 'None' / 'True' / 'False' / ID ('.' ID)* PatternArgs? / PatternGroup / PatternList / PatternMap
@group PatternArgs <- '(' (PatternArg (',' PatternArg)* ','?)? ')'
PatternArg <- ID '=' AsPattern / AsPattern
@group PatternGroup <- '(' (PatternItem (',' PatternItem)* ','?)? ')'
@group PatternList <- '[' (PatternItem (',' PatternItem)* ','?)? ']'
@group PatternMap <- '{' (PatternEntry (',' PatternEntry)* ','?)? '}'
PatternEntry <- '**' ID / ('-'? NUM (('+' / '-') NUM)? / STRINGS / 'None' / 'True' / 'False' / ID ('.' ID)+) ':' AsPattern
Simple <- 'return' StarExprs? / 'pass' / 'break' / 'continue' / 'raise' (Test ('from' Test)?)? / 'assert' Test (',' Test)? / 'del' DelTarget (',' DelTarget)* ','? / ('global' / 'nonlocal') ID (',' ID)* / 'import' Imported (',' Imported)* / From / Yield / TypeAlias / Assignment / StarExprs
Imported <- ID ('.' ID)* ('as' ID)?
From <- 'from' (('.' / '...')* ID ('.' ID)* / ('.' / '...')+) 'import' ('*' / FromNames / FromName (',' FromName)*)
@group FromNames <- '(' FromName (',' FromName)* ','? ')'
FromName <- ID ('as' ID)?
TypeAlias <- 'type' ID TypeParams? '=' Test
TypeParams <- TypeBox
@group TypeBox <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- ('*' / '**')? ID (':' Test)? ('=' StarExpr)?
Assignment <- (TargetList '=')+ (Yield / StarExprs) !'=' / Single AUG (Yield / StarExprs) / Single ':' Test ('=' (Yield / StarExprs))?
Single <- Place / ID / SingleParen
@group SingleParen <- '(' Single ')'
Place <- Atom (Trailer &TRAILER)* ('.' ID / Index)
TargetList <- StarTarget (',' StarTarget)* ','?
StarTarget <- '*'? Target
Target <- Place !TRAILER / ID !TRAILER / TargetParen / TargetBox
@group TargetParen <- '(' (Target &')' / StarTarget ',' (StarTarget (',' StarTarget)* ','?)?)? ')'
@group TargetBox <- '[' TargetList? ']'
DelTarget <- (Place / ID / DelParen / DelBox) !TRAILER
@group DelParen <- '(' (DelTarget (',' DelTarget)* ','?)? ')'
@group DelBox <- '[' (DelTarget (',' DelTarget)* ','?)? ']'
Yield <- 'yield' ('from' Test / StarExprs?)
StarExprs <- StarExpr (',' StarExpr)* ','?
StarExpr <- '*' Arith / Test
StarNamed <- '*' Arith / Named
Named <- ID ':=' Test / Test
Test <- Lambda / Or ('if' Or 'else' Test)?
Or <- Not (('or' / 'and') Not)*
Not <- 'not'* Compare
Compare <- Arith (CompareOp Arith)*
CompareOp <- COMPARE / 'in' / 'not' 'in' / 'is' 'not'?
Arith <- Unary (BINARY Unary)*
Unary <- ('+' / '-' / '~')* 'await'? Atom Trailer*
Trailer <- '.' ID / Args / Index
Atom <- ID / NUM / STRINGS / 'None' / 'True' / 'False' / '...' / Paren / List / Braces
STRINGS <- STR+ / BYTES+
@group Paren <- '(' (Yield / Named CompFor / StarNamed ',' (StarNamed (',' StarNamed)* ','?)? / Named)? ')'
@group List <- '[' (Named CompFor / StarNamed (',' StarNamed)* ','?)? ']'
@group Braces <- '{' (Test ':' Test CompFor / Entry (',' Entry)* ','? / Named CompFor / StarNamed (',' StarNamed)* ','?)? '}'
Entry <- '**' Arith / Test ':' Test
CompFor <- ('async'? 'for' TargetList 'in' Or ('if' Or)*)+
Lambda <- 'lambda' LambdaParams? ':' Test
@group Args <- '(' (Named CompFor &')' / ArgList ','?)? ')'
ArgList <- Positional (',' Positional)* (',' Keywords)? / Keywords
Positional <- '*' Test / Named !'='
Keywords <- Starred (',' Starred)* (',' Doubled (',' Doubled)*)? / Doubled (',' Doubled)*
Starred <- ID '=' Test / '*' Test
Doubled <- ID '=' Test / '**' Test
@group Index <- '[' Slice (',' Slice)* ','? ']'
Slice <- '*' Arith / Test? ':' Test? (':' Test?)? / Named
@group Params <- '(' (ParamList ','?)? ')'
ParamList <- Plain (',' Plain)* (',' Given)* (',' '/' (',' Plain)* (',' Given)*)? (',' Rest)? / Given (',' Given)* (',' '/' (',' Given)*)? (',' Rest)? / Rest
Plain <- ID (':' Test)? !'='
Given <- ID (':' Test)? '=' Test
Rest <- '*' ID (':' StarExpr)? (',' Keyword)* (',' Last)? / '*' (',' Keyword)+ (',' Last)? / Last
Keyword <- ID (':' Test)? ('=' Test)?
Last <- '**' ID (':' Test)?
LambdaParams <- LambdaList ','?
LambdaList <- Bare (',' Bare)* (',' Set)* (',' '/' (',' Bare)* (',' Set)*)? (',' LambdaRest)? / Set (',' Set)* (',' '/' (',' Set)*)? (',' LambdaRest)? / LambdaRest
Bare <- ID !'='
Set <- ID '=' Test
LambdaRest <- '*' ID (',' LambdaKeyword)* (',' '**' ID)? / '*' (',' LambdaKeyword)+ (',' '**' ID)? / '**' ID
LambdaKeyword <- ID ('=' Test)?
"""
