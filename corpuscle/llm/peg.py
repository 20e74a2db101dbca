"""Packrat parsing-expression grammars over token kinds.

A grammar is text; :func:`compile_grammar` turns each rule into one Python function over a string of
token kinds (one character a token). Ordered choices test the first sets of their alternatives before
they are entered. Rules marked ``@group`` begin with an opening bracket and end at its partner, so
their result depends on the kinds between the two alone: their packrat memo is keyed by those kinds
instead of by a position, and is shared between files. On failure the same grammar is run once more
in a variant that records the furthest token at which anything failed.

Notation: ``Rule <- a b / c``, ``* + ?``, ``& !``, parentheses, ``'literal'`` for a token, upper-case
names for token classes, ``NL`` (a line break stands before the token), ``.`` (any token).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

from corpuscle.functions.lexing import END

#: Bounds of the shared memo: entries, and tokens of a group that enters it.
_MEMO_ENTRIES, _SHARED_TOKENS = 200_000, 200
_TOKEN = re.compile(r"\s*(?:(@group)|([A-Za-z_]\w*)(\s*<-)?|'([^']+)'|(.))", re.S)


def _read(text: str) -> dict[str, tuple[bool, tuple]]:
    toks: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(re.sub(r"(?m)--.*$", "", text).strip()):
        if m[1]:
            toks.append(("group", ""))
        elif m[2]:
            toks.append(("def" if m[3] else "name", m[2]))
        elif m[4]:
            toks.append(("lit", m[4]))
        elif m[5].strip():
            toks.append(("op", m[5]))
    toks.append(("end", ""))
    at = 0

    def choice() -> tuple:
        nonlocal at
        alts = [sequence()]
        while toks[at] == ("op", "/"):
            at += 1
            alts.append(sequence())
        return alts[0] if len(alts) == 1 else ("alt", alts)

    def sequence() -> tuple:
        nonlocal at
        items: list[tuple] = []
        while toks[at][0] in ("name", "lit") or toks[at][0] == "op" and toks[at][1] in "(!&.":
            items.append(prefixed())
        return items[0] if len(items) == 1 else ("seq", items)

    def prefixed() -> tuple:
        nonlocal at
        if toks[at][0] == "op" and toks[at][1] in "!&":
            op = toks[at][1]
            at += 1
            return ("not" if op == "!" else "and", prefixed())
        kind, value = toks[at]
        at += 1
        if kind == "op" and value == "(":
            e = choice()
            assert toks[at] == ("op", ")"), toks[at - 3 : at + 3]
            at += 1
        elif kind == "op":
            e = ("any",)
        else:
            e = (kind, value)
        while toks[at][0] == "op" and toks[at][1] in "*+?":
            e = ({"*": "star", "+": "plus", "?": "opt"}[toks[at][1]], e)
            at += 1
        return e

    rules: dict[str, tuple[bool, tuple]] = {}
    while toks[at][0] != "end":
        group = toks[at][0] == "group"
        at += group
        assert toks[at][0] == "def", toks[at - 3 : at + 3]
        name = toks[at][1]
        at += 1
        rules[name] = (group, choice())
    return rules


def allow_nesting(n: int) -> None:
    """Let Python functions call each other as deep as ``n`` tokens or characters can nest; such calls take no C stack."""
    if sys.getrecursionlimit() < 60_000 + 64 * n:
        sys.setrecursionlimit(60_000 + 64 * n)


class Grammar:
    """A compiled grammar; ``parse`` says whether a token sequence is a sentence of it."""

    def __init__(self, text: str, literals: dict[str, str], classes: dict[str, str], special: dict[str, str]):
        self.rules = _read(text)
        self.literals, self.classes, self.special = literals, classes, special
        self.first: dict[str, set[str]] = {r: set() for r in self.rules}
        self.empty: dict[str, bool] = dict.fromkeys(self.rules, False)
        changed = True
        while changed:
            changed = False
            for r, (_, e) in self.rules.items():
                f, n = self._first(e)
                if not f <= self.first[r] or n != self.empty[r]:
                    self.first[r] |= f
                    self.empty[r] |= n
                    changed = True
        self.memo: dict = {}
        self.fast, self.slow = self._build(False), self._build(True)

    def _kinds(self, e: tuple) -> str | None:
        """The token kinds of an expression that is one token; None for others."""
        if e[0] == "lit":
            return self.literals[e[1]]
        if e[0] == "name" and e[1] in self.classes:
            return self.classes[e[1]]
        if e[0] == "alt":
            parts = [self._kinds(x) for x in e[1]]
            return None if None in parts else "".join(parts)
        return None

    def _first(self, e: tuple) -> tuple[set[str], bool]:
        k = self._kinds(e)
        if k is not None:
            return set(k), False
        op = e[0]
        if op == "name":
            if e[1] in self.special:
                return set(), True
            return set(self.first[e[1]]), self.empty[e[1]]
        if op == "any":
            return {"*"}, False
        if op == "alt":
            got = [self._first(x) for x in e[1]]
            return set().union(*(f for f, _ in got)), any(n for _, n in got)
        if op == "seq":
            out: set[str] = set()
            for x in e[1]:
                f, n = self._first(x)
                out |= f
                if not n:
                    return out, False
            return out, True
        if op in ("star", "opt"):
            return self._first(e[1])[0], True
        if op == "plus":
            return self._first(e[1])
        return set(), True

    def _test(self, e: tuple, at: str, slow: bool) -> str | None:
        """Code that is false only where ``e`` can't start; None where nothing can be said."""
        f, n = self._first(e)
        if slow or n or "*" in f:
            return None
        return f"K[{at}] in {''.join(sorted(f))!r}"

    def _build(self, slow: bool) -> Callable:
        out = ["def make(K, N, M, F, memo, own):"]
        self.n = 0

        def new() -> str:
            self.n += 1
            return f"v{self.n}"

        def gen(e: tuple, s: str, d: str, ind: str) -> None:
            k = self._kinds(e)
            if k is not None:
                cond = f"K[{s}] == {k!r}" if len(k) == 1 else f"K[{s}] in {k!r}"
                if slow:
                    out.append(f"{ind}if {s} > F[0]: F[0] = {s}")
                out.append(f"{ind}{d} = {s} + 1 if {cond} else -1")
                return
            op = e[0]
            if op == "any":
                out.append(f"{ind}{d} = {s} + 1 if K[{s}] != {END!r} else -1")
            elif op == "name" and e[1] in self.special:
                out.append(f"{ind}{d} = {s} if {self.special[e[1]].format(s)} else -1")
            elif op == "name":
                out.append(f"{ind}{d} = R_{e[1]}({s})")
            elif op == "seq":
                if not e[1]:
                    out.append(f"{ind}{d} = {s}")
                    return
                t = new()
                gen(e[1][0], s, t, ind)
                for x in e[1][1:]:
                    out.append(f"{ind}if {t} >= 0:")
                    ind += " "
                    u = new()
                    gen(x, t, u, ind)
                    out.append(f"{ind}{t} = {u}")
                    ind = ind[:-1]
                out.append(f"{ind}{d} = {t}")
            elif op == "alt":
                t = new()
                out.append(f"{ind}{t} = -1")
                for j, x in enumerate(e[1]):
                    test = self._test(x, s, slow)
                    conds = [c for c in (f"{t} < 0" if j else None, test) if c]
                    if conds:
                        out.append(f"{ind}if {' and '.join(conds)}:")
                        gen(x, s, t, ind + " ")
                    else:
                        gen(x, s, t, ind)
                out.append(f"{ind}{d} = {t}")
            elif op in ("star", "plus"):
                t, u = new(), new()
                if op == "plus":
                    gen(e[1], s, t, ind)
                    out.append(f"{ind}while {t} >= 0:")
                else:
                    out.append(f"{ind}{t} = {s}")
                    out.append(f"{ind}while True:")
                test = self._test(e[1], t, slow)
                if test:
                    out.append(f"{ind} if not ({test}): break")
                gen(e[1], t, u, ind + " ")
                out.append(f"{ind} if {u} <= {t}: break")
                out.append(f"{ind} {t} = {u}")
                out.append(f"{ind}{d} = {t}")
            elif op == "opt":
                t = new()
                test = self._test(e[1], s, slow)
                out.append(f"{ind}{t} = -1")
                if test:
                    out.append(f"{ind}if {test}:")
                gen(e[1], s, t, ind + " " if test else ind)
                out.append(f"{ind}{d} = {t} if {t} >= 0 else {s}")
            else:
                t = new()
                gen(e[1], s, t, ind)
                out.append(f"{ind}{d} = {s} if {t} {'<' if op == 'not' else '>='} 0 else -1")

        for j, (r, (group, e)) in enumerate(self.rules.items()):
            out.append(f" def R_{r}(p):")
            if group and not slow:
                out.append("  m = M[p]")
                out.append("  if m < 0: return -1")
                # long groups hardly recur in other files: they are remembered by position, for this parse
                out.append(f"  if m - p > {_SHARED_TOKENS}: k = ({j}, p); known = own")
                out.append(f"  else: k = ({j}, K[p:m], N[p:m]); known = memo")
                out.append("  v = known.get(k)")
                out.append("  if v is None:")
                gen(e, "p", "q", "   ")
                out.append("   v = known[k] = q >= 0")
                out.append("  return m + 1 if v else -1")
            else:
                gen(e, "p", "q", "  ")
                out.append("  return q")
        out.append(f" return R_{next(iter(self.rules))}")
        space: dict = {}
        exec("\n".join(out), space)  # noqa: S102 - the source is the grammar text above
        return space["make"]

    def parse(self, kinds: str, breaks: str, partner: list[int]) -> int:
        """-1 if the whole sequence is a sentence, else the number of the token furthest reached."""
        allow_nesting(len(kinds))
        if len(self.memo) > _MEMO_ENTRIES:
            self.memo.clear()
        if self.fast(kinds, breaks, partner, None, self.memo, {})(0) >= 0:
            return -1
        far = [0]
        self.slow(kinds, breaks, partner, far, None, None)(0)
        return min(far[0], len(kinds) - 1)

