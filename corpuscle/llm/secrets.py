"""Problem 6: credentials in source code and configuration.

Literals near assignment contexts are segmented into dictionary words by Viterbi; what the dictionary
leaves unexplained decides: a few characters where the name or a remark speaks of a credential, nearly
all of a long literal where it does not. Values of known hash formats count only under a credential's
name, as issued keys often have that form. Logins in addresses, headers and options, key blocks and
issued key formats are located by their form and judged by the same segmentation.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.arrow import map_columns
from corpuscle.session import spread

#: The public vocabulary whose whole words, in order of frequency, are the dictionary; a parameter.
DICTIONARY = "/opt/tokenizers/word_bpe_49k.json"
REPLACEMENT = "REDACTED"

_NAME_WORD = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|signing[_-]?key|secret[_-]?key|encryption[_-]?key|auth(?:orization)?|credentials?|bearer|jwt"
#: Marks of a credential on lower-case text, at least one for every pattern that find_secrets tries; read alike by Python and the JVM.
_MARK_LIST = [
    _NAME_WORD, "log[- ]?in", "sign[-_ ]?in", "logon", r"connect\W*\(", "unlock", "opens", "access",
    "-----begin", r"://[^\s/'\"<>:@]*:[^\s/'\"@]+@", r"basic\W", r"-(?:u|-user)[ =]['\"]?[^\s:'\"]+:",
    "gh[pousr]_", "glpat-", "xox[abprs]-", "akia", "asia[a-z0-9]", "sk_(?:live|test)_", "aiza", "npm_", r"sg\.", "eyj",
    "mysql", "mariadb", r"[=:]\s*[\"'`][a-z0-9][a-z0-9_-]{19,}[\"'`]",
]
_MARKS = re.compile("|".join(_MARK_LIST))
_KEY = re.compile(_NAME_WORD)
#: The JVM's test of a whole content: the same marks in any case.
_HOT = "(?i)" + "|".join(_MARK_LIST)
#: Parts of a name that make it one of something about a credential, not of one.
_NEUTRAL = set("file path dir folder field fields hint kind limit limits count counts total url uri link label header headers type types ttl expiry expires expiration length len size min max policy prefix suffix param params prompt placeholder left env var index idx owner priority status score span level depth weight offset region code format pattern regex hash digest checksum fingerprint column table docs doc help error errors message text title note store manager provider factory service class view reader plan frame kinds by for is has get set to load fetch validate check refresh rotate count".split())
_SECRET_PARTS = set("pass password passwd passphrase passcode pwd secret token apikey key auth authorization credential credentials bearer jwt".split())
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_STRING = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
_URL_LOGIN = re.compile(r"\b[a-zA-Z][\w+.-]*://([^\s/:@'\"<>]*):([^\s/@'\"]+)@[\w\[.$<{-]")
_HEADER = re.compile(r"(?i)\b(?:bearer|basic|token)\s+([A-Za-z0-9+/=_.\-~]{8,})")
_ISSUED = re.compile(r"\b(gh[pousr]_[A-Za-z0-9]{30,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{10,}|(?:AKIA|ASIA)[A-Z0-9]{16}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})(?![\w])")
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: What may stand in a key block: separators, escaped line breaks, headers, lines of the key.
_BODY = re.compile(r"(?:\\+[nrt]|[\s\"'`+,;\\*#>|()-]|[A-Z][A-Za-z-]*: [^\n\\\"']*|(?<![A-Za-z0-9+/=])(?<!\\)[A-Za-z0-9+/=]{16,}|(?<=\\[nrt])[A-Za-z0-9+/=]{16,})*(?:=?[A-Za-z0-9+/]+={0,2}(?=\s*(?:[\"'`\n\\]|\Z)))?")
_OPTION = re.compile(r"(?:^|\s)(?:-u|--user)[ =]['\"]?([\w.-]+):([^\s'\"]+)|(?:^|\s)--?(?:password|passwd|pass|token|api-key|secret)[ =]['\"]?([^\s'\"]+)")
#: The password option of two database clients, without a space before its value.
_CLIENT, _JOINED = re.compile(r"\b(?:mysql|mariadb)\w*\s"), re.compile(r"(?<=\s)-p([^\s'\"-][^\s'\"]*)")
#: A literal of letters, digits and dashes only, and the name before it.
_LITERAL = re.compile(r"[=:]\s*[\"'`]([A-Za-z0-9][A-Za-z0-9_-]{19,})[\"'`]")
_NAMED = re.compile(r"([\w$.-]+)['\"\])]*\s*+(?::\s*+[\w.<>]+\s*+)?:?$")
#: Lengths of hexadecimal hashes; names of values that look random and open nothing.
_HASH = re.compile(r"(?i)(?:sha\d+-|md5-)?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})")
_OPENS_NOTHING = re.compile(r"(?i)(?:hash|sha\d*|md5|sum|digest|etag|commit|revision|trace|span|build|integrity|fingerprint|nonce|uuid|guid|id|version|cursor|cache|salt|image|icon|pixel|data|blob)s?_?\d*$")
#: Wording of placeholders.
_PLACEHOLDER = re.compile(r"(?i)\$\{|\{\{|\$\(|%\(|%[A-Z_]+%|^\$|^<.*>$|<[a-z _-]+>|^\{.*\}$|^%s$|\*{3,}|^x{3,}|x{6,}|\.\.\.|your|change|replace|example|dummy|placeholder|insert|redacted|hidden|masked|sample|todo|fixme|none|null|undefined|not[-_ ]?set|secret[-_]?here|key[-_ ]here|^(?:true|false|yes|no|on|off)$|^(?:vault|env|ssm|secretsmanager|arn|file|op|keyring|ref|sops|kms)[:/]|process\.env|os\.environ|getenv|^enc\(|^https?://")
_CODE_SUFFIX = re.compile(r"(?i)\.(?:py|jsx?|tsx?|go|java|c|cc|cpp|h|rs|rb|php)$")
_STR = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_LONG = r"{q}{{3}}[^{q}\\]*(?:(?:\\[\s\S]|{q}(?!{q}{q}))[^{q}\\]*)*(?:{q}{{3}}|\Z)"
_LONG2, _LONG1 = _LONG.format(q='"'), _LONG.format(q="'")
_HERE = r"<<[-~]?(?P<q>['\"]?)(?P<tag>[A-Za-z_]\w*)(?P=q)[^\n]*\n[\s\S]*?(?:\n[ \t]*(?P=tag)\b|\Z)"
_LINES2, _LINES1 = r'"(?:[^"\\]|\\[\s\S])*(?:"|\Z)', r"'(?:[^'\\]|\\[\s\S])*(?:'|\Z)"
#: Strings and comments of program files by suffix; those of JavaScript and TypeScript are read by _texts, as templates nest.
_TEXTS = {
    "py": rf"#[^\n]*|{_LONG2}|{_LONG1}|{_STR}",
    "go": rf"{_C_COMMENT}|`[^`]*(?:`|\Z)|{_STR}",
    "java": rf"{_C_COMMENT}|{_LONG2}|{_STR}",
    "c": rf"{_C_COMMENT}|R\"(?P<tag>[^()\s\\]{{0,16}})\([\s\S]*?(?:\)(?P=tag)\"|\Z)|{_STR}",
    "rs": rf"{_C_COMMENT}|r(?P<tag>#*)\"[\s\S]*?(?:\"(?P=tag)|\Z)|{_LINES2}|'(?:[^'\\\n]|\\[^\n][^'\n]*)'",
    "rb": rf"#[^\n]*|{_HERE}|{_LINES2}|{_LINES1}",
    "php": rf"#[^\n]*|{_C_COMMENT}|{_HERE.replace('<<[-~]?', '<<<[ ]?')}|{_LINES2}|{_LINES1}",
    "js": rf"{_C_COMMENT}|{_STR}|(?<=[(,=:[!&|?{{}};+\n])[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|[`{{}}]",
    "": rf"{_LONG2}|{_LONG1}|`[^`]*`",
}
_TEXTS = {k: re.compile(v) for k, v in _TEXTS.items()}
_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{|\Z)")
_COMMENT = re.compile(r"^\s*(?:#|//|\*|/\*|--|;)")
#: A literal whose remark says that it opens something.
_REMARK = re.compile(r"""(?i)^\s*(?:(?:const|let|var|final|String|export|private|static)\s+)*([\w.$-]+)\s*(?::\s*\w+\s*)?(?::=|=|:)\s*["']([^"'\s]+)["'][;,]?\s*(?:\#|//).*\b(?:log[- ]?in|unlocks?|opens|sign[- ]?in|credentials?|password|pass ?code|access)\b""")
#: What may stand behind a name whose value follows on a later line, in program files after its type too.
_CONTINUES = [re.compile(r"['\"]?\s*+" + kind + r"(?::=|=>|=|:)?\s*+(?:[\w.]+\()?\s*+[(\[{]?\s*+(?:[>|][-+]?|\\)?\s*+$") for kind in ("", r"(?::\s*+\w++\s*+)?")]


class Segmenter:
    """Viterbi segmentation of letters into dictionary words."""

    def __init__(self, words: list[str]):
        self.cost = {w: math.log(50.0 + j) for j, w in enumerate(dict.fromkeys(words)) if len(w) > 2 or w in ("a", "an", "as", "at", "by", "db", "do", "go", "id", "if", "in", "io", "is", "it", "my", "no", "of", "on", "or", "to", "up", "us", "we", "ok")}
        self.longest = max(map(len, self.cost), default=1)
        self.memo: dict[str, int] = {}

    def letters(self, run: str) -> int:
        """Letters of a run that no word explains. An unexplained letter costs more than a letter of a word."""
        run = run.lower()
        got = self.memo.get(run)
        if got is not None:
            return got
        n = len(run)
        best = [(0.0, 0)] + [(math.inf, 0)] * n
        for end in range(1, n + 1):
            c, r = best[end - 1]
            choice = (c + 6.5, r + 1)
            for start in range(max(0, end - self.longest), end - 1 + (end == 1)):
                w = self.cost.get(run[start:end])
                if w is not None:
                    cand = (best[start][0] + w + 2.0, best[start][1])
                    choice = min(choice, cand)
            best[end] = choice
        if len(self.memo) > 200_000:
            self.memo.clear()
        if n <= 64:
            self.memo[run] = best[n][1]
        return best[n][1]

    def residual(self, value: str, enough: int | None = None) -> int:
        """Characters of a value that neither words nor plain separators explain; digits count where letters stand beside them.

        Counting may end once ``enough`` are found.
        """
        left = len(re.findall(r"\d", value))
        left += len(re.findall(r"[^\w\s.,:/-]", value))
        if not re.search(r"[^\W\d_]", value) and len(re.findall(r"\d", value)) < 6:
            left = 0
        for m in re.finditer(r"[^\W\d_]+", value):
            if enough is not None and left >= enough:
                break
            left += self.letters(m[0])
        return left


@cache
def segmenter(path: str = DICTIONARY) -> Segmenter:
    """The segmenter over a vocabulary file's whole words, built once in a process."""
    vocabulary = json.loads(Path(path).read_text("utf-8"))["model"]["vocab"]
    whole = [(i, t[:-4]) for t, i in vocabulary.items() if t.endswith("</w>")]
    return Segmenter([t for _, t in sorted(whole) if t.isalpha() and t.isascii()])


@dataclass(frozen=True)
class Secret:
    """A secret's place: line from 1, character offsets of the value in the content, and what gave it away."""

    line: int
    start: int
    end: int
    kind: str
    stop: int = -1  #: of a key block, where its body ends


def credential_name(name: str) -> bool:
    """Whether a name is that of a credential rather than of something about one."""
    parts = [p.lower() for p in _PART.findall(name)]
    while parts and (parts[-1].isdigit() or parts[-1] in ("v", "old", "new", "prod", "dev", "test", "value", "str", "string", "default")):
        parts.pop()
    if not parts or parts[-1] in _NEUTRAL or parts[0] in ("is", "has", "get", "set", "no", "max", "min", "num", "docs", "csrf"):
        return False
    joined = "".join(parts)
    if parts[-1] == "key":
        return bool(re.search(r"api|access|private|signing|secret|encryption|auth|master|hmac|aes|client", joined))
    return parts[-1] in _SECRET_PARTS or joined.endswith(("apikey", "password", "passwd", "secret", "token", "pwd", "pass"))


def stands_alone(name: str, value: str) -> bool:
    """Whether a literal is a credential whatever its name: long, of mixed signs, nearly all of it unexplained, no hash."""
    if _HASH.fullmatch(value) or _OPENS_NOTHING.search(name) or _PLACEHOLDER.search(value):
        return False
    mixed = re.search(r"\d", value) and re.search(r"[A-Z]", value) and re.search(r"[a-z]", value)
    return bool(mixed) and segmenter().residual(value) >= 0.75 * len(value)


def looks_usable(value: str) -> bool:
    """Whether a value given as a credential reads as one: not a placeholder, reference or prose, and with enough unexplained."""
    v = value.strip()
    if len(v) < 6 or _PLACEHOLDER.search(v):
        return False
    if " " in v and not re.search(r"(?i)^(?:bearer|basic|token) \S+$", v):
        return False
    if len(set(v)) < 4 or re.fullmatch(r"[\d.,:-]+", v) and len(v) < 8:
        return False
    if v[0] in "./~" and segmenter().residual(v) < 0.5 * len(v):  # a path, unlike Base64 that begins so, is of words
        return False
    left = segmenter().residual(v, 8)
    mixed = bool(re.search(r"\d", v)) + bool(re.search(r"[^A-Za-z0-9]", v)) + bool(re.search(r"[A-Z]", v) and re.search(r"[a-z]", v))
    return left >= 4 and left >= 0.34 * len(v) or left >= 8 or mixed >= 2 and left >= 3 or mixed == 3 and left >= 2


class _Values:
    """The values given to names of one line. Where strings and the end of a value lie is kept from name to name, so long lines take linear time."""

    _GIVEN = re.compile(r"['\"\]]*\s*(?:\??:[\w.|<>\[\]\s]+?(?==[^=]))?(?::=|=>|=(?!=)|:(?!:)|,(?=\s*['\"]))\s*")
    _STOP = re.compile(r"[,;]\s*['\"]?[\w$-]+['\"]?\s*(?:[=:])(?!=)|[;]\s*$")
    _BARE = re.compile(r"[^\s;,'\"#][^\s;,'\"]*")

    def __init__(self, line: str):
        self.line = line
        self.strings: list[tuple[int, int]] = []
        self.limit = -1

    def after(self, at: int, code: bool) -> tuple[list[tuple[int, int]], bool]:
        """(spans of values given to the name that ends at ``at``, whether the value must stand on a later line)."""
        line = self.line
        c = _CONTINUES[code].match(line, at)
        if c and re.search(r"[:=(>|\\]", c[0]):
            return [], True
        m = self._GIVEN.match(line, at)
        if not m:
            return [], False
        pos = m.end()
        k = bisect_right(self.strings, (pos, -1))
        if pos < self.limit and not (k and pos < self.strings[k - 1][1]):  # all strings up to the same end have been given
            spans, known = [], k < len(self.strings)
        else:
            spans = self._read(pos)
            known = bool(spans)
        if not known and not code:
            b = self._BARE.match(line, pos)
            if b:
                spans.append(b.span())
        return spans, False

    def _read(self, pos: int) -> list[tuple[int, int]]:
        line, spans = self.line, []
        self.strings, self.limit = [], len(line) + 1
        s = self._STOP.search(line, pos)
        for q in _STRING.finditer(line, pos):
            while s and q.start() < s.start() < q.end():
                s = self._STOP.search(line, s.end())
            if s and s.start() <= q.start():
                break
            self.strings.append(q.span())
            spans.append(next(q.span(g) for g in (1, 2, 3) if q[g] is not None))
        if s:
            self.limit = s.start()
        return spans


def _key_blocks(content: str) -> list[tuple[int, int, int, int]]:
    """(start, end of the BEGIN mark, end of the body, end of the block) of every private key, of any length.

    A block without an END mark of its own reaches as far as what follows looks like a key.
    """
    out: list[tuple[int, int, int, int]] = []
    begins = list(_BEGIN.finditer(content))
    ends = [e.span() for e in _END.finditer(content)] if begins else []
    for k, b in enumerate(begins):
        after = begins[k + 1].start() if k + 1 < len(begins) else len(content)
        j = bisect_right(ends, (b.end(), -1))
        if j < len(ends) and ends[j][0] < after:
            stop, end = ends[j]
        else:
            stop = end = _BODY.match(content, b.end(), after).end()
        body = content[b.end() : stop]
        if re.search(r"[A-Za-z0-9+/=]{16,}", body) and not _PLACEHOLDER.search(body.strip()[:40]):
            out.append((b.start(), b.end(), stop, end))
    return out


def _texts(content: str, path: str | None) -> list[tuple[int, int]]:
    """Spans of a program file's strings and comments, in order; without a path those of strings that may hold lines."""
    suffix = path.rsplit(".", 1)[-1].lower() if path else ""
    suffix = {"jsx": "js", "ts": "js", "tsx": "js", "cc": "c", "cpp": "c", "h": "c"}.get(suffix, suffix)
    pattern = _TEXTS[suffix]
    if suffix != "js":
        return [m.span() for m in pattern.finditer(content)]
    out: list[tuple[int, int]] = []
    depths: list[int] = []  # open braces in each ${...} around
    at = 0
    while m := pattern.search(content, at):
        at, c = m.end(), m[0]
        if c == "{" and depths:
            depths[-1] += 1
        elif c == "}" and depths and depths[-1]:
            depths[-1] -= 1
        elif c == "`" or c == "}" and depths:
            if c == "}":
                depths.pop()
            t = _TEMPLATE_TEXT.match(content, at)
            out.append((m.start(), t.end()))
            at = t.end()
            if t[0].endswith("${"):
                depths.append(0)
        elif c not in ("{", "}"):
            out.append(m.span())
    return out


def find_secrets(content: str, path: str | None = None) -> list[Secret]:
    """All secrets of a content, in order. ``path`` tells program files, where bare words are names, from configuration."""
    low = content.lower()
    if len(low) != len(content):  # a few letters change their length
        low = re.sub("[A-Z]", lambda m: m[0].lower(), content)
    hot = [m.start() for m in _MARKS.finditer(low)]
    if not hot:
        return []
    code = path is None or bool(_CODE_SUFFIX.search(path))
    out: dict[int, Secret] = {}
    lines = content.split("\n")
    offsets, total = [], 0
    for x in lines:
        offsets.append(total)
        total += len(x) + 1
    numbers = sorted({bisect_right(offsets, h) - 1 for h in hot})

    blocks = _key_blocks(content) if "-----BEGIN" in content else []
    for start, end, stop, _ in blocks:
        out[start] = Secret(bisect_right(offsets, start), start, end, "private_key", stop)

    def add(i: int, start: int, end: int, kind: str) -> None:
        k = bisect_right(blocks, (offsets[i] + end,)) - 1
        if k >= 0 and offsets[i] + start < blocks[k][3]:  # within a key block
            return
        old = out.get(offsets[i] + start)
        if old is None:
            out[offsets[i] + start] = Secret(i + 1, offsets[i] + start, offsets[i] + end, kind)

    texts: list[tuple[int, int]] | None = None

    def inside(at: int) -> bool:
        """Whether a program file's character stands in a string or comment."""
        nonlocal texts
        if texts is None:
            texts = _texts(content, path)
        k = bisect_right(texts, (at, total)) - 1
        return k >= 0 and texts[k][0] < at < texts[k][1]

    n = len(lines)
    for i in numbers:
        line = lines[i]
        small = low[offsets[i] : offsets[i] + len(line)]
        quoted = '"' in line or "'" in line or "`" in line
        comment = bool(_COMMENT.match(line))
        bare = not code or comment or inside(offsets[i])
        for m in _URL_LOGIN.finditer(line):
            if looks_usable(m[2]) or len(m[2]) >= 4 and not _PLACEHOLDER.search(m[2]) and segmenter().residual(m[2]) >= 3:
                add(i, *m.span(2), "url_login")
        for m in _ISSUED.finditer(line):
            if not re.search(r"(?i)x{5,}|example|0{8,}", m[1]):
                add(i, *m.span(1), "issued_key")
        for m in _HEADER.finditer(line):
            if looks_usable(m[1]) and re.search(r"(?i)authori[sz]ation|header|curl|bearer|basic", line) and (quoted or bare or path is None or inside(offsets[i] + m.start(1))):
                add(i, *m.span(1), "header")
        for m in _OPTION.finditer(line):
            g = 2 if m[2] else 3
            if m[g] and looks_usable(m[g]) and (bare or path is None or inside(offsets[i] + m.start(g))):
                add(i, *m.span(g), "option")
        for m in re.finditer(r"(?i)\b(?:login|connect|auth(?:enticate)?|sign_?in|logon|basic_?auth)\s*\(\s*(['\"])[^'\"]*\1\s*,\s*(['\"])([^'\"]+)\2\s*[,)]", line):
            if looks_usable(m[3]):
                add(i, *m.span(3), "call")
        remark = _REMARK.match(line)
        if remark and looks_usable(remark[2]) and not _HASH.fullmatch(remark[2]):
            add(i, *remark.span(2), "remark")
        for m in _LITERAL.finditer(line):
            named = _NAMED.search(line[max(0, m.start() - 200) : m.start()])
            if stands_alone(named[1] if named else "", m[1]):
                add(i, *m.span(1), "literal")
        client = _CLIENT.search(small)
        if client:
            for m in _JOINED.finditer(line, client.end() - 1):
                if looks_usable(m[1]) and (bare or path is None or inside(offsets[i] + m.start(1))):
                    add(i, *m.span(1), "option")
        done, values, beyond = -1, _Values(line), None
        for k in _KEY.finditer(small):
            if k.start() < done:
                continue
            start, end = k.span()
            while start > 0 and (line[start - 1].isalnum() or line[start - 1] in "_$-"):
                start -= 1
            while end < len(line) and (line[end].isalnum() or line[end] in "_$-"):
                end += 1
            done = end
            if not credential_name(line[start:end]):
                continue
            spans, later = values.after(end, not bare)
            for s, e in spans:
                v = line[s:e]
                if looks_usable(v) and not _url(v):
                    h = _HEADER.match(v)
                    add(i, *((s + h.start(1), s + h.end(1)) if h else (s, e)), "assignment")
            if later:
                j = i + 1 if beyond is None else beyond
                while j < n and (not lines[j].strip() or _COMMENT.match(lines[j]) and code):
                    j += 1
                beyond = j
                if j < n:
                    nxt = lines[j]
                    q = re.match(r"\s*(?:[\w.]+\(\s*)?[(\[]?\s*[rbuf]?(?:\"([^\"\n]*)\"|'([^'\n]*)'|`([^`\n]*)`)", nxt)
                    if q:
                        g = next(g for g in (1, 2, 3) if q[g] is not None)
                        if looks_usable(q[g]) and not re.match(r"\s*[:=]", nxt[q.end() :]):
                            add(j, *q.span(g), "assignment")
                    elif not code or bare and not comment:
                        q = re.match(r"\s+([^\s#'\"][^\s'\"]*)\s*$", nxt)
                        if q and not q[1].endswith(":") and looks_usable(q[1]):
                            add(j, *q.span(1), "assignment")
    got = sorted(out.values(), key=lambda s: s.start)
    kept: list[Secret] = []
    for k, s in enumerate(got):
        if not k or s.start >= max(got[k - 1].end, got[k - 1].stop):
            kept.append(s)
    return kept


def _url(v: str) -> bool:
    return bool(re.match(r"[a-zA-Z][\w+.-]*://", v))


def redact(content: str, secrets: list[Secret]) -> str:
    """The content with only the secrets replaced; quotes, names, line breaks and key block marks stay."""
    out, at = [], 0
    for s in secrets:
        if s.kind == "private_key":
            out.append(content[at : s.end] + re.sub(r"[A-Za-z0-9+/=]{8,}", REPLACEMENT, content[s.end : s.stop]))
            at = s.stop
        else:
            out.append(content[at : s.start] + REPLACEMENT)
            at = s.end
    return "".join(out) + content[at:]


_SCHEMA = "tbl string, rec_key string, line_no int, kind string, redacted string"


def _judge(tbls: list, keys: list, paths: list, contents: list) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in ("tbl", "rec_key", "line_no", "kind", "redacted")}
    for tbl, key, path, text in zip(tbls, keys, paths, contents):
        found = find_secrets(text, path)
        for k, s in enumerate(found):
            for n, x in (("tbl", tbl), ("rec_key", key), ("line_no", s.line), ("kind", s.kind), ("redacted", redact(text, found) if not k else None)):
                out[n].append(x)
    return out


def secrets_in(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tbl, rec_key, line_no, kind, redacted) of every secret; ``redacted`` stands on a content's first row.

    Contents without any mark of a credential are dropped in the JVM. Null contents hold none; rows
    with a null key keep it. Contents are read whole, in place; only results leave the scan.
    """
    hot = F.lit(_HOT)
    parts = sources.select(F.lit("sources").alias("tbl"), F.concat("repo_path", F.lit(":"), "path").alias("rec_key"), "path", "content")
    parts = parts.unionByName(chunks.select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("rec_key"), F.col("file_path").alias("path"), "content"))
    wanted = parts.filter(F.col("content").isNotNull() & F.regexp_like("content", hot))
    return map_columns(spread(wanted), ["tbl", "rec_key", "path", "content"], _judge, _SCHEMA)
