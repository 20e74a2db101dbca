from dataclasses import asdict

from corpuscle.operators import parse
from corpuscle.operators.parse import parse_javascript, parse_python, parse_typescript

PYTHON = '''import os, sys
from .util import helper
from pkg.mod import A as B

LIMIT = 3

@register("x")
class Store(Base, metaclass=Meta):
    """Keeps rows."""

    kind = "s"

    @property
    def size(self) -> int:
        """Row count."""
        return 1

    async def load(self, path, /, mode="r", *rest, strict=True, **kw):
        def inner():
            pass
        return inner

    class Nested:
        def hidden(self):
            pass

if LIMIT:
    def also_hidden():
        pass

def top(a, b=2):
    return a + b
'''


def test_python_golden():
    got = [(e.type, e.name, e.start_line, e.end_line, e.parent_class, e.parameters, e.decorators, e.docstring, e.return_type) for e in parse_python(PYTHON)]
    assert got == [
        ("import", "os", 1, 1, None, [], [], None, None),
        ("import", "sys", 1, 1, None, [], [], None, None),
        ("import", "util.helper", 2, 2, None, [], [], None, None),
        ("import", "pkg.mod.A", 3, 3, None, [], [], None, None),
        ("class", "Store", 8, 25, None, ["Base"], ["register('x')"], "Keeps rows.", None),
        ("method", "size", 14, 16, "Store", ["self"], ["property"], "Row count.", "int"),
        ("method", "load", 18, 21, "Store", ["mode"], [], None, None),
        ("function", "top", 31, 32, None, ["a", "b"], [], None, None),
    ]
    assert parse_python(PYTHON)[5].content.startswith("def size(self) -> int:\n        ")


def test_python_invalid_and_odd():
    assert parse_python("def f(:\n") == [] and parse_python("\0") == [] and parse_python("") == []
    assert parse_python("def é(x): return 'ü' # ä\n")[0].content == "def é(x): return 'ü'"


def names(elements):
    return [(e.type, e.name) for e in elements]


def test_javascript_golden():
    assert names(parse_javascript("import x from './m.js'\n")) == [("import", "./m.js")]
    (f,) = parse_javascript("/** doc */\nfunction f(a, b) {}\n")
    assert (f.name, f.parameters, f.docstring, f.start_line) == ("f", ["a", "b"], "/** doc */", 2)
    (g,) = parse_javascript("/** doc */\nexport function g() {}\n")
    assert (g.name, g.docstring) == ("g", None)
    (h,) = parse_javascript("const h = (x) => x, k = 1\n")
    assert (h.name, h.content, h.parameters) == ("h", "const h = (x) => x, k = 1", ["x"])
    assert parse_javascript("var v = () => 1\n") == []
    cls, m = parse_javascript("class K { m(p) {} }\n")
    assert (cls.type, m.type, m.name, m.parent_class, m.parameters) == ("class", "method", "m", "K", ["p"])
    assert names(parse_javascript("const f = function (a) { return a }\nexport default class extends B { get x() { return 1 } static y = 2; async z() {} }\n")) == [("function", "f"), ("class", "<anonymous>"), ("method", "x"), ("method", "z")]


def test_typescript_golden():
    assert names(parse_typescript("interface I { a: number }\n")) == [("class", "I")]
    q, n = parse_typescript("abstract class Q { n(): string { return '' } }\n")
    assert (n.name, n.return_type) == ("n", "string")
    assert parse_typescript("enum E { A }\ntype T = string\n") == []
    c, m = parse_typescript("@Injectable({ a: 1 })\nexport class C {\n  @Get() @Auth('x')\n  m(@Body() b: Map<string, number>, c?: string): Promise<{ a: number }> { return b }\n}\n")
    assert c.decorators == ["@Injectable({ a: 1 })"] and m.decorators == ["@Get()", "@Auth('x')"]
    assert m.parameters == ["@Body() b: Map<string, number>", "c?: string"] and m.return_type == "Promise<{ a: number }>"
    (f,) = parse_typescript("export const f = async (a: number): Promise<void> => { await a }\n")
    assert (f.name, f.return_type, f.parameters) == ("f", "Promise<void>", ["a: number"])


def test_broken_scripts_do_not_raise():
    for t in ("class {", "function (", "const x = ", "import", "export", "@", "((([[[", "`${", "/*", "class A { m(", "}" * 50, "const a = b =>"):
        parse_javascript(t)
        parse_typescript(t)


def test_parse_files(spark):
    rows = [("r", "a.py", "def f(): pass\n"), ("r", "b.md", "# x"), ("r", "c.py", None), ("r", "d.py", ""), ("r", "e.js", "function g() {}"), (None, None, "def z(): pass")]
    df = spark.createDataFrame(rows, "repo_path string, path string, content string")
    got = {(r.path, r.name) for r in parse.parse_files(df).collect()}
    assert got == {("a.py", "f"), ("e.js", "g")}
    assert parse.parse_files(df.limit(0)).count() == 0
    files = parse.parsed_files(parse.parse_files(df)).collect()
    assert {f.file_path: len(f.functions) for f in files} == {"a.py": 1, "e.js": 1}


def test_element_fields():
    assert set(asdict(parse_python("import a")[0])) >= {"type", "name", "start_line"}
