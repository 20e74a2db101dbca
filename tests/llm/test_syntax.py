import json

import pytest

from corpuscle.llm import syntax
from corpuscle.llm.grammars import check, syntax_of

VALID = {
    "javascript": [
        "", "'use strict'\nlet a = 1, {b, c: [d = 2, ...e], ...f} = g\nfor (const x of y) z(x)\nfor (k in o) { continue }\nlabel: while (1) break label",
        "const re = /[({]+/.test(a) ? 1 : b / c / d\nif (x) /y/.exec(z)\nvar s = `a ${`b ${c}`} d`\na\n++b",
        "async function* f(a, b = 1, {c}, ...d) { yield* g(); for await (const x of y) {} return await z }\nexport default class extends (A, B) { static #p = 1; get x() { return this.#p } static { q() } async *[k]() {} 'a b'() {} }",
        "import a, { b as c, default as d } from './x.js'\nimport * as e from 'e'\nexport * from 'z'\nexport { c as f }\nconst g = async x => ({ x, y: 1, ...z, m() {}, get n() { return 2 } })",
        "const h = <div a='1' {...p}>text {x ? <b/> : <></>}</div>\nnew Foo\nnew (a.b)(c)\na?.b?.[c]?.(d) ?? e\ntry { x } catch { y } finally { z }\nswitch (a) { case 1: case 2: b(); default: c() }\ndo x++; while (x < 5)\nif (a) b; else if (c) d; else { e }",
        "(function(){ var a = 1 })()\n!function(){}()\nreturn_ = x => y => z\nlet async = 1, of = 2, get = 3\nconst o = { if: 1, class: 2 }; o.if",
        "// <<<<<<< in a remark\nconst t = '======='\n",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D, E<T> { readonly a?: string; [k: string]: any; m<U>(x: U): void; new (y: number): A<T>; get z(): number }",
        "type X = { [K in keyof T]?: T[K] } & (A | B)[] | `a${string}` | typeof q | ((a: number, ...b: string[]) => asserts a is string)\ntype C = T extends (infer U)[] ? U : never\nenum E { A = 1, B, 'C' = 'x' }\ndeclare module 'm' { export const v: number }\nnamespace N.M { let z }",
        "abstract class Q<T> extends R<T> implements S, U { private readonly a: number = 1; constructor(public b?: string, private c = 2) { super() } abstract d(): void; @Dec() e<V>(x: V): x is V { return x as unknown as V } f!: string; g?(): void; static h = <T,>(x: T) => x! }",
        "export async function f<T>(this: Foo, a?: number): Promise<Map<string, T[]>> { return a satisfies number }\nconst g = (a: number): { b: string } => ({ b: `${a}` })\nfunction o(a: string): void;\nfunction o(a: any) {}\nimport type { A } from 'a'\nexport type { B }\nlet x = <any>y; let z = a<b, c>(d); let w = a < b",
    ],
    "go": [
        "", 'package main\n\nimport (\n\t"fmt"\n\t. "os"\n\tx "y"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\nvar a, b int = 1, 2\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:"a"`\n\t*E\n\tx.F\n}\n\ntype I interface {\n\tM(a int) (b string, err error)\n\t~int | ~string\n}\n\nfunc (t *T[K, V]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && v != nil {\n\t\treturn v.(int), nil\n\t} else if x > 1 {\n\t}\n\tfor i := 0; i < 10; i++ {\n\t\tcontinue\n\t}\n\tfor k, v := range m {\n\t\t_ = v\n\t}\n\tfor {\n\t\tselect {\n\t\tcase x := <-ch:\n\t\t\tgo func() { ch <- x }()\n\t\tdefault:\n\t\t\tbreak\n\t\t}\n\t}\n\tswitch y := z.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\ts := []T{{1, 2}, {A: 3}}\n\tm := map[string][]int{"a": {1}, "b": nil}\n\tdefer f(s[1:2], m["a"]...)\n\tgoto L\nL:\n\treturn\n}\n',
    ],
    "java": [
        "", "package a.b;\nimport static c.D.*;\n@A(x = 1, y = {2, 3})\npublic abstract class Foo<T extends Bar & Baz<?>> extends X<T> implements Y, Z {\n  private static final int[] A = {1, 2}, B[] = null;\n  static { f(); }\n  public Foo(final int a, String... b) throws E, F { super(a); this.x = (int) 'c' >>> 2; }\n  <U> List<? super U> m(Map<String, List<U>> p) { for (var e : p.entrySet()) { continue; } for (int i = 0, j = 1; i < 5; i++, j--) {} return p.get(\"x\").stream().map(q -> (String) q.toString()).map(Foo::new).collect(C.<U>toList()); }\n  enum E { A(1) { void z() {} }, B; int v; }\n  interface I { default void d() {} int N = 1; }\n  record R(int a, String b) { R { assert a > 0 : \"m\"; } }\n  int s(Object o) { return switch (o) { case Integer i when i > 1 -> i; case String t -> { yield 2; } default -> throw new X(); }; }\n  void t() { try (var r = open(); s) { synchronized (this) { x++; } } catch (A | B e) { } finally { } int[][] z = new int[3][]; Runnable q = () -> {}; if (o instanceof String str && !str.isEmpty()) ; do { } while (true); label: while (a) break label; String u = \"\"\"\n text \" \"\"\"; new Foo<>() { int k; }.m(); }\n}\n",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', "[]", " 1 ", '"x"'],
    "python": ["", "match x:\n    case [a, *_]: pass\n", "async def f(): return [i async for i in y]\n", "\ufeffx = 1\n", "a\f = 1\r\n"],
}
INVALID = {
    "javascript": ["const x", "a b", "function (", "x = {", "'abc", "a = 1;\n<<<<<<< HEAD\nb = 2;\n=======\nb = 3;\n>>>>>>> x\n", "const a: number = 1", '{"a": 1, "b": 2}', "# Title\ntext", "<!DOCTYPE html>\n<html></html>", "if (a", "/* open", "`open", "a.b  c(4)", "let let1 = ;", "class A { x y }", "import { a from 'b'", "return_(1))"],
    "typescript": ["let a: = 1", "interface A {", "type X = ", "enum E { A B }", "class A { m(: string) {} }"],
    "go": ["func main() {}", "package a\nfunc f() {\n\tx := \n}", "package a\nimport os", "package a\nvar x = [1, 2"],
    "java": ["class A { int x }", "class A { void f() { return 1 } }", "public class { }", "class A {", "class A { void f() { int = 3; } }"],
    "json": ["", "{'a': 1}", "[1,]", '{"a": 1', "nul", "{a: 1}", '{"a" 1}', "1 2", '"\t"'],
    "python": ["print 4\n", "def f(:\n", "x = (\n", "\0", "  x\n y\n", "'abc\n"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert check(text, language, language == "javascript").valid


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    verdict = check(text, language, language == "javascript")
    assert not verdict.valid and 0 <= verdict.position <= len(text) and verdict.cause


WITHIN = [
    "const a = <ul>{rows.map(x => (\n<<<<<<< HEAD\n<li/>\n=======\n<b/>\n>>>>>>> x\n))}</ul>", "const a = <p>{x y}</p>", "const a = <p b={c d}/>", "const a = <p b={}/>", "const a = <p {b}/>", "const a = <p>{f(}</p>", "const a = <p>{<b>{c d}</b>}</p>",
    "const a = `x ${a b} y`", "const a = `${}`", "const a = `x ${`y ${a b}`}`", "const a = `${if (x) y}`", "const a = `${f(1,}`",
]


@pytest.mark.parametrize("text", WITHIN)
def test_code_within_jsx_and_templates_is_parsed(text):
    v = check(text, "javascript")
    assert not v.valid and 0 < v.position <= len(text) and v.cause
    assert v.cause == "conflict" or "<<<<" not in text
    if "`" in text:
        assert not check(text, "typescript", False).valid


@pytest.mark.parametrize(
    "text",
    ["const a = <p>{'}'}{/* { */}{x /* } */}{}</p>", "const a = <p {...b} c={d ? <i>don't {e}</i> : null}>it's {...f} {g => ({ h: `}` })}</p>", "const a = `${{ a: '}' }.a} ${`${b}`} ${/[}`]/.test(c)} ${d => { return e }}`", "const a = <p>{x < y ? `a ${b}` : (z, 1)}</p>", "const a = `${await_(b)}${this.c}${a, b}\\${ d`"],
)
def test_right_code_within_jsx_and_templates(text):
    assert check(text, "javascript").valid


def test_template_types_and_deep_holes():
    assert check("type A<K> = `get${Capitalize<K & string>}` | `${infer_[]}` | `a${string}`", "typescript", False).valid
    assert check("x = " + "`${" * 200 + "1" + "}`" * 200, "javascript").valid
    check("x = " + "<a>{" * 3000, "javascript")
    check("x = " + "<a>{b c " * 40, "javascript")
    check("x = " + "`${" * 20_000, "javascript")


def test_furthest_position_and_cause():
    text = "a();\n<<<<<<< HEAD\nb();\n=======\nc();\n>>>>>>> x\n"
    v = check(text, "javascript")
    assert v.cause == "conflict" and text[: v.position].count("\n") == 1
    assert check("function f() { if (a) {", "javascript").cause == "truncated"
    assert check('{"a": 1}', "go").cause == "other_language"


def test_memo_does_not_mix_results():
    for _ in range(2):
        assert check("f(a, b); g({c: 1});", "javascript").valid
        assert not check("f(a b); g({c: 1});", "javascript").valid


def test_deep_nesting_ends():
    assert check("x = " + "(" * 3000 + "1" + ")" * 3000, "javascript").valid
    assert check("[" * 5000 + "]" * 5000, "json").valid
    check("[" * 100_000, "json")


def test_json_agrees_with_the_library():
    for t in ['{"a":[1,2,{"b":null}]}', "[1.0e+5]", "[01]", "[1.]", '["\\x"]', "[-]", "{}", "{,}", "[\u00a01]"]:
        try:
            json.loads(t)
            want = True
        except ValueError:
            want = False
        assert check(t, "json").valid == want, t


def test_suffix():
    assert [syntax_of(p) for p in ("a.py", "d/B.JSON", ".py", "x", None, "a.md", "a.tsx")] == ["python", "json", None, None, None, None, None]


def test_table(spark):
    rows = [("r", "a.py", "def f(:\n"), ("r", "a.py", "def f(:\n"), ("r", "b.js", ""), (None, "c.json", ""), ("r", None, "x"), ("r", "d.go", None), ("r", "e.md", "("), ("s", "f.js", "x" * 200_000 + "(")]
    df = spark.createDataFrame(rows, "repo_path string, path string, content string").selectExpr("*", "1 as valid", "'z' as cause")
    assert {(r.repo_path, r.path) for r in syntax.invalid_files(df).collect()} == {("r", "a.py"), (None, "c.json"), ("s", "f.js")}
    assert syntax.invalid_files(df.limit(0)).count() == 0
    parsed = spark.createDataFrame([("r", "a.py", " PYTHON "), ("r", "b.js", None), ("r", "b.js", "JavaScript")], "repo_path string, file_path string, language string")
    got = {(r.repo_path, r.language): (r.files, r.invalid, r.rate) for r in syntax.invalid_rates(df, parsed).collect()}
    assert got[("r", "python")] == (1, 1, 1.0) and got[("r", "javascript")] == (1, 0, 0.0)


@pytest.mark.parametrize(("text", "language"), [("x=" + "[" * 20_000 + "]" * 20_000 + ";", "javascript"), ("f(" * 5_000 + ")" * 5_000, "javascript"), ("[" * 30_000 + "]" * 30_000, "json"), ("x = " + "a ? b : " * 5_000 + "c;", "javascript"), ("var t = " + "`${" * 400 + "1" + "}`" * 400, "javascript")])
def test_nesting_is_no_error(text, language):
    from corpuscle.llm.grammars import check

    assert check(text, language).valid and not check(text[:-2] + "(", language).valid


PYTHON = [
    "x: int = 3\n(y): str\na.b[0]: int = f(x=1, *a, **k)\n", "def f(a, /, b=1, *c, d, e=2, **g) -> int: return a; pass\n", "async def f():\n\tasync with a as b, c: await d\n\treturn [x async for x in y if z]\n",
    "match x:\n    case [1, *rest] | {'a': 1, **k} if y: pass\n    case A.B(c=1) as d:\n        pass\nmatch = case = type = 1\nmatch[0]: int\n", "type A[T: int = str, *U] = list[T]\nclass B[T](C, metaclass=D): ...\n",
    "f'{a!r:>{w}} {b[\"c\"]} {{x}} {d=} {(lambda q: q)(1)}'\nf'''{\n1}'''\n", "try:\n  pass\nexcept* (A, B) as e: pass\nelse: pass\nfinally: pass\n", "with (open(a) as b, c,): pass\nwith (yield): pass\n", "lambda: (yield)\nprint(*a, *b, c=1, **d)\n",
    "if (n := 10) > 5 and not a is not b not in c: x = y = yield\n", "@a.b[1](2)\ndef f(): pass\nx = 1 if 2 else 3,\ndel (a, [b]), c.d\n", "עִברִית = 1\nx = 0xFF + 1_0.5e-3j + 0o7 \\\n  - .5\n", "\ufeffx = 1\n", "", "# only a remark", "from . import (a as b, c,)\nfrom ...x import *\nglobal y\n",
]
NO_PYTHON = [
    "f() = 1\n", "def f(a=1, b): pass\n", "x = (1\n", "if x:\npass\n", "  x = 1\n", "def f():\n    a\n  b\n", "print 'x'\n", "f(a=1, b)\n", "x := 1\n", "a = 012\n", "'abc\n", "f'{a'\n", "f'{}'\n", "f'{a b}'\n", "f'{a!x}'\n", "b'é'\n", "'a' b'c'\n", "'\\x1'\n", "'\\N{no such name}'\n",
    "class A\n  pass\n", "try:\n  pass\n", "else: pass\n", "for x in y: pass\nelif z: pass\n", "a, b += 1\n", "del f()\n", "import a.b as c.d\n", "x = 1 +\n", "lambda *: 1\n", "def f(*): pass\n", "<<<<<<< HEAD\nx = 1\n", "x = 'a\nb'\n", "\tif a:\n        b\n", "x = 1 \\ \n", "match x:\n    pass\n", "except: pass\n", "“x”\n", "[*a for a in b]\n", "return = 1\n", "0_7_\n", "a\0b\n",
]


@pytest.mark.parametrize("text", PYTHON + NO_PYTHON)
def test_python_grammar_agrees_with_the_interpreter(text):
    import ast

    from corpuscle.llm.grammars import check

    try:
        ast.parse(text.removeprefix("\ufeff"))
        valid = True
    except (SyntaxError, ValueError):
        valid = False
    assert valid is (text in PYTHON) and check(text, "python").valid is valid


def test_python_grammar_on_mutations():
    import ast
    import glob
    import random
    import warnings

    from corpuscle.llm import grammars

    rng = random.Random(7)
    base = [open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{grammars.__file__.rsplit('/', 2)[0]}/**/*.py", recursive=True))]
    for text in base:
        assert grammars.check(text, "python").valid
        for _ in range(6):
            at, kind = rng.randrange(len(text) + 1), rng.choice("dxis")
            other = {"d": text[:at] + text[at + 1 :], "x": text[:at], "i": text[:at] + rng.choice("()[]{}:,='\"\n #*.@\\") + text[at:], "s": text[:at] + text[at + 1 : at + 2] + text[at : at + 1] + text[at + 2 :]}[kind]
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                try:
                    ast.parse(other)
                    valid = True
                except (SyntaxError, ValueError):
                    valid = False
            assert grammars.check(other, "python").valid is valid, (kind, at, other[max(at - 80, 0) : at + 80])


def test_python_of_any_depth():
    from corpuscle.llm.grammars import check

    assert check("x = " + "1 + " * 50_000 + "1\n", "python").valid
    assert check("x = " + "-" * 50_000 + "1\n", "python").valid
    assert check("x = " + "a if b else " * 5_000 + "c\n", "python").valid
