import ast
import random
from datetime import datetime
from pathlib import Path

import pytest

from loomgraph.llm import syntax, validity

GOOD = {
    "python": ["", "x = 1\n", "def f(a, /, b=1, *c, d, **e):\n    return f'{a!r:>{b}} {c[\"k\"]}'\n", "match x:\n    case {'a': [1, *r]} if r:\n        pass\n    case P(x=1) | None:\n        pass\n", "with (open('a') as f, b):\n    pass\n", "a: int = 1\nb, *c = d\nx = y = [i for i in z if i]\n", "try:\n    pass\nexcept* E as e:\n    raise\n", "class A[T](B, metaclass=C):\n    x = lambda *a, k=1: (yield)\n", "if 1:\n\tx = (1,\n  2)\n", "@d\nasync def f():\n    async for i in x: await y\n", "print(*a, sep='')\nx[1:2, ::3] = ...\n", "type X = int\n"],
    "javascript": ["", "const {a, ...b} = c, [d = 1,, e] = f;\n", "a = b\n++c\n", "x => ({y: x}); async (a, b = 1) => { await a }\n", "for (const [k, v] of Object.entries(o)) continue;\n", "if (a) /re[/]g/.test(b); else c\n", "`a${`b${c}`}d`\n", "class A extends B { static #p = 1; get x() { return this.#p } async *g() { yield* h() } }\n", "import a, {b as c} from 'd'; export default function () {}\n", "switch (a) { case 1: break; default: }\n", "label: for (;;) { break label }\n", "a?.b?.[c] ?? d ** 2\n", "var f = function* () {}, g = new (h())(1)\n"],
    "typescript": ["interface A<T extends B = C> extends D { x?: number; [k: string]: any; m(a: T): void }\n", "let a: Map<string, Array<number>> = new Map<string, Array<number>>();\n", "type F = (a: number, ...b: string[]) => asserts a is T;\n", "abstract class A implements B { constructor(private readonly x: number) { super() } abstract m(): void; y!: string }\n", "enum E { A = 1, B }\nconst x = y as unknown as string[];\n", "function f<T>(this: A, x: T): x is B { return x! }\n", "declare module 'm' { export const a: number; }\n", "type M = { readonly [K in keyof T]?: T[K] extends infer U ? U : never };\n", "const g = (a: A): B => a;\n"],
    "java": ["", "package a.b; import static c.D.*; public class A<T extends B & C> { int[] x = {1, 2}; A() { this(1); } }\n", "class A { void f() throws E { for (var x : y) { List<String> l = new ArrayList<>(); l.forEach(String::valueOf); } } }\n", "enum E { A(1) { void f() {} }, B; final int x = 1 >> 2 >>> 3; }\n", "record P(int x, String... y) implements Q { P { } }\n", "interface I { default int f(int x) { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } }\n", "class A { Object f(Object o) { if (o instanceof String s && s.length() > 1) return (Runnable) () -> {}; return a < b ? (int) c : -d; } }\n", "@interface A { int v() default 1; }\n", "class A { String t = \"\"\"\n x \"y\" \"\"\"; char c = '\\''; { try (var r = f()) { } finally { } } }\n"],
    "go": ["package a\n", "package a\nimport (\n\t\"fmt\"\n\tb \"c\"\n)\nfunc (s *S[T]) f(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[1]; ok {\n\t\treturn v, nil\n\t}\n\tfor i := range 10 {\n\t}\n\tselect {\n\tcase x := <-c:\n\tdefault:\n\t}\n\treturn\n}\n", "package a\ntype S struct {\n\tA, B int `x`\n\t*E\n}\nvar x = []S{{A: 1}, {B: 2}}\nconst (\n\tc = iota\n\td\n)\n", "package a\nfunc f[T any, U ~int|string](x T) { switch y := z.(type) { case int, []string: } ; go func() {}(); defer g() }\n"],
    "rust": ["", "#![allow(x)]\nuse a::{b, c::*};\npub(crate) fn f<'a, T: A + 'a>(x: &'a mut T, y: [u8; 3]) -> Result<Vec<T>, E> where T: B { let Some(z) = y else { return Err(e) }; x.a::<T>()?.b[1] = 2..=3; Ok(vec![1]) }\n", "impl<T> A for B<T> { type C = D; const E: u8 = 1 << 2; fn f(&self) { match self { A { x, .. } | B(1..=2) if x > 1 => {}, _ => (), } } }\n", "enum E { A, B(u8), C { x: i32 } = 1 }\nmacro_rules! m { ($a:expr) => { $a } }\n", "fn f() { let c = |a, b: u8| a + b; loop { break 'x'; } if x < y as u8 { } else if let Some(_) = z {} ; r#\"a \"b\" \"#; }\n", "struct S<'a>(&'a str);\ntrait T: U { fn f(self: Box<Self>) -> impl Fn(u8) -> u8; }\n"],
}
BAD = {
    "python": ["def f(:\n", "x = (1\n", "if 1:\npass\n", "print 'x'\n", "<<<<<<< HEAD\n", "f(a)=1\n", "x = 'a\n", "  x\n", "a b\n", "const x = 1;\n", "f'{a'\n", "try:\n    x\n", "f(a=1, b)\n", "x = 1e\n", "if 1:\n        a\n    b\n"],
    "javascript": ["function (", "const x;", "a b", "=======\n", "if (a {", "`a${b", "return 1", "1 = 2", "import a.b.c;", "x = 'a\n'", "{", "break;", "for (a b) {}", "class { }", "# Title", "var 1a"],
    "typescript": ["let a: = 1", "interface { }", "function f(a: ) {}", "package main", "type A = ", "class A { x: }"],
    "java": ["class A {", "int x = 1;", "class A { void f() { x } }", "class A { void f() { int x = 1 } }", "import a", "def f(): pass", "class A { void f() { 1 + 2; } }", "class A { String s = \"a; }", "}"],
    "go": ["", "func f() {}", "package a\nfunc f( {}", "package a\nx := 1\n", "package a\nfunc f() { if { } }", "package a\nfunc f() {\n\treturn 1\n", "package a\nvar x = \"a\n", "package a\nfunc f() {}\nimport \"b\"\n", "package a.b;\n"],
    "rust": ["fn f( {}", "let x = 1;", "fn f() { let x = ; }", "fn f() { a b }", "struct S { x: }", "fn f() { /* a }", "package a", "fn f() -> { }", "fn f() { match x { 1 => } }"],
}


@pytest.mark.parametrize("language", list(GOOD))
def test_accepts_and_rejects(language):
    for s in GOOD[language]:
        assert syntax.errors(language, s) == [], s
    for s in BAD[language]:
        assert syntax.errors(language, s), s


def test_python_like_the_language_itself():
    rng = random.Random(8)
    files = sorted(Path(ast.__file__).parent.glob("*.py"))[:40]
    for f in files:
        s = f.read_text(errors="replace")
        assert syntax.errors("python", s) == [], f
        lines = s.split("\n")
        for _ in range(2):
            cut = "\n".join(lines[: rng.randrange(1, len(lines))])[: rng.randrange(200, 20_000)]
            try:
                ast.parse(cut)
                ok = True
            except SyntaxError:
                ok = False
            assert ok == (syntax.errors("python", cut) == []), cut[-200:]


def test_all_errors_and_causes():
    assert [line for line, _ in syntax.errors("python", "def f():\n    x = = 1\n    y = 2\nz = = 3\n")] == [2, 4]
    assert len({line for line, _ in syntax.errors("javascript", "a b;\nf();\nconst x;\ng(\n);\nif {}\n")}) == 3
    for language, text, cause in (("python", "a\n<<<<<<< x\n", "conflict"), ("python", "package a;\nclass A {}\n", "other_language"), ("javascript", "function f() {\n  g(1);\n", "truncated"), ("javascript", "a b;\nf();\n", "damaged")):
        assert syntax.first_cause(language, text, syntax.errors(language, text)) == cause
    assert syntax.errors("python", "(" * 3000) != []


def test_more_of_the_grammars():
    for language, good, bad in (
        ("javascript", ["({a = 1} = b)", "for ({a = 1} of b) c", "({a = 1}) => a", "[{a = 1}] = b", "var let = 1", "(a || b) ?? c", "a ?? b | c", "(-a) ** b", "a ** -b", "/a/gi", "a\n<!-- html comment\nb\n--> more\nc", "a - -b"], ["({a = 1})", "f({a = 1})", "let let = 1", "const let = 1", "a ?? b || c", "a && b ?? c", "a || b ?? c", "-a ** b", "/a/gg", "/a/x"]),
        ("go", ["package a\nfunc f(a, b int, c ...string) {}", "package a\nfunc f(int, string) {}", "package a\nfunc f(a b.C, d *E) {}", "package a\nfunc f(map[string]int, *T) {}"], ["package a\nfunc f(a int, string) {}", "package a\nfunc f(*T, a int) {}", "package a\nfunc f(a int, []b) {}"]),
        ("rust", ["fn f() { a < b && c > d; x == (y == z); a::<B>(c); }"], ["fn f() { a < b > c; }", "fn f() { a == b == c; }"]),
        ("java", ["class A { int[] x = new int[3][]; int[] y = new int[]{1}; int f(int a) { switch (a) { case 1: return 2; default: return 3; } } }"], ["class A { int[] x = new int[]; }", "class A { int[] x = new int[2]{1, 2}; }", "class A { void f(int a) { switch (a) { case 1 -> y(); case 2: z(); } } }"]),
    ):
        for s in good:
            assert syntax.errors(language, s) == [], s
        for s in bad:
            assert syntax.errors(language, s), s


def test_deep_nesting_is_no_error():
    n = 20_000
    assert syntax.errors("javascript", "x = " + "[" * n + "]" * n + ";") == []
    assert syntax.errors("javascript", "x = " + "[" * n + "]" * (n - 1) + ";") != []
    assert syntax.errors("go", "package a\nvar x = " + "(" * n + "1" + ")" * n + "\n") == []


def test_sources(spark):
    d = lambda n: datetime(2026, 1, n)
    rows = [
        ("r/a.py", "x =", d(1), 1), ("r/a.py", "x = 1", d(2), 1), ("r/b.PY", "x = 1", d(1), 1), ("r/b.PY", "x =", d(3), 1), ("r/b.PY", "x =", d(3), 1), ("r/c.py", "", None, 1), ("r/d.py", None, d(1), 1),
        ("r/e.txt", "(((", d(1), 1), ("q/f.go", "", d(1), 1), (None, "(((", d(1), 1),
    ]
    df = spark.createDataFrame(rows, "path string, source string, mtime timestamp, errors int")
    assert {r["path"] for r in validity.unparsable(df).collect()} == {"r/b.PY", "q/f.go"}
    got = {(r["repo"], r["language"]): (r["files"], r["rejected"], r["share"]) for r in validity.acceptance(df).collect()}
    assert got == {("r", "python"): (3, 1, 1 / 3), ("q", "go"): (1, 1, 1.0)}
    assert {(r["path"], r["line"]) for r in validity.causes(df).collect()} == {("r/b.PY", 1), ("q/f.go", 1)}
    assert validity.unparsable(df.where("false")).collect() == []
