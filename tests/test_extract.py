import ast
import json
from pathlib import Path

import pytest

import fixtures
from codeloom.operators.extract import chunks, ordered, rejects
from codeloom.operators.patterns import PATTERNS, Pattern, pattern_table
from codeloom.functions.text import detect_language
from pyspark.sql import functions as F


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def described(frame):
    rows = frame.collect()
    return {
        (r.id, r.function_name, r.class_name, r.start_line, r.end_line, r.language, r.chunk_type) for r in rows
    }, {r.id: r.content for r in rows}


def test_goldens_in_effective_mode(spark):
    found, _ = described(chunks(files(spark, fixtures.FILES)))
    assert found == fixtures.PYTHON_CHUNKS


def test_goldens_in_declared_mode(spark):
    found, contents = described(chunks(files(spark, fixtures.FILES), "declared"))
    assert found == fixtures.PYTHON_CHUNKS | fixtures.BRACE_CHUNKS
    assert {key: contents[key] for key in fixtures.CONTENTS} == fixtures.CONTENTS


def test_bytes_are_repaired(spark):
    rows = spark.createDataFrame([("a.py", bytearray(b"x = '\xff'\n"))], "path string, content binary")
    assert [r.content for r in chunks(rows).collect()] == ["x = '�'"]


def test_unsupported_files(spark):
    found = {tuple(r) for r in rejects(files(spark, fixtures.FILES)).collect()}
    assert found == {("yard.txt", "unsupported file type: yard.txt"), ("yard", "unsupported file type: yard")}


def test_language_detection(spark):
    paths = ["a/t.py", "a/t.go", "a/t.js", "a/t.ts", "a/t.tsx", "a/t.rs", "a/t.txt", "a/t", "a/t.PY"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(detect_language(F.col("path")))
    expected = ["python", "go", "javascript", "typescript", "typescript", "rust", None, None, None]
    assert [r[0] for r in rows.collect()] == expected


def test_deterministic_order(spark):
    rows = [r.id for r in ordered(chunks(files(spark, fixtures.FILES))).collect()]
    assert rows[0] == "yard.py_DEPTH_1" and rows[-1] == "yard.py_drain_13"


HARD = '''
"""def not_here():
    x = 1
"""
import os; import sys
from a import (
    b,
    c,
)
x = y
a = b = 1
c = d = e
f, g = h = 2
self.rate = i = 3
n: int = 4
m: "Dict[str, int]"
u += 1
w = {
    "k": 1,  # def inside():
    'v': [2,
          3],
}  # tail
p = 1; q = 2;
if x: r = 1
t = "a # b" # c
z = lambda k=1: k
v = x == y
@deco(
    arg=1,
)
async def outer(
    a,
    b=2,
) -> int:
    s = """
def fake():
    """
    def inner(): return 1
    return (
        s
    )
    # trailing note
  # note to the left

class A(B):
	def tabbed(self):
		k = \\
			1
		return k

	class C:
		pass
last = None
'''


def test_hard_python(spark):
    rows = chunks(files(spark, [("h.py", HARD)])).collect()
    found = {(r.chunk_type, r.class_name or r.function_name, r.start_line, r.end_line) for r in rows if r.chunk_type in ("classes",)}
    found |= {(r.chunk_type, r.function_name, r.start_line, r.end_line) for r in rows if r.chunk_type != "classes"}
    content = {(r.chunk_type, r.function_name, r.start_line): r.content for r in rows}
    assert found == {
        ("variables", "y", 10, 10),
        ("variables", "a", 11, 11),
        ("variables", "b", 11, 11),
        ("variables", "c", 12, 12),
        ("variables", "e", 12, 12),
        ("variables", "h", 13, 13),
        ("variables", "i", 14, 14),
        ("variables", "n", 15, 15),
        ("variables", "w", 18, 22),
        ("variables", "p", 23, 23),
        ("variables", "q", 23, 23),
        ("variables", "r", 24, 24),
        ("variables", "t", 25, 25),
        ("variables", "z", 26, 26),
        ("variables", "v", 27, 27),
        ("functions", "outer", 31, 42),
        ("variables", "s", 35, 37),
        ("functions", "inner", 38, 38),
        ("classes", "A", 45, 52),
        ("methods", "tabbed", 46, 49),
        ("variables", "k", 47, 48),
        ("classes", "C", 51, 52),
        ("variables", "last", 53, 53),
    }
    assert content["variables", "a", 11] == content["variables", "b", 11] == "b = 1"
    assert content["variables", "w", 18].endswith("}")
    assert content["variables", "p", 23] == "p = 1" and content["variables", "q", 23] == "q = 2"
    assert content["variables", "t", 25] == 't = "a # b"'
    assert content["functions", "outer", 31].endswith("# trailing note")
    assert content["functions", "inner", 38] == "def inner(): return 1"


def test_declared_python(spark):
    rows = chunks(files(spark, [("h.py", HARD)]), "declared").collect()
    names = {(r.function_name, r.start_line) for r in rows if r.chunk_type == "variables"}
    assert {("x", 10), ("a", 11), ("b", 11), ("c", 12), ("d", 12)} <= names
    imports = {(r.id, r.end_line, r.content.split("\n")[0]) for r in rows if r.chunk_type == "imports"}
    assert imports == {
        ("h.py_imports_5", 5, "import os"),
        ("h.py_imports_5", 5, "import sys"),
        ("h.py_imports_6", 9, "from a import ("),
    }


def test_own_patterns(spark):
    mine = PATTERNS + (Pattern("python", "decorators", "", r"@(\w+)", "statement", "effective", True, "@"),)
    rows = chunks(files(spark, [("h.py", HARD)]), patterns=mine).where("chunk_type = 'decorators'").collect()
    assert [(r.function_name, r.start_line, r.end_line) for r in rows] == [("deco", 28, 30)]
    assert pattern_table(spark, mine).count() == len(mine)


def from_ast(path, text):
    """(type, name, class, start, end) of functions and classes by Python's own parser."""
    found = set()

    def visit(node, owner):
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "methods" if owner else "functions"
                found.add((path, kind, child.name, owner or "", child.lineno, child.end_lineno))
            elif isinstance(child, ast.ClassDef):
                found.add((path, "classes", "", child.name, child.lineno, child.end_lineno))
                inner = child.name
            visit(child, inner)

    visit(ast.parse(text), None)
    return found


def test_against_python_parser(spark):
    """Real modules: same declarations, and ends that differ by trailing comments at most."""
    sources = sorted(Path(ast.__file__).parent.glob("[a-d]*.py")) + sorted(Path(json.__file__).parent.glob("*.py"))
    rows = [(str(p), p.read_text(encoding="utf-8")) for p in sources]
    expected = set().union(*[from_ast(p, t) for p, t in rows])
    found = chunks(files(spark, rows).repartition(8)).where("chunk_type <> 'variables'").collect()
    mine = {(r.file_path, r.chunk_type, r.function_name, r.class_name, r.start_line): r.end_line for r in found}
    assert len(expected) > 1000
    assert set(mine) == {e[:5] for e in expected}
    lines = {p: t.split("\n") for p, t in rows}
    for e in expected:
        tail = lines[e[0]][e[5] : mine[e[:5]]]
        assert mine[e[:5]] >= e[5] and all(not x.strip() or x.strip().startswith("#") for x in tail), e


BRACES = {
    "a.go": ("func f(a struct{ x int }) (int, error) {\n\treturn `}\n{`, nil\n}\n\nvar (\n\ta = 1\n)\nfunc asm(x int) int\nfunc g() {}\n",
             {("f", 1, 4), ("a", 6, 8), ("g", 10, 10)}),
    "a.js": ("export default function f({ a }, b = {}) {\n  const re = /[}/]{/g;\n  return `}${a}`;\n}\nfunction g()\n{\n  /* } */\n}\n",
             {("f", 1, 4), ("re", 2, 2), ("g", 5, 8)}),
    "a.rs": ("trait T {\n    fn no_body(&self);\n    fn body<'a>(&'a self) -> char { '}' }\n}\nstruct Unit;\nstruct Pair(i32, i32);\npub(crate) static mut N: [u8; 2] = [\n    1,\n    2,\n];\nimpl<T> Generic<T> {\n}\nimpl T for Unit {\n    const K: i32 = 1;\n}\n",
             {("T", 1, 4), ("body", 3, 3), ("N", 7, 10), ("", 13, 15), ("K", 14, 14)}),
    "a.ts": ("function over(a: string): void;\nfunction over(a: any): void {\n}\nabstract class A {}\nexport type M<K> = {\n  [k in keyof K]: string;\n};\n",
             {("over", 2, 3), ("M", 5, 7)}),
}


@pytest.mark.parametrize("path", sorted(BRACES))
def test_hard_braces(spark, path):
    text, expected = BRACES[path]
    rows = chunks(files(spark, [(path, text)]), "declared").collect()
    assert {(r.function_name or r.class_name, r.start_line, r.end_line) for r in rows} == expected


def test_arrows(spark):
    text = "const f = (a) => a * 2;\nconst g = (x) => {\n  return m.map((y) => y + 1).filter((z) => [z, 1]);\n};\nconst h = async (q) =>\n  q + 1;\n"
    rows = chunks(files(spark, [("a.ts", text)]), "declared", arrows=True).where("chunk_type = 'functions'").collect()
    assert {(r.id, r.content) for r in rows} == {
        ("a.ts_functions_1", "(a) => a * 2"),
        ("a.ts_functions_2", "(x) => {\n  return m.map((y) => y + 1).filter((z) => [z, 1]);\n}"),
        ("a.ts_functions_3", "(y) => y + 1"),
        ("a.ts_functions_3", "(z) => [z, 1]"),
        ("a.ts_functions_5", "async (q) =>\n  q + 1"),
    }


def names_of(spark, path, text, mode="declared"):
    return {(r.function_name or r.class_name, r.start_line, r.end_line) for r in chunks(files(spark, [(path, text)]), mode).collect()}


def test_deep_brackets(spark):
    deep = "[" * 30 + "int" + "]" * 30
    text = f"x: A{deep} = 1\ny[a(b(c(d(e(f(1))))))] = w = 2\n"
    assert {n for n, _, _ in names_of(spark, "a.py", text, "effective")} == {"x", "w"}


def test_regular_expressions_with_braces(spark):
    text = "function f(x) {\n  return /[{]/.test(x);\n}\nconst r =          /{/;\nfunction g() {\n  return 1;\n}\n"
    assert names_of(spark, "a.js", text) == {("f", 1, 3), ("r", 4, 4), ("g", 5, 7)}


def test_raw_strings_and_nested_comments(spark):
    text = 'const A: &str = r###"{"##{"###;\n/* a /* { /* b */ */ */\nfn f() -> u8 {\n    1\n}\nconst C: char = \'\\u{1F600}\';\nfn g() {}\n'
    assert names_of(spark, "a.rs", text) == {("A", 1, 1), ("f", 3, 5), ("C", 6, 6), ("g", 7, 7)}


GROUPS = """package p

const (
\tLow, High = 1, 2 // x, y = 1
\tSum       = Low +
\t\tHigh
\tIota
\tText = `
Fake = 1
`
)
var a, b = f(1, 2), "x, y"
var (
\tm map[string]int
\tn, o = []int{
\t\t1,
\t}, 2
)
type (
\tPair[K any] struct {
\t\tx, y int
\t}
\tSame = int
\tList []Pair[int]
)
type One struct{ q int }
type Same2 = One
const c1 = 1; var tail = 2
"""


def test_go_groups(spark):
    expected = {(n, 3, 11) for n in ("Low", "High", "Sum", "Text")}
    expected |= {("a", 12, 12), ("b", 12, 12), ("m", 13, 18), ("n", 13, 18), ("o", 13, 18)}
    expected |= {("Pair", 19, 25), ("List", 19, 25), ("One", 26, 26), ("c1", 28, 28), ("tail", 28, 28)}
    assert names_of(spark, "a.go", GROUPS) == expected


def test_several_declarators(spark):
    text = """let a = 1, b = [2, 3], { hidden } = f(x, y);
const d = 1; const e = 2;
if (x) { var c = { k: 1, m: 2 }; }
for (let i = 0, n = 5; i < n; i++) { const q = i; }
for (const z of zs) { run(z); }
export const g = async (p, r) => {
  return p;
}, h = 2;
var u, v;
w.let = 3; outlet = 4;
const { one, two } = three;
"""
    rows = chunks(files(spark, [("a.js", text)]), "declared").collect()
    found = {(r.function_name, r.start_line, r.end_line): r.content for r in rows}
    assert found == {
        ("a", 1, 1): "let a = 1, b = [2, 3], { hidden } = f(x, y);",
        ("b", 1, 1): "let a = 1, b = [2, 3], { hidden } = f(x, y);",
        ("d", 2, 2): "const d = 1;",
        ("e", 2, 2): "const e = 2;",
        ("c", 3, 3): "var c = { k: 1, m: 2 };",
        ("i", 4, 4): "let i = 0, n = 5;",
        ("n", 4, 4): "let i = 0, n = 5;",
        ("q", 4, 4): "const q = i;",
        ("g", 6, 8): "const g = async (p, r) => {\n  return p;\n}, h = 2;",
        ("h", 6, 8): "const g = async (p, r) => {\n  return p;\n}, h = 2;",
        ("u", 9, 9): "var u, v;",
        ("v", 9, 9): "var u, v;",
    }


def test_type_arguments_are_no_declarators(spark):
    text = "const m: Map<string, Map<number, boolean>> = new Map(), k: (a: A, b: B) => void = f;\nconst enum E { A }\ndeclare const t: T;\n"
    assert names_of(spark, "a.ts", text) == {("m", 1, 1), ("k", 1, 1), ("t", 3, 3)}


MIDLINE = {
    "a.js": ("if (x) { function q() { return 1; } }\nlet z = 1; function tail() {}\nclass A {} class B {}\n",
             {("q", 1, 1, "function q() { return 1; }"), ("tail", 2, 2, "function tail() {}"), ("z", 2, 2, "let z = 1;"),
              ("A", 3, 3, "class A {}"), ("B", 3, 3, "class B {}")}),
    "b.rs": ("mod m { fn a() {} }\nimpl A { fn b(&self) {} }\n#[test] fn c() {}\n#[derive(Debug, Clone)]\npub struct S { x: i32 }\n",
             {("a", 1, 1, "fn a() {}"), ("b", 2, 2, "fn b(&self) {}"), ("", 2, 2, "impl A { fn b(&self) {} }"),
              ("c", 3, 3, "fn c() {}"), ("S", 5, 5, "pub struct S { x: i32 }")}),
    "c.ts": ("type A = string; type B = number;\nnamespace N { export function f(): void {\n  return;\n} }\n",
             {("A", 1, 1, "type A = string;"), ("B", 1, 1, "type B = number;"), ("f", 2, 4, "function f(): void {\n  return;\n}")}),
    "d.go": ("package p\nfunc a() {}; func b() int { return 1 }\n",
             {("a", 2, 2, "func a() {}"), ("b", 2, 2, "func b() int { return 1 }")}),
}


@pytest.mark.parametrize("path", sorted(MIDLINE))
def test_declarations_behind_other_code(spark, path):
    text, expected = MIDLINE[path]
    rows = chunks(files(spark, [(path, text)]), "declared").collect()
    assert {(r.function_name or r.class_name or "", r.start_line, r.end_line, r.content) for r in rows} == expected


@pytest.mark.parametrize("levels", [5, 60, 5000])
def test_no_nesting_limit(spark, levels):
    deep = "[" * levels + "int" + "]" * levels
    calls = "f(" * levels + "1" + ")" * levels
    py = f"y: A{deep} = 1\nz[{calls}] = w = 2\n"
    assert {n for n, _, _ in names_of(spark, "a.py", py, "effective")} == {"y", "w"}
    js = f"let a = {calls}, b = 2;\nconst c = [{deep}];\n"
    assert names_of(spark, "a.js", js) == {("a", 1, 1), ("b", 1, 1), ("c", 2, 2)}
    go = f"package p\nvar (\n\tv = {calls}\n\tu = 3\n)\n"
    assert {n for n, _, _ in names_of(spark, "a.go", go)} == {"v", "u"}


def test_a_failing_pattern_is_reported_and_skipped(spark):
    broken = Pattern("python", "broken", "", r"def\s+(unclosed", "statement", "effective", True, "def")
    with pytest.warns(UserWarning, match="pattern skipped"):
        rows = chunks(files(spark, [("h.py", "def f():\n    return 1\n")]), patterns=PATTERNS + (broken,)).collect()
    assert [(r.function_name, r.chunk_type) for r in rows] == [("f", "functions")]
