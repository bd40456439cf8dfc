"""Declarations against Python's own parser, and against sources that are generated with what they declare."""

import ast
import glob
import os
import random

import pytest

import lodeframe
from lodeframe.operators.declarations import declarations, extract_declarations

from .test_symbols import CS, PY, TS

JS = 'export class UserService {\n    #n = new Map()\n    constructor() { this.x = "}"; }\n\n    async fetchUser(id) {\n        return fetch(`u/${id}`); // }\n    }\n    static make = (a) => a;\n}\n\nexport function createUser(name) {\n    function inner() { return 1 }\n    const f = function named() {};\n    return { name };\n}\n\nconst helperFn = async (x) => x + 1;\n'


def shown(text, language):
    return [(d.name, d.kind, d.line_start, d.line_end) for d in declarations(text, language)]


def test_forms():
    assert shown(PY, "python") == [("MyService", "class", 1, 3), ("do_work", "method", 2, 3), ("standalone_func", "function", 5, 6)]
    assert shown(CS, "csharp") == [("OrderService", "class", 3, 9), ("ProcessOrder", "method", 5, 8), ("IOrderService", "interface", 10, 10), ("OrderStatus", "enum", 11, 11)]
    assert shown(TS, "typescript") == [("IUserRepo", "interface", 1, 1), ("UserId", "type", 2, 2), ("Role", "enum", 3, 3), ("UserRepo", "class", 4, 4), ("loadUsers", "function", 5, 5)]
    assert shown(JS, "javascript") == [("UserService", "class", 1, 9), ("constructor", "method", 3, 3), ("fetchUser", "method", 5, 7), ("createUser", "function", 11, 15), ("inner", "function", 12, 12)]
    assert [d.signature for d in declarations(PY, "python")][1] == "def do_work(self):"
    assert {d.namespace for d in declarations(CS, "csharp")} == {"Legacy.Services"}
    sharp = "namespace A.B;\n[Serializable]\npublic sealed class C<T> : Base(1) where T : new()\n{\n  private readonly int x = Make(3);\n  public C(int a) : base(a) { }\n  [Fact(Skip = \"no {\")]\n  public Task<List<int>> Run(int q)\n    => Go(q);\n  public int P { get; set; }\n  string S() { if (a) { B(); } return @\"x\"\"}\"; }\n}\ninterface I { void M(); }\nstruct V { }\n"
    assert shown(sharp, "aspnet") == [("C", "class", 2, 12), ("C", "method", 6, 6), ("Run", "method", 7, 9), ("S", "method", 11, 11), ("I", "interface", 13, 13), ("M", "method", 13, 13), ("V", "struct", 14, 14)]
    typed = "type A = {\n  x: string\n} | null\nabstract class K<T> implements J {\n  abstract go(): void;\n  run<U>(a: U): U { return a }\n  y = call(1)\n  get z(): number { return 1 }\n}\nlet q = class Named {};\ndeclare function d(a: string): void;\n"
    assert shown(typed, "typescript") == [("A", "type", 1, 3), ("K", "class", 4, 9), ("run", "method", 6, 6), ("z", "method", 8, 8), ("d", "function", 11, 11)]
    for text in ("", None, "}}}", "class", "class X", "def f(", "'''", "function f() {"):
        for language in ("python", "csharp", "javascript", "typescript"):
            declarations(text, language)


def test_python_against_its_parser():
    """Names, kinds, lines and extents of this library's and the standard library's own sources."""
    paths = sorted(glob.glob(os.path.join(os.path.dirname(lodeframe.__file__), "**/*.py"), recursive=True)) + sorted(glob.glob(ast.__file__.rsplit("/", 1)[0] + "/[a-e]*.py"))
    assert len(paths) > 60
    for path in paths:
        text = open(path, encoding="utf-8").read()
        if "\f" in text:
            continue
        nodes = [n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
        line = text.split("\n")
        kind = lambda n, line=line: "class" if isinstance(n, ast.ClassDef) else "method" if line[n.lineno - 1][0].isspace() else "function"
        assert sorted(shown(text, "python")) == sorted((n.name, kind(n), n.lineno, n.end_lineno) for n in nodes), path


class Source:
    """Random nested source with what it declares."""

    def __init__(self, seed, language):
        self.rng, self.language, self.lines, self.found, self.n = random.Random(seed), language, [], [], 0

    def noise(self, pad):
        sharp = self.language == "csharp"
        self.lines += self.rng.choice([[], [f"{pad}// class No {{ }}"], [f"{pad}/* {{ function no() {{", f"{pad}*/"], [f'{pad}{"var" if sharp else "let"} s = "}} class Nah {{";'], [""]])

    def body(self, pad, deep):
        for _ in range(self.rng.randrange(3)):
            self.noise(pad)
            pick = self.rng.randrange(4)
            if pick == 0:
                self.lines += [f"{pad}if (check(a, {{}})) {{", f"{pad}  call(1);", f"{pad}}}"]
            elif pick == 1 and self.language != "csharp" and deep:
                self.function(pad, deep - 1)
            else:
                self.lines.append(f"{pad}call(x, () => {{ return go(); }});")

    def name(self, head):
        self.n += 1
        return f"{head}{self.n}"

    def scope(self, name, kind, head, pad, fill):
        at, mine = len(self.lines) + 1, len(self.found)
        self.found.append(None)
        self.lines += [f"{pad}{head} {{"] if self.rng.random() < 0.5 else [f"{pad}{head}", f"{pad}{{"]
        fill()
        self.lines.append(f"{pad}}}")
        self.found[mine] = (name, kind, at, len(self.lines))

    def function(self, pad, deep):
        name = self.name("fn")
        self.scope(name, "function", f"{self.rng.choice(['', 'async '])}function {name}(a, b = {{}})", pad, lambda: self.body(pad + "  ", deep))

    def method(self, pad):
        name = self.name("Me")
        head = {"csharp": f"public async Task<Map<int, string>> {name}(int a = 1)", "typescript": f"private {name}(a: string): Promise<void>"}.get(self.language, f"{name}(a)")
        self.scope(name, "method", head, pad, lambda: self.body(pad + "  ", 1))

    def type(self, pad, deep):
        name = self.name("Cl")
        head = f"{'public partial ' if self.language == 'csharp' else 'export ' if not pad else ''}class {name}"

        def fill():
            for _ in range(self.rng.randrange(4)):
                if deep and self.language == "csharp" and self.rng.random() < 0.3:
                    self.type(pad + "  ", deep - 1)
                else:
                    self.method(pad + "  ")

        self.scope(name, "class", head, pad, fill)

    def text(self):
        for _ in range(6):
            self.noise("")
            self.type("", 2) if self.language == "csharp" or self.rng.random() < 0.5 else self.function("", 2)
        return "\n".join(self.lines) + "\n"


@pytest.mark.parametrize("language", ["csharp", "javascript", "typescript"])
def test_generated_sources(language):
    for seed in range(60):
        source = Source(seed, language)
        text = source.text()
        assert shown(text, language) == source.found, text


def test_rows(spark):
    """Keys stay, unknown languages go by patterns, a file of very many declarations takes its length and no more."""
    many = "".join(f"def f{i}():\n    return g{i}()\n\n" for i in range(100_000))
    rows = [(1, PY, "Python "), (2, TS, "typescript"), (3, CS, ""), (4, None, "python"), (5, "class X:\n  pass", "cobol"), (6, many, "python"), (1, PY, "python")]
    df = spark.createDataFrame(rows, "id int, text string, language string")
    got = extract_declarations(df, ["id"]).collect()
    count = {i: sum(r["id"] == i for r in got) for i in range(1, 7)}
    assert count[1] == 6 and count[2] == 5 and count[3] >= 4 and count[4] == count[5] == 0 and count[6] == 100_000
    assert {(r["name"], r["line_end"], r["signature"]) for r in got if r["id"] == 1} == {("MyService", 3, "class MyService:"), ("do_work", 3, "def do_work(self):"), ("standalone_func", 6, "async def standalone_func(a):")}
    assert all(r["line_end"] is None for r in got if r["id"] == 3)
