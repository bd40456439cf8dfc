import re

from lodeframe.operators import lookup, symbols

PY = "class MyService:\n    def do_work(self):\n        return fetch_rows(1)\n\nasync def standalone_func(a):\n    pass\n"
CS = "namespace Legacy.Services\n{\n    public class OrderService\n    {\n        public async Task<int> ProcessOrder(int id)\n        {\n            return Compute(id);\n        }\n    }\n    public interface IOrderService { }\n    public enum OrderStatus { A }\n}\n"
TS = "export interface IUserRepo {}\nexport type UserId = string;\nenum Role { A }\nexport class UserRepo {}\nexport async function loadUsers() {}\nconst buildPayload = (a) => a;\n"


def frame(spark, text, language):
    return spark.createDataFrame([(1, text, language, "services/billing/invoice.py")], "id int, text string, language string, path string")


def found(spark, text, language):
    return {(r["name"], r["kind"], r["line_start"]) for r in symbols.extract_symbols(frame(spark, text, language), ["id"]).collect()}


def test_languages(spark):
    assert found(spark, PY, "python") == {("MyService", "class", 1), ("do_work", "method", 2), ("standalone_func", "function", 5)}
    assert {("OrderService", "class", 3), ("ProcessOrder", "method", 5), ("IOrderService", "interface", 10), ("OrderStatus", "enum", 11)} <= found(spark, CS, "csharp")
    assert {("IUserRepo", "interface", 1), ("UserId", "type", 2), ("Role", "enum", 3), ("UserRepo", "class", 4), ("loadUsers", "function", 5), ("buildPayload", "function", 6)} <= found(spark, TS, "typescript")
    assert found(spark, "", "python") == set() == found(spark, PY, "cobol")


def test_blank_lines_before_a_declaration_belong_to_it(spark):
    assert found(spark, "x\n\n\nclass A", "csharp") == {("A", "class", 2)}


def test_names_kinds_and_lines_of_matches_by_themselves(spark):
    """Against a search for each form in the whole text; a text is read twice for a form, and no pattern compiled for it."""
    ts = "x = 1\n" * 3 + TS + "\n\n  function  $a (b) {\n}\nlet f = function(a) {}\nvar functionX = functionY => 1\nclass\n  Split {}\n" + "y\n" * 40
    cs = "\ufeff" + CS + "private static int\n  Total (\nprotected\u00a0void\u2003Run(int a)\ninternal struct Été\n"
    py = PY + "\tclass\u00a0In:\n\n\n def é_1 ():\nclass A\nclass B(\n)"
    plain = {"(?Umd)": "(?m)"}
    for text, language in ((ts, "typescript"), (cs, "csharp"), (py, "python")):
        want = set()
        for i, f in enumerate(symbols.FORMS):
            if language in f.languages:
                for m in re.finditer(f.pattern.replace(*next(iter(plain.items()))), text):
                    kind = m[f.kind_from].lower() if f.kind_from else "method" if i == symbols.INDENTED and m[1] else f.kind
                    want.add((m[f.name], kind, text.count("\n", 0, m.start()) + 1))
        assert len(want) > 4 and found(spark, text, language) == want
    plan = symbols.extract_symbols(frame(spark, ts, "typescript"), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_call_sites_skip_lists(spark):
    rows = symbols.extract_call_sites(frame(spark, "if (x)\nprint(foo_bar(1))\nfoo_bar (2); foo_bar(3)", "python"), ["id"]).collect()
    assert {(r["callee_name"], r["line"]) for r in rows} == {("foo_bar", 2), ("foo_bar", 3)}


def test_header(spark):
    head = symbols.code_headers(frame(spark, PY, "python"), ["id"]).first()["header"]
    assert head.split("\n") == ["FILE: services/billing/invoice.py", "LANGUAGE: python", "PROJECT: services", "SUBPROJECT: billing", "CLASSES: MyService", "FUNCTIONS: do_work, standalone_func", "TOKENS: services billing invoice py"]


def test_symbol_shaped_words():
    assert lookup.symbol_candidates("open BillingController and compute_total in class") == ["BillingController", "compute_total"]
    assert lookup.symbol_candidates("FooBar FooBar foo_x FOOBAR Other_one") == ["FooBar", "foo_x"]
    assert lookup.symbol_candidates(None) == []
