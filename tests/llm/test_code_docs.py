from conftest import clash

from chunkwise.llm import code_docs as cd

S = "decl_id long, declaration_type string, declaration_name string, class_name string, lang string, full_text string"


def doc(text, name="readFile"):
    toks = cd.lex(text)
    comments, _, _ = cd.declaration(text, toks)
    return cd.description(comments, text, name) if comments else None


def test_documentation_of_any_form():
    assert doc("/** Opens the archive and checks every entry. */\nfun readFile() {}") == "Opens the archive and checks every entry."
    assert doc("// Opens the archive and\n// checks every entry.\nfun readFile() {}")
    assert doc("/* Opens the archive and checks every entry. */\n@Ann(\"// no\")\nfun readFile() {}")
    assert doc("/** 再起動の後に検索結果を削除する。 */\nfun readFile() {}")
    assert doc("/** Le répertoire génère la dernière étape. */\r\nint readFile() {}")
    assert doc("/* Copyright (c) us. */\n\n/** Opens the archive and checks every entry. */\nfun readFile() {}")
    assert doc("/**\n * TODO: tidy\n *\n * Opens the archive and checks entries.\n */\nfun readFile() {}")


def test_trivial_documentation():
    for text in ("/** */", "/**/", "/** Reads the file. */", "/** @param a the first of many many long words\n */", "// ------", "/** TODO describe what this does */", "/* Generated by the build. Do not edit this file by hand. */",
                 "/** {@inheritDoc} */", "// val a = read(4)", "/* Auto-generated method stub */", "/** ??? */", "/** n/a */", "/** Gets the value. */", "/* Copyright the authors. Redistribution keeps this notice in every form. */", "// region helpers"):
        assert doc(text + "\nfun readFile(a: Int) {}") is None, text
    assert doc('fun readFile() { /** Opens the archive and checks every entry. */ val s = "/** Opens the archive and checks all. */" }') is None


def test_rows(spark):
    good = "/** Opens the archive and checks every entry. */\nfun f() { log(\"}\") }\ntrailing"
    rows = [(1, "METHOD", "f", "C", "kotlin", good), (1, "METHOD", "f", "C", "kotlin", good), (2, "CLASS", "C", None, "kotlin", good), (3, "FUNCTION", None, None, None, good), (4, "METHOD", "f", None, "java", None), (5, "METHOD", "f", None, "java", ""), (6, None, "f", None, None, good), (7, "METHOD", "long", None, None, "/** " + "word " * 200000 + "*/ fun long() {}")]
    df = clash(spark.createDataFrame(rows, S), "code", "description", "doc")
    got = {r["decl_id"]: r for r in cd.declaration_pairs(df).collect()}
    assert set(got) == {1, 3} and got[1]["code"] == 'fun f() { log("}") }' and got[1]["description"] == "Opens the archive and checks every entry."
    assert cd.declaration_pairs(df.where("false")).count() == 0


def test_functions_of_a_file(spark):
    text = 'class A {\n  /** Opens the archive and checks every entry. */\n  int open(String s) { if (s == "{") { return 1; } return 2; }\n  // short\n  void shut() { open("}"); }\n}\n'
    got = cd.functions(text)
    assert [(f["name"], f["class_name"], bool(f["doc"])) for f in got] == [("open", "A", True), ("shut", "A", False)]
    assert got[0]["code"].endswith("return 2; }")
    files = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    assert [r["name"] for r in cd.file_pairs(files, "id", "text").collect()] == ["open"]


SAID = "Opens the archive and checks every entry."


def names(text):
    return [f["name"] for f in cd.functions(text) if f["doc"] == SAID]


def test_members_without_braces():
    d = f"/** {SAID} */\n"
    assert names(f"class A {{\n/** Another text about nothing of any use here. */\nconstructor(x: String) : this(0)\n\n{d}fun open(a: Int): Int {{ return 1 }}\n{d}fun shut() = 3\n}}") == ["open", "shut"]
    assert names(f"class A {{\nval x: Int = 3\n{d}fun a() {{}}\nval y by lazy {{ 3 }}\nvar z: Int\n  get() = 3\n  private set(v) {{ field = v }}\n{d}fun b() {{}}\ndata class P(val a: Int)\n{d}fun c() {{}}\n}}") == ["a", "b", "c"]
    assert names(f"interface A {{\n{d}fun a(x: Int): Int\n{d}fun b()\n}}") == ["a", "b"]
    assert names(f"interface A {{\n{d}int a(int x);\n{d}String b() default \"x\";\n}}") == ["a", "b"]
    assert names(f"abstract class A {{\n{d}abstract a(x: string): number;\n{d}b(): void\n}}") == ["a", "b"]
    assert names(f"class A {{\nx = 3\ny: string\n{d}a() {{}}\n{d}get(k: string) {{ return 1 }}\n{d}record(x) {{}}\n}}") == ["a", "get", "record"]


def test_annotations_type_parameters_and_arrows():
    d = f"/** {SAID} */\n"
    assert names(f'class A {{\n{d}@Named(value = "x", of = b("("))\nfun a() {{}}\n}}') == ["a"]
    assert names(f"class A {{\n{d}@Size(min = 1) private int b() {{ return 1; }}\n}}") == ["b"]
    assert names(f"class A {{\n{d}pick<T extends {{ a: string }}>(x: T): {{ b: T }} {{ return 1; }}\n{d}fold<A, B>(f: (a: A) => B): B {{}}\n}}") == ["pick", "fold"]
    assert names(f"{d}fun <T> List<T>.open(): T = first()\n{d}fun String.shut(): Int {{ return 1 }}\n") == ["open", "shut"]
    assert names(f"class A {{\n{d}a = (x) => {{ return x; }}\n{d}private b: (x: number) => number = async (x: number): Promise<number> => x + 1;\n{d}static c = x => x\n}}\n{d}export const f = function (x) {{ return x; }};") == ["a", "b", "c", "f"]
    whole = cd.functions(f"class A {{\n{d}fun a(): Int =\n    list(3)\n        .first()\n{d}fun b() {{}}\n}}")
    assert [f["code"] for f in whole] == ["fun a(): Int =\n    list(3)\n        .first()", "fun b() {}"]
    assert names(f"enum E {{\n{d}RED(1), {d}BLUE(2) {{ }};\n{d}int a() {{ return 1; }}\n}}") == ["a"]


def test_classes_give_their_method_rows(sf):
    import pandas as pd

    rows = pd.read_parquet(f"{sf}/declarations.parquet").drop_duplicates("decl_id").dropna(subset=["full_text"])
    flat = lambda s: " ".join(s.split())
    wanted, seen = 0, set()
    methods = [flat(t[cd.declaration(t)[1] :]) for t in rows[rows.declaration_type == "METHOD"].full_text]
    for text in rows[(rows.declaration_type == "CLASS") & rows.lang.isin(["kotlin", "typescript"])].full_text:
        got, whole = {flat(f["code"]) for f in cd.functions(text)}, flat(text)
        inside = {m for m in methods if m in whole}
        wanted += len(inside)
        seen |= inside - got
    assert wanted and not seen


def test_names_of_a_long_signature_are_excused():
    params = ", ".join(f"int number{i}" for i in range(60))
    assert doc(f"/** The archive, window, ledger and cellar. */\nint readFile({params}, int archive, int window, int ledger, int cellar) {{}}") is None
    assert doc("/** The archive, window, ledger and cellar. */\n@Sizes({1, 2})\nint readFile(int archive, int window, int ledger, int cellar) {}") is None
    assert doc("/** The archive, window, ledger and cellar. */\nint readFile() { int archive, window, ledger, cellar; }")
