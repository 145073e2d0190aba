import io
import json
import zipfile

import pytest

from chunkwise.functions.tokens import word_count
from chunkwise.sources import code, files, html, office, pdf, rst, tabular, xmldoc


def test_html():
    page = '<html><head><title> T  x</title></head><body><nav>no</nav><h1>Hi <b>you</b></h1><p>a<br>b <a href="u">l</a></p><ol><li>1<li>2</ol><table><tr><th>A</th></tr><tr><td>1</td></tr></table><div class="heading-2">Z</div><blockquote><p>q</p></blockquote><script>no</script></body>'
    md = html.html_to_markdown(page)
    assert "# Hi you" in md and "a\nb l" in md and "1. 1\n2. 2" in md and "| A |\n| --- |\n| 1 |" in md and "## Z" in md and "> q" in md and "no" not in md
    assert html.html_title(page) == "T x" and html.html_to_markdown("") == ""


def test_xml():
    md = xmldoc.xml_to_markdown('<c v="1"><m>meta</m><p id="1"><n>a</n></p><p id="2"><n>b</n></p><e>end</e></c>')
    assert md.split("\n\n")[0] == "## c" and "## c > p" in md and "n: a" in md and md.endswith("e: end")
    assert xmldoc.xml_to_markdown("<a><b></a>") == ""


def test_csv():
    assert tabular.csv_rows('a,b\n"x, ""y""",2\n\n') == [["a", "b"], ['x, "y"', "2"]]
    assert tabular.csv_chunks("a,b", 10, word_count) == []


def test_jsonc():
    got = tabular.jsonc_chunks('// top\n{"a": 1, // tail\n "b": {"c": [1,2],\n /* of */ "d": "x\\n\\\\n"},\n /* list\n * of */ "e": [{"k":1, "o": {"p": [1]}, "n": []},{"k":2}], "f": [], "g": {}}', 50, word_count)
    assert got == [
        "top\n\n##\n\n**a**: 1 - tail", "top\n\n## b -> c -> Items 1-2\n\n1\n\n2", "top\n\n## b\n\nof\n**d**: x\n\\n",
        'top\n\nlist of\n\n## e -> Item 1\n\n**k**: 1\n**o**:\n```json\n{"p": [1]}\n```', "top\n\n## e -> Item 2\n\n**k**: 2",
    ]
    assert tabular.jsonc_chunks("[1, 2, 3]", 100, word_count) == ["## Items 1-3\n\n1\n\n2\n\n3"] and tabular.jsonc_chunks("5", 9, word_count) == [] and tabular.jsonc_chunks("[{}]", 9, word_count) == ["## Item 1\n\n{}"]
    assert tabular.jsonc_chunks('[{"m": [1, {"a": [2]}], "s": [{"a": "x", "b": {"c": 1}}, {"a": 2}]}]', 99, word_count) == ['## Item 1\n\n**m**:\n```json\n[1, {"a": [2]}]\n```\n**s**: a: x, b: {"c": 1}; a: 2']
    small = tabular.jsonc_chunks('{"a": "one two three four five six", "b": "x", "c": "y"}', 6, word_count)
    assert small == ["##\n\n**a**: one two three four five six", "##\n\n**b**: x\n\n**c**: y"]
    with pytest.raises(ValueError):
        tabular.jsonc_chunks('{"a": }', 9, word_count)
    assert tabular.jsonl_objects('{"a":1}\nbad\n\n2') == [{"a": 1}, 2]


def test_rst_asciidoc_rtf():
    md = rst.rst_to_markdown("=====\nTitle\n=====\n\ntext::\n\n    code\n\nSub\n---\n.. note:: x\n")
    assert md.startswith("# Title") and "text:\n```\ncode\n```" in md and "## Sub" in md and "note" not in md
    assert rst.asciidoc_to_markdown("== A\n----\nx = 1\n----") == "## A\n```\nx = 1\n```"
    assert rst.rtf_to_text(r"{\rtf1{\fonttbl{\f0 A;}}\f0 Hi \b you\b0\par caf\'e9 \{x\}}") == "Hi you\ncafé {x}"


KOTLIN = """package a.b
import x.y

/** Doc. */
class Foo(val a: Int) : Bar() {
    val t = f(3) { it }
    constructor(b: String) : this(1)
    /* note } */
    @Ann("{") fun run(a: Int): Int = a + 1
    class Inner { fun deep() { } }
}

fun <T> top(x: T): T { return x }
"""


def test_code():
    got = code.declarations(KOTLIN, "kotlin")
    assert [(d.type, d.name, d.class_name) for d in got] == [("CLASS", "Foo", None), ("CONSTRUCTOR", "Foo", "Foo"), ("METHOD", "run", "Foo"), ("CLASS", "Foo.Inner", "Foo"), ("METHOD", "deep", "Foo.Inner"), ("FUNCTION", "top", None)]
    assert got[1].full_text == "constructor(b: String) : this(1)" and got[2].full_text.startswith("/* note } */") and "class Inner { /* ... */ }" in got[0].full_text
    assert got[0].package == "a.b" and got[0].imports == ["import x.y"]
    java = code.declarations('public class A { /** c */ A(int y) { x = "}"; }\n // l\n @Override public String s() { return ""; }\n abstract void g();\n}', "java")
    assert [(d.type, d.name) for d in java] == [("CLASS", "A"), ("CONSTRUCTOR", "A"), ("METHOD", "s"), ("METHOD", "g")]
    ts = code.declarations("export interface I { m(a: string): void; }\nexport function f(a) { return a; }\nconst g = () => 3;", "typescript")
    assert [(d.type, d.name) for d in ts] == [("CLASS", "I"), ("METHOD", "m"), ("FUNCTION", "f")]
    assert code.declarations("", "java") == [] and all(len(c["chunk"]) > 0 for c in code.code_chunks(KOTLIN, "kotlin", 20))


def pack(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_office():
    doc = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert office.docx_to_markdown(pack(**{"word/document.xml": doc})) == "## Head\n\nBody\n\n| a |\n| --- |\n| 1 |"
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="A2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'
    book = pack(**{"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>h</t></si></sst>"})
    assert office.xlsx_sheets(book) == [("S", [["h", "", "2"], ["x"]])] and office.xlsx_chunks(book, 99, word_count)[0].startswith("## S\n| h |")
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>Point</a:t></a:r></a:p></p:sp></p:sld>'
    assert office.pptx_to_markdown(pack(**{"ppt/slides/slide1.xml": slide})) == "## Slide 1: Title\n\nPoint"
    assert office.is_encrypted(office.COMPOUND + b"x")


def test_pdf():
    e = lambda p, x, y, t, s=10.0, f="Serif": pdf.Element(p, x, y, x + 5 * len(t), s, f, t)
    els = [e(1, 72, 60, "The Title", 20.0), e(1, 72, 100, "A line that is infor-"), e(1, 72, 112, "mation for all."), e(1, 72, 140, "• one"), e(1, 72, 152, "• two"), e(1, 72, 180, "x = 1", 10.0, "Mono")]
    els += [e(1, 72, 220, "a"), e(1, 200, 220, "b"), e(1, 72, 232, "1"), e(1, 200, 232, "2")] + [e(p, 72, 30, "Head") for p in (1, 2)] + [e(p, 300, 800, str(p)) for p in (1, 2)] + [e(2, 72, 100, "Second page text is here.")]
    assert pdf.pages_to_markdown(els).split("\n\n") == ["# The Title", "A line that is information for all.", "- one\n- two", "```\nx = 1\n```", "| a | b |\n| --- | --- |\n| 1 | 2 |", "Second page text is here."]
    assert pdf.pages_to_markdown([]) == ""


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.md": b"# H\ntext", "sub/b.json": b"{bad", "c.bin": b"abcd\x00efgh", "d.csv": b"a,b\n1,2", "e.txt": b"\n", "f.docx": office.COMPOUND}.items():
        (tmp_path / name).write_bytes(data)
    df = files.scan(spark, [str(tmp_path)])
    got = {r["source"].rsplit("/", 1)[1]: (r["status"], r["content"]) for r in files.read_files(df, 50, "words").collect()}
    assert got["a.md"] == ("ok", "# H\ntext") and got["c.bin"][0] == "binary" and got["d.csv"][1].endswith("| 1 | 2 |") and got["e.txt"][0] == "empty"
    assert got["b.json"][0].startswith("error") and "encrypted" in got["f.docx"][0]
    again = {r["source"].rsplit("/", 1)[1]: r["content"] for r in files.read_files(df, 50, "words", strip_binary=True).collect()}
    assert again["c.bin"] == "abcd efgh"
    assert files.expand([str(tmp_path), "https://x.example", "/no/such"]) == ([str(tmp_path)], ["https://x.example"], ["/no/such"])


def test_fetch(spark):
    urls = spark.createDataFrame([("http://a",)], "source string")
    row = files.fetch(urls, lambda u: (b"x", "text/html", "Wed, 01 Jan 2025 00:00:00 GMT", 200)).first()
    assert row["mtime"] == 1735689600000 and json.loads("1") == 1 and bytes(row["content"]) == b"x"
