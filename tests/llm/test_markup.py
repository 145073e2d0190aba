import random
import re

from conftest import clash

from chunkwise.llm import markup as mk

S = "chunk_id string, source string, content string, heading_title string"

RESIDUE = ["<b>x</b>", "a<br/>b", "x &amp; y", "<!-- n -->x", "&#9;", "[[Page|label]]", "{{cite|a|b=1}}", "'''bold'''", "''it''", "== Head ==", "{|\n|-\n| a\n|}", "x<ref>y</ref>", "[https://a.example b c]",
           "\\section{A}", "\\begin{itemize}\n\\item x\n\\end{itemize}", "``quoted text''", "rose \\ldots more", "[a](https://b.example)", "![alt](img/x.png)", "**strong**", "the *weak* one", "__two words__", "~~gone~~", "[a][b]", "[a]: https://x.example", "Head\n=====", "***both***"]
PLAIN = ["# Head\ntext", "- a\n- b\n1. c", "| a | b |\n| --- | --- |\n| 1 | 2 |", "```\n<b>**x**</b>\n```", "use `<b>` and `**`", "$\\frac{a}{b}$ and $x_1$", "a < b and c > d", "Map<String, List<Int>>", "--out <store-dir> --in <source-file>", "Q&A on R&D; C# & F#", "see [1] and [A2]",
         "C:\\temp\\new\\Table", "3 * 4 * 5; y = a*b*c", "snake_case_name and __init__", "it's 5' by 6''", "path {name} here", "src/**/*.kt", "costs $5 and $6", "a[i](x)", "~5 and ~6", "", " "]


def kinds(text):
    return {t.kind for t in mk.stream(text)} - {"text", "keep"}


def test_residue_and_plain_text():
    assert [x for x in RESIDUE if not kinds(x)] == []
    assert [x for x in PLAIN if kinds(x)] == []


def test_streams_cover_the_text():
    for x in RESIDUE + PLAIN:
        t = mk.stream(x)
        assert [(a.end == b.start) for a, b in zip(t, t[1:])] == [True] * max(0, len(t) - 1) and (not x or (t[0].start == 0 and t[-1].end == len(x)))


def test_clean_text_keeps_structure():
    assert mk.clean("<h2>Head</h2><ul><li>a</li><li>b <b>c</b></li></ul><pre>x = 1</pre>").split("\n") == ["## Head", "", "- a", "- b c", "", "```", "x = 1", "```"]
    assert mk.clean("\\section{A \\textbf{b}} text~ \\texttt{run}") == "# A b\n\n text~ `run`"
    assert mk.clean("== H ==\n[[P|l]] '''b''' {{c|d}} $x^2$ `<b>`") == "## H\nl b d $x^2$ `<b>`"
    assert mk.clean("**a** [b](https://c.example) ~~d~~\n\nT\n---\nx") == "a b d\n\n## T\nx"
    assert mk.clean("a &lt; b") == "a < b" and mk.clean("plain") == "plain"


def test_wrappers():
    w = mk.infer([["T", "<p>", "T", "</p>"], ["T", "<p>", "T", "</p>", "<p>", "T", "</p>", "<p>", "T", "</p>"], ["T", "<hr>", "<p>", "T", "</p>"]])
    said = mk.expression(w)
    assert "<hr>?" in said and "+" in said or "*" in said
    assert mk.expression(mk.infer([["T", "<li>", "<li>", "<li>", "T"]])) == "T <li>+ T" and mk.infer([]) == []


def test_rows(spark):
    rows = [("a", "https://h.example/x", "<p>x</p>", None), ("a", "https://h.example/x", "<p>x</p>", None), ("b", None, "plain", "**T**"), ("c", "/srv/a/f", None, None), ("d", "/srv/a/f", "", ""), (None, "s", "<b>x</b>", None), ("e", "/srv/a/f", "x " * 300000 + "&amp;", None)]
    df = clash(spark.createDataFrame(rows, S), "kinds", "shapes", "text", "title", "host")
    assert sorted(r["chunk_id"] for r in mk.residue(df).collect()) == ["a", "b", "e"]
    assert {r["chunk_id"]: r["title"] for r in mk.cleaned(df).collect()}["b"] == "T"
    assert mk.wrappers(df).count() == 3
    empty = spark.createDataFrame([], S)
    assert mk.residue(empty).count() == mk.cleaned(empty).count() == mk.wrappers(empty).count() == 0


def pattern(wrapper, letters):
    """The wrapper as a regular expression over one letter for each shape."""
    def item(x):
        y, rep, opt = x
        return ("(?:" + "".join(map(item, y)) + ")" if isinstance(y, tuple) else letters[y]) + ("*" if rep and opt else "+" if rep else "?" if opt else "")

    return re.compile("".join(map(item, wrapper)))


def test_wrapper_matches_every_stream_in_full_length():
    rnd = random.Random(3)
    shapes = [f"<{c}>" for c in "abcdefgh"]
    letters = dict(zip(shapes, "abcdefgh"))
    streams = [[rnd.choice(shapes) for _ in range(rnd.choice((3, 9, 30)))] for _ in range(12)] + [[rnd.choice(shapes) for _ in range(900)]]
    halves = mk.fold([mk.infer(streams[:5]), mk.infer(streams[5:])])
    for w in (mk.infer(streams), halves):
        assert [s for s in streams if not pattern(w, letters).fullmatch("".join(letters[x] for x in s))] == []
    a, b = [rnd.choice("abc") for _ in range(60)], [rnd.choice("abc") for _ in range(70)]
    whole, cut = mk.matches(a, b), mk.matches(a, b, 40)
    assert len(whole) == len(cut) and all(a[i] == b[j] for i, j in whole + cut) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(cut, cut[1:]))


def test_wrappers_cover_all_streams_of_a_host(spark):
    tags = sorted(t for t in mk.TAGS if t not in mk.DROPPED)[:100]
    rows = [(str(i), "/srv/a/f", f"x<{t}>y</{t}>", None) for i, t in enumerate(tags)]
    rnd = random.Random(5)
    rows.append(("long", "/srv/a/f", "".join(f"<{rnd.choice(tags[:40])}>" for _ in range(900)) + "<wbr>", None))
    rows.append(("twice", "/srv/a/f", "x<b>y</b>", None))
    (got,) = mk.wrappers(spark.createDataFrame(rows, S)).collect()
    assert (got["host"], got["streams"], got["chunks"]) == ("/srv/a", 101, 102)
    assert [t for t in (*tags, "wbr") if f"<{t}>" not in got["wrapper"]] == []


def test_middle_of_a_wiki_table_is_examined(spark):
    rows = [("a", "/srv/a/f", "|-\n| a || b", None), ("b", "/srv/a/f", "x | y\n|}", None), ("c", "/srv/a/f", None, "|+ caption"), ("d", "/srv/a/f", "| a | b |\n| c |- d |", None)]
    df = spark.createDataFrame(rows, S)
    assert sorted(r["chunk_id"] for r in mk.residue(df).collect()) == sorted(r["chunk_id"] for r in mk.cleaned(df).collect()) == ["a", "b", "c"]
    assert [r["chunks"] for r in mk.wrappers(df).collect()] == [3]
