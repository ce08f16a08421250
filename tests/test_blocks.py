"""Markdown and JSON as plans against the parsers that read one document at a time."""

import json
import random

import pytest

from heronry.operators import blocks as bk
from heronry.sources import parsers

LINES = ["", "", "# A", "## B", "## C d", "### E", "# ", "#x", "text one", "more of it here", "- item", "* other", "3. third", "| a | b |", "```", "~~~py", "<!-- note", "  indented", "\tTab", "#### deep # mark", "word " * 30, "é 中文"]


def documents(n, seed):
    r = random.Random(seed)
    docs = ["\n".join(r.choice(LINES) for _ in range(r.randrange(40))) for _ in range(n)]
    return [*docs, "", "\n\n", "no heading\n\nat all", "# A\n\n## B\n\nshort\n\n### C\n\nshort\n\n#### D\n\nshort\n\n## E\n\nx", "```\n# code\n\n| a |"]


def as_rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_markdown_blocks_and_sections(spark, seed):
    docs = [d for d in documents(120, seed)]
    df = spark.createDataFrame([(f"p{i}", d, "n") for i, d in enumerate(docs)] + [("null", None, "n")], "path string, content string, kind string").repartition(3)
    columns = ("path", "position", "parent", "kind", "start_line", "end_line", "content")
    assert as_rows(bk.markdown_blocks(df), *columns) == sorted((f"p{i}", *r) for i, d in enumerate(docs) for r in parsers.markdown(d))
    for least, most in ((64, 1024), (5, 40), (3, 3)):
        assert as_rows(bk.markdown_sections(df, least, most), *columns) == sorted((f"p{i}", *r) for i, d in enumerate(docs) for r in parsers.sections(d, least, most))
    assert bk.markdown_blocks(df.limit(0)).collect() == bk.markdown_sections(df.limit(0)).collect() == []


def test_headings_beyond_the_last_level(spark):
    df = spark.createDataFrame([("p", "# A\n############ B\n########## C\n\nx")], "path string, content string")
    assert [r["position"] for r in bk.markdown_blocks(df).orderBy("start_line").collect()] == ["# A", "# A > ############ B", "# A > ########## C", "# A > ########## C"]


def test_json_leaves(spark):
    r = random.Random(5)

    def value(depth):
        kind = r.random()
        if depth and kind < 0.4:
            return {r.choice("abcde") + str(i): value(depth - 1) for i in range(r.randrange(4))}
        if depth and kind < 0.6:
            return [value(depth - 1) for _ in range(r.randrange(4))]
        return r.choice([1, -7, 2.5, True, False, None, "x", "", '{"a": 1}', "é 中", 10**17])

    docs = [json.dumps(value(4), ensure_ascii=False) for _ in range(80)] + ["{}", "[]", "3", '"s"', "null"]
    df = spark.createDataFrame([(f"p{i}", d) for i, d in enumerate(docs)] + [("bad", "{nope"), ("null", None), ("deep", "[" * 80 + "]" * 80)], "path string, content string")
    got = as_rows(bk.json_leaves(df).where("path not in ('bad', 'deep')"), "path", "position", "parent", "kind", "content")
    assert got == sorted((f"p{i}", p, u, k, c) for i, d in enumerate(docs) for p, u, k, _, _, c in parsers.key_paths(d))
    assert {(x["path"], x["kind"]) for x in bk.json_leaves(df).where("path in ('bad', 'deep')").collect()} == {("bad", "error"), ("deep", "section"), ("deep", "error")}


def test_references_of_html_end_with_a_semicolon():
    """What isn't ended, or is no known name, stands as it is; the others are decoded once."""
    html = "<h1>a &amp b &amp</h1><p>&amp; &lt;i&gt; &eacute; &#39;&#x41; &#39 &#x41 &amp;lt; &none; &notit; & && &copy</p><script>if (a && b) {}</script>"
    assert [r[5] for r in parsers.html_blocks(html)] == ["a &amp b &amp", "& <i> é 'A &#39 &#x41 &lt; &none; &notit; & && &copy"]
