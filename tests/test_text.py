"""Text functions on single values, as facts."""

import pytest
from lexiflow.functions import ids, markdown, text
from lexiflow.functions.typography import reader_typography, restore_numeric_links
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def of(spark):
    def evaluate(f, *values):
        row = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
        return row.select(f(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first()["x"]

    return evaluate


def test_signatures(of):
    sign = lambda s: of(text.format_signature, s)
    assert sign("Turn to [the map](plates/map.html).") == ["link"]
    assert sign("**a** *b* `c` [^1]") == ["code", "emphasis", "footnote_ref", "strong"]
    assert sign("![alt](x.png)") == ["image", "link"] and sign("![](x.png)") == ["image"]
    assert sign("- a\n- b") == ["unordered_list"] and sign("> 1. q") == ["blockquote"] and sign("2) x") == ["ordered_list"]
    assert sign("") == []


def test_numbers_and_acronyms(of):
    assert of(text.numbers, "In 1791, close to 90 percent") == ["1791", "90"]
    assert of(text.numbers, "1791年，接近90%") == ["1791", "90"]
    assert of(text.acronyms, "NOBODY WHO SHOUTS IS HEARD FOR LONG IN THIS TOWN") == []
    assert of(text.acronyms, "A banner said LEAVE OUR TREES ALONE, and NASA agreed.") == ["NASA"]
    assert of(text.acronyms, "Henry VIII met Richard II") == []


def test_terms(of):
    has = lambda t, term: of(text.contains_term, t, term)
    assert has("A US firm", "US") and not has("let us proceed", "US") and not has("purposes", "us")
    assert has("The Power of", "power") and not has("empowered", "power") and has("数位科技改变", "科技")


def test_white_space_and_visible_text(of):
    assert of(text.normalize, " a 　b\x1c\x85c\t") == "a b c"
    assert of(text.plain_text, "> **Bold** [link](x) ![alt](y) `code` snake_case") == "Bold link alt code snakecase"
    assert of(text.plain_text, "## Head *it*") == "Head it"
    assert of(text.txt_to_markdown, "Chapter 1\ntext\nPart Two") == "# Chapter 1\ntext\n# Part Two"


def test_truncate_never_cuts_a_word(of):
    long = "A complete sentence. " + "word " * 300
    found = of(lambda c: text.truncate(c, 120), long)
    assert found.startswith("A complete sentence.") and found.endswith("word") and len(found) <= 120
    assert of(lambda c: text.truncate(c, 30), "First one here. Second goes on") == "First one here. Second goes on"
    assert of(lambda c: text.truncate(c, 24), "First one here. Second goes on") == "First one here."
    assert of(lambda c: text.truncate(c, 26), "It rose by some 3.14 percent in May") == "It rose by some 3.14"


def test_chapter_keys(of):
    for title, key in (("１ 對科技的掌控", "chapter-1"), ("Chapter 12 End", "chapter-12"), ("Prologue", "chapter-0"), ("序言", "chapter-0"), ("7 Days", "chapter-7"), ("Notes", None), ("1984 revisited", None), ("The Prologue", "chapter-0"), ("Chapter1", "chapter-1"), ("Ｃｈａｐｔｅｒ　９", "chapter-9"), ("序章", None)):
        assert of(text.chapter_key, title) == key


def test_subheadings(of):
    is_sub = lambda s: of(lambda c: text.is_setoff_subheading(c, c), s)
    assert is_sub("Illegible") and is_sub("Unions and trade associations")
    assert not any(map(is_sub, ["This is prose.", "ISBN 123", "• item", "1. First", "two\nlines", "all lower words", ""]))


def test_latin_tokens(of):
    font = lambda x: f'<font name="latin">{x}</font>'
    assert of(text.latin_markup, "用 Spark 4 做") == f"用 <nobr>{font('Spark')}</nobr> <nobr>{font('4')}</nobr> 做"
    assert of(text.latin_markup, "见 a&b 与 R&D<x>") == f"见 {font('a&amp;b')} 与 {font('R&amp;D')}&lt;<nobr>{font('x')}</nobr>&gt;"
    assert of(text.latin_markup, "x" * 41) == font("x" * 41) and of(text.latin_markup, "& <") == "&amp; &lt;"


def test_links_tables_and_names(of):
    assert of(text.table_rows, "| a | b |\n| --- | :-: |\n| 1 | 2 |") == [["a", "b"], ["1", "2"]]
    assert of(text.resource_name, "../OEBPS/./a%20b\\c.png") == "OEBPS/a b/c.png"
    assert of(text.is_local_reference, "a.html#x") and not of(text.is_local_reference, "https://x") and not of(text.is_local_reference, "//x")
    assert "<nobr>" in of(text.latin_markup, "用 Spark 做") and "<nobr>" not in of(text.latin_markup, "见 https://a.b/c 处")


def test_identities(of):
    import hashlib

    assert of(lambda a, b: ids.stable_id("seg", a, b), "x", None) == "seg_" + hashlib.sha256(b"x\x1fNone").hexdigest()[:16]
    for items in (["a", "it's"], ['q"', "b'\""], ["back\\slash"], []):
        got = of(lambda c: ids.python_list(F.array(*map(F.lit, items)).cast("array<string>")), "x")
        assert got == repr(items)
    assert of(lambda c: ids.sorted_json(c), '{"b":1,"a":["ü"]}') == '{"a": ["ü"], "b": 1}'


def test_typography():
    for before, after in (
        ("她说：‘你好。’", "她说：“你好。”"), ("她说：“所谓‘进步’，并不简单。”", "她说：“所谓‘进步’，并不简单。”"), ("所谓「好」的技术", "所谓“好”的技术"),
        ("她说：「所谓『进步』，并不简单。」", "她说：“所谓‘进步’，并不简单。”"), ("O”Reilly and Economists” Hour", "O'Reilly and Economists' Hour"),
        ("O’Reilly and Economists’ Hour", "O'Reilly and Economists' Hour"), ("她说：“中文”之后仍是中文。", "她说：“中文”之后仍是中文。"), ("`「x」` 「y」", "`「x」` “y”"),
    ):
        assert reader_typography(before) == after
    for before, after in (("d’été", "d'été"), ("Marx’ theory", "Marx' theory"), ("O”Reilly 「中」", "O'Reilly “中”"), ("‘甲’「乙‘丙’」", "“甲”“乙‘丙’”")):
        assert reader_typography(before) == after
    # links come back only where all numbers are there, in order
    assert restore_numeric_links("a [1](x) [2](y)", "甲[1]乙[2]丙[3]") == "甲[1](x)乙[2](y)丙[3]"
    assert restore_numeric_links("a [1](x)", "甲 乙") == "甲 乙" and restore_numeric_links("a [1](x) [2](y)", "[2] [1]") == "[2] [1]"
    assert restore_numeric_links("See [3](#n3).", "见[3]。") == "见[3](#n3)。"


def kinds(source):
    return [b[0] for b in markdown.parse_blocks(source)]


def test_blocks():
    source = "Intro\n\n# H\n\n- a\n  - b\n\n- c\n\n> q\nlazy\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\n# no\n```\n\n[^1]: note\n\n<div>\nx\n</div>\n\n***\n\nTitle\n=====\n\n    code\n"
    found = markdown.parse_blocks(source)
    assert [b[0] for b in found] == ["paragraph", "heading", "list", "blockquote", "table", "code", "footnote", "html", "thematic_break", "heading", "code"]
    assert found[2][1] == "- a\n  - b\n\n- c" and found[2][3] == "lines:5-8" and found[9][2] == 1
    assert kinds("a\nb\n# h\n1. x\n\n   more\n2. y\n\nend") == ["paragraph", "heading", "list", "paragraph"]
    assert kinds("") == [] and kinds("```\nopen") == ["code"]


def test_block_descriptions(spark):
    row = spark.createDataFrame([("## A *b* ##\n\nRadio Days\n\nISBN 12\n",)], "m string")
    rows = row.select(F.explode(markdown.blocks(F.col("m"))).alias("b")).select(*markdown.described(F.col("b"))).collect()
    assert [(r.kind, r.text, r.level) for r in rows] == [("heading", "A b", 2), ("subheading", "Radio Days", 0), ("paragraph", "ISBN 12", 0)]
