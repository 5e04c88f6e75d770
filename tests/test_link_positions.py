import time

import pytest

from outlinelake.operators.links import parse_links, standing


@pytest.mark.parametrize("piece", [1, 3, 7, 1024])
def test_links_stand_where_the_text_has_them(spark, piece):
    text = "é𝄞 [[#a][b c]]\n" + "x" * 20 + "[[./long/𝄞/link][of several pieces]] end [[z]]"
    files = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "file string, value string")
    found = [(r["file"], r["position"], r["full_link"]) for r in parse_links(files).collect()]
    assert len(found) == 3
    wrong = [("a", 0, "[[z]]"), ("a", -5, "[[z]]"), ("a", len(text) - 3, "[[z]]"), ("a", len(text) + 2000, "[[z]]"), ("a", 5, "[[#a]["), ("a", 4, "[[#a][b d]]"), ("a", None, "[[z]]"), ("a", 4, None), ("b", 1, "[[z]]"), ("c", 1, "[[z]]"), ("d", 1, "[[z]]")]
    rows = spark.createDataFrame([*found, *found[:1], *wrong, *wrong[:1]], "file string, position int, full_link string")
    got = {(r["file"], r["position"], r["full_link"]): (r["n"], r["right"]) for r in standing(rows, files, piece).collect()}
    assert got == {x: (1 + (x in (found[0], wrong[0])), x in found) for x in [*found, *wrong]}


def test_link_positions_of_one_large_file(spark, monkeypatch):
    """60,000 links in 3 MB of text: when each was looked for from the text's beginning, this took many minutes."""
    from outlinelake.plans import registry

    text = spark.range(1).selectExpr("'a' as file", "repeat('é for [[#customer][Customer of some name]] and more\n', 60000) as value")
    links = parse_links(text).cache()
    assert links.count() == 60000
    monkeypatch.setattr(registry, "_database", lambda *_: {"text": text, "links": links})
    began = time.time()
    assert [tuple(r) for r in registry.link_positions(spark, "").collect()] == [("a", 60000, 60000)]
    assert time.time() - began < 30
