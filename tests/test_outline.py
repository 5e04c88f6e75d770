import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from outlinelake.functions.lines import search, to_lines
from outlinelake.operators.headings import parse_headings
from outlinelake.operators.links import parse_links, with_heading
from outlinelake.plans import queries as Q

SNIPPET = """#+STARTUP: content
* TODO [#A] Top [1/3]  :work:urgent:
SCHEDULED: <2022-05-01 Sun> DEADLINE: <2022-06-01 Wed>
:PROPERTIES:
:CUSTOM_ID: top
:END:
see [[https://a.org/x][Aé b]] and [[#top][t]] tail
*** Deep
** Mid :x:
**** Deeper
* Second
[[./f.org]]
"""


def files(spark, **texts):
    return spark.createDataFrame([(f"{k}.org", v) for k, v in texts.items()], "file string, value string")


def headings(spark, text):
    return parse_headings(files(spark, a=text)).orderBy("line_number").collect()


def test_lines_levels_and_parents(spark):
    rows = headings(spark, SNIPPET)
    line = {r["heading_id"]: r["line_number"] for r in rows}
    assert [(r["line_number"], r["level"], line.get(r["parent_id"])) for r in rows] == [(2, 1, None), (8, 3, 2), (9, 2, 2), (10, 4, 9), (11, 1, None)]
    assert [[line[a] for a in r["ancestor_ids"]] for r in rows] == [[], [2], [2], [2, 9], []]
    assert all(SNIPPET[r["position"] - 1] == "*" for r in rows)


def test_heading_fields(spark):
    top = headings(spark, SNIPPET)[0]
    assert (top["todo"], top["priority"], top["title"], top["tags"]) == ("TODO", "A", "Top [1/3]", ["work", "urgent"])
    assert (top["cookie_done"], top["cookie_total"], top["cookie_pct"]) == (1, 3, None)
    assert (top["scheduled"], top["deadline"], top["closed"]) == (datetime(2022, 5, 1), datetime(2022, 6, 1), None)
    assert [tuple(p) for p in top["properties"]] == [("CUSTOM_ID", "top")]


def test_link_positions_and_fields(spark):
    rows = parse_links(files(spark, a=SNIPPET)).orderBy("position").collect()
    assert [(r["full_link"], r["position"], r["type"], r["link"], r["description"]) for r in rows] == [
        ("[[https://a.org/x][Aé b]]", 151, "https", "https://a.org/x", "Aé b"),
        ("[[#top][t]]", 181, "custom-id", "#top", "t"),
        ("[[./f.org]]", 239, "file", "./f.org", None),
    ]
    held = with_heading(parse_links(files(spark, a=SNIPPET)), parse_headings(files(spark, a=SNIPPET))).orderBy("position").collect()
    line = {r["heading_id"]: r["line_number"] for r in headings(spark, SNIPPET)}
    assert [line[r["heading_id"]] for r in held] == [2, 2, 11]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("* a :b", ("a :b", None, None, [])),
        ("* TODO", ("", "TODO", None, [])),
        ("* TODOS x", ("TODOS x", None, None, [])),
        ("* [#B] p", ("p", None, "B", [])),
        ("* DONE x [50%] :t_1:@b:", ("x [50%]", "DONE", None, ["t_1", "@b"])),
        ("* last", ("last", None, None, [])),
    ],
)
def test_heading_line(spark, text, want):
    (row,) = headings(spark, text)
    assert (row["title"], row["todo"], row["priority"], row["tags"]) == want


def test_percent_cookie_time_and_bad_date(spark):
    (row,) = headings(spark, "* x [50%]\nSCHEDULED: <2022-02-30 Wed> CLOSED: [2022-03-01 Tue 9:05]\n")
    assert (row["cookie_pct"], row["scheduled"], row["closed"]) == (50, None, datetime(2022, 3, 1, 9, 5))


def test_planning_only_right_below(spark):
    (row,) = headings(spark, "* x\ntext\nSCHEDULED: <2022-02-01>\n")
    assert row["scheduled"] is None


def test_drawers(spark):
    text = "* a\n:PROPERTIES:\n:K: 1\n:K: 2\n:E:\n:END:\n:NOT: prop\n* b\n:PROPERTIES:\n:K: 3\n* c\n:PROPERTIES:\n:END:\n* d\ntext\n:PROPERTIES:\n:K: 4\n:END:\n"
    assert [[tuple(p) for p in r["properties"]] for r in headings(spark, text)] == [[("K", "1"), ("K", "2"), ("E", "")], [], [], []]


def test_carriage_returns(spark):
    rows = headings(spark, "intro\r\n* TODO a :t:\r\nSCHEDULED: <2022-01-02>\r\n:PROPERTIES:\r\n:K: v\r\n:END:\r\n** b\r\n")
    assert [(r["line_number"], r["title"], r["tags"]) for r in rows] == [(2, "a", ["t"]), (7, "b", [])]
    assert [tuple(p) for p in rows[0]["properties"]] == [("K", "v")]
    assert [r["line"] for r in to_lines(files(spark, a="x\r\ny\r\n")).orderBy("line_number").collect()] == ["x", "y"]


def test_what_is_no_heading_or_link(spark):
    assert headings(spark, "*bold* word\n a * b\n#+TITLE: x\n") == []
    assert parse_links(files(spark, a="[t](http://x) [[]] [x]", b="", c="[[a\nb]]")).count() == 0


def test_empty_null_and_no_files(spark):
    df = spark.createDataFrame([("a", None), ("b", "")], "file string, value string")
    assert parse_headings(df).count() == parse_links(df).count() == parse_headings(df.limit(0)).count() == 0


def test_same_name_in_two_directories(spark):
    df = spark.createDataFrame([("x/a.org", "* one"), ("y/a.org", "** two")], "file string, value string")
    rows = parse_headings(df).collect()
    assert len({r["heading_id"] for r in rows}) == 2 and all(r["parent_id"] is None for r in rows)


@pytest.mark.parametrize("shallow", [1, 2, 4, 12])
def test_parents_match_a_stack(spark, shallow):
    rng = random.Random(shallow)
    levels = [3, 1, 2, 5, 4, 2, 2, 1, 3, 2, 6, 1, *(rng.choice((1, 2, 3, 5, 9, 14, 20, 40)) for _ in range(150)), *range(30, 60), 2, *range(50, 20, -1)]
    df = files(spark, a="\n".join("*" * n + f" h{i}" for i, n in enumerate(levels)))
    rows = parse_headings(df, shallow=shallow).orderBy("line_number").collect()
    line, stack = {r["heading_id"]: r["line_number"] for r in rows}, []
    for i, (n, r) in enumerate(zip(levels, rows, strict=True)):
        while stack and stack[-1][0] >= n:
            stack.pop()
        assert [line[a] for a in r["ancestor_ids"]] == [s[1] for s in stack]
        assert line.get(r["parent_id"]) == (stack[-1][1] if stack else None)
        stack.append((n, i + 1))


def test_with_heading_keeps_columns_of_any_name(spark):
    links = parse_links(files(spark, a=SNIPPET)).withColumns({"_link": F.lit("x"), "heading_id": F.lit("y"), "row": F.lit("z")})
    rows = with_heading(links, parse_headings(files(spark, a=SNIPPET))).collect()
    assert {(r["_link"], r["row"]) for r in rows} == {("x", "z")} and all(isinstance(r["heading_id"], int) for r in rows)


def test_search(spark):
    rows = search(files(spark, a="x\nfoo 1\n", b="foo 2"), r"^foo \d").orderBy("file").collect()
    assert [(r["file"], r["line_number"]) for r in rows] == [("a.org", 2), ("b.org", 1)]


def test_queries_on_snippet(spark):
    found = parse_headings(files(spark, a=SNIPPET))
    assert {r["tag"]: r["n"] for r in Q.tag_counts(found).collect()} == {"work": 1, "urgent": 1, "x": 1}
    assert [(r["title"], r["days_late"]) for r in Q.overdue(found, "2022-06-03").collect()] == [("Top [1/3]", 2)]
    assert [r["title"] for r in Q.agenda(found, "2022-05-01", "2022-05-01").collect()] == ["Top [1/3]"]
    assert {r["title"]: r["n_below"] for r in Q.subtree_rollup(found).collect()} == {"Top [1/3]": 3, "Deep": 0, "Mid": 1, "Deeper": 0, "Second": 0}
    assert Q.inherited_tags(found).where("tag = 'work'").count() == 4
    assert [r["title"] for r in Q.backlinks(parse_links(files(spark, a=SNIPPET)), found).collect()] == ["Top [1/3]"]
