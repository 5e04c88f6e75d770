"""Column expressions for outline markup. None of them leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TODO_KEYWORDS = ("TODO", "DONE")
#: A zero-width cut before every heading line; only a line feed ends a line.
SECTION_CUT = r"(?md)(?=^\*+ )"
LINK = r"\[\[([^\[\]\n]+)\](?:\[([^\[\]\n]+)\])?\]"
_PLANNING = r"(?:SCHEDULED|DEADLINE|CLOSED):"


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_line(section: Column) -> Column:
    return F.regexp_extract(section, r"^([^\n]*?)\r?(?:\n|$)", 1)


def planning_line(section: Column) -> Column:
    """The line below the heading if it is a planning line."""
    return F.regexp_extract(section, rf"^[^\n]*\n([ \t]*{_PLANNING}[^\n]*)", 1)


def level(head: Column) -> Column:
    return F.length(F.regexp_extract(head, r"^(\*+) ", 1))


def heading_parts(head: Column, todo_keywords: tuple[str, ...] = TODO_KEYWORDS) -> dict[str, Column]:
    """todo, priority, tags and title of a heading line; the title keeps its cookies."""
    words = "|".join(re.escape(w) for w in todo_keywords) or "(?!)"
    rest = F.regexp_replace(head, r"^\*+[ \t]+", "")
    after_todo = F.regexp_replace(rest, rf"^(?:{words})(?:[ \t]+|$)", "")
    after_priority = F.regexp_replace(after_todo, r"^\[#[A-Za-z0-9]{1,2}\][ \t]*", "")
    tags = r"(?:^|[ \t]+)(:[\p{L}\p{N}_@#%:]+:)[ \t]*$"
    return {
        "todo": _group(rest, rf"^({words})(?=[ \t]|$)"),
        "priority": _group(after_todo, r"^\[#([A-Za-z0-9]{1,2})\]"),
        "tags": F.filter(F.split(F.regexp_extract(after_priority, tags, 1), ":"), lambda x: x != ""),
        "title": F.regexp_replace(F.regexp_replace(after_priority, tags, ""), r"[ \t]+$", ""),
    }


def cookies(title: Column) -> dict[str, Column]:
    number = lambda pattern, group: _group(title, pattern, group).try_cast("int")
    return {"cookie_done": number(r"\[(\d+)/(\d+)\]", 1), "cookie_total": number(r"\[(\d+)/(\d+)\]", 2), "cookie_pct": number(r"\[(\d+)%\]", 1)}


def planned(line: Column, keyword: str) -> Column:
    """Timestamp after a planning keyword; the weekday is ignored, and an impossible date is null."""
    stamp = rf"{keyword}:[ \t]*[<\[](\d{{4}}-\d{{2}}-\d{{2}})(?:[^\d>\]]*(\d{{1,2}}:\d{{2}}))?"
    day, time = _group(line, stamp, 1), F.coalesce(_group(line, stamp, 2), F.lit("00:00"))
    return F.concat_ws(" ", day, F.lpad(time, 5, "0")).try_cast("timestamp_ntz")


def properties(section: Column) -> Column:
    """Key and value pairs, in order, of the drawer right below the heading or its planning line; an unclosed one has none."""
    drawer = rf"^[^\n]*\n(?:[ \t]*{_PLANNING}[^\n]*\n)?[ \t]*:PROPERTIES:[ \t]*\r?(?=\n)((?s:.*?))\n[ \t]*:END:[ \t]*\r?(?:\n|$)"
    body = F.regexp_extract(section, drawer, 1)
    pair = F.lit(r"(?md)^[ \t]*:([^\s:]+):[ \t]*([^\r\n]*?)[ \t]*\r?$")
    return F.arrays_zip(F.regexp_extract_all(body, pair, F.lit(1)).alias("key"), F.regexp_extract_all(body, pair, F.lit(2)).alias("value"))


def link_type(link: Column) -> Column:
    scheme = F.lower(F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(link.startswith("#"), "custom-id").when(scheme != "", scheme).when(link.rlike(r"^(/|\./|\.\./|~)"), "file").otherwise("fuzzy")
