"""Table functions for SQL: links, messages and items of a text, called laterally; and a query's predicate as a function.

``register(spark)`` makes them known to a session. They give what the functions of columns give; rows go by Arrow.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..plans.query import analyse
from . import html, links
from . import text as T

LINK = "pos int, url string, pan_type string, pwd string"


@udtf(returnType=LINK, useArrow=True)
class ShareLinks:
    """share_links(text): the share links of a text with their codes."""

    def eval(self, text: str):
        for r in links.find(text):
            yield r["pos"], r["url"], r["pan_type"], r["pwd"]


@udtf(returnType=LINK, useArrow=True)
class PastedLinks:
    """pasted_links(text): the same; where there are none, the text itself if it is a lone link."""

    def eval(self, text: str):
        for r in links.find_or_single(text):
            yield r["pos"], r["url"], r["pan_type"], r["pwd"]


@udtf(returnType=LINK, useArrow=True)
class PastedRows:
    """pasted_rows(text): the same, and one row without a link for a text that has none but isn't blank: a reject."""

    def eval(self, text: str):
        found = links.find_or_single(text)
        for r in found:
            yield r["pos"], r["url"], r["pan_type"], r["pwd"]
        if not found and (text or "").strip():
            yield None, None, None, None


@udtf(returnType="msg_id long, posted_at string, text string, links int, first_url string", useArrow=True)
class PageMessages:
    """page_messages(html, channel): the messages of a channel's page."""

    def eval(self, page: str, channel: str):
        from ..sources.captured import parse_messages

        for m in parse_messages(page, channel):
            yield m["msg_id"], m["posted_at"], m["text"], len(m["links"]), m["links"][0]["url"] if m["links"] else None


@udtf(returnType="place int, template string", useArrow=True)
class SearchForms:
    """search_forms(html, base): URL templates of a page's search forms."""

    def eval(self, page: str, base: str):
        yield from enumerate(html.find_search_forms(page, base or ""))


FUNCTIONS = {"share_links": ShareLinks, "pasted_links": PastedLinks, "pasted_rows": PastedRows, "page_messages": PageMessages, "search_forms": SearchForms}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)


def _literal(text: str) -> str:
    """A string of Spark's SQL, backslashes and quotes as they are."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_match(spark: SparkSession, name: str, query: str) -> None:
    """A SQL function name(title): whether a title has all that a query requires. It stays in the JVM: terms become regexes
    when it is registered, and titles are folded as far as case goes."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"no name of a function: {name}")
    asked = analyse(query)
    tests = [f"lower(title) RLIKE {_literal(T.term_regex(t))}" for t in asked.required or asked.terms]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(title STRING) RETURNS BOOLEAN RETURN coalesce({' AND '.join(tests) or 'true'}, false)")
