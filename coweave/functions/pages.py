"""Text of HTML pages and of the lines in it."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements whose content is no text, and elements whose end ends a line.
NO_TEXT = ("script", "style", "noscript")
LINE_ENDS = ("p", "div", "li", "tr", "td", "th", "h\\d", "dd", "dt")
BLANKS = "[ \\t\\u3000\\u00a0]+"

#: A page is a row of these: an element without text, a tag, text up to the next tag, or a lone bracket.
_TOKEN = f"(?is)<({'|'.join(NO_TEXT)})[^>]*>.*?</\\1>|<[^>]+>|[^<]+|<"
_LINE_END = f"(?i)^<(?:br\\s*/?|/(?:{'|'.join(LINE_ENDS)}))>$"


@F.pandas_udf(StringType())
def _without_entities(s: pd.Series) -> pd.Series:
    marked = s.str.contains("&", regex=False, na=False)
    return s.where(~marked, s[marked].map(html.unescape)) if marked.any() else s


def unescape(text: Column) -> Column:
    """Character references as the characters; texts without an ampersand pass as they are."""
    return F.when(F.contains(text, F.lit("&")), _without_entities(text)).otherwise(text)


def page_text(page: Column, entities: bool = True) -> Column:
    """The lines of a page's text: tags are blanks or line ends, elements without text are blanks, runs of blanks are one, empty
    lines go. The page is cut into tokens once, and each token says what stands in its place."""
    tokens = F.regexp_extract_all(page, F.lit(_TOKEN), F.lit(0))
    text = F.transform(tokens, lambda t: F.when(~F.startswith(t, F.lit("<")) | (t == "<"), t).when(t.rlike(_LINE_END), "\n").otherwise(" "))
    whole = F.array_join(text, "")
    lines = F.transform(F.split(unescape(whole) if entities else whole, "\n"), lambda x: F.trim(F.regexp_replace(x, BLANKS, " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def page_title(page: Column, entities: bool = True) -> Column:
    """What stands between the first title tags; empty without them."""
    after = F.get(F.split(page, "(?i)<title>", 2), F.lit(1))
    title = F.when(after.rlike("(?i)</title>"), F.get(F.split(after, "(?i)</title>", 2), F.lit(0)))
    t = F.coalesce(title, F.when(page.isNotNull(), F.lit("")))
    return F.trim(unescape(t) if entities else t)


def cell_after(page: Column, label: str) -> Column:
    """The cell that follows the one with the label, tags read as cell borders."""
    cells = F.filter(F.transform(F.split(F.regexp_replace(page, "<[^>]+>", "|"), "\\|"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(cells, label)
    return F.when(at > 0, F.get(cells, at.cast("int")))


def hrefs(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit('href="([^"]*)"'), F.lit(1))


def object_values(text: Column, key: str) -> Column:
    """All values of a quoted key in object literals."""
    return F.regexp_extract_all(text, F.lit(f'"?{key}"?\\s*:\\s*"([^"]*)"'), F.lit(1))


def table_rows(page: Column) -> Column:
    """Rows of cell texts; only those with as many cells as the first, the header."""
    cell = lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", " "))
    rows = F.transform(F.regexp_extract_all(page, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), cell))
    return F.filter(rows, lambda r: F.size(r) == F.size(F.get(rows, F.lit(0))))
