"""Names, titles and keys. Unicode normalisation has no built-in, so it alone runs in Arrow batches; the rest are column
expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "\\u4e00-\\u9fff"


def unicode_form(form: str, drop_marks: bool = False):
    """A column function: the text in a normal form, without combining marks if asked for; null stays null."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        out = s.str.normalize(form)
        if drop_marks:
            out = out.map(lambda x: "".join(c for c in x if not unicodedata.combining(c)), na_action="ignore")
        return out

    return normal


def norm_title(title: Column) -> Column:
    """Width-folded, lower case, letters, digits and underscores of any script only."""
    return F.regexp_replace(F.lower(unicode_form("NFKC")(F.coalesce(title, F.lit("")))), "(?U)[^\\w" + HAN + "]", "")


def strict_title(title: Column) -> Column:
    """The same with Latin letters, digits and Han characters only."""
    return F.regexp_replace(F.lower(unicode_form("NFKC")(F.coalesce(title, F.lit("")))), "[^0-9a-z" + HAN + "]", "")


def name_key(name: Column) -> Column:
    """Without accents, lower case, Latin letters, digits and Han characters only."""
    return F.regexp_replace(F.lower(unicode_form("NFKD", True)(F.coalesce(name, F.lit("")))), "[^0-9a-z" + HAN + "]", "")


def institution_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^0-9a-z" + HAN + "]", "")


def _latin_parts(name: Column) -> Column:
    return F.filter(F.split(F.coalesce(name, F.lit("")), "[^A-Za-z]+"), lambda t: t != "")


def surname_key(name: Column) -> Column:
    """surname|initials of ``Last, First`` or ``First Last``; empty with fewer than two Latin parts."""
    t = _latin_parts(name)
    comma = name.contains(",")
    n = F.size(t)
    surname = F.when(comma, F.get(t, F.lit(0))).otherwise(F.get(t, n - 1))
    given = F.when(comma, F.slice(t, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))))
    key = F.lower(F.concat(surname, F.lit("|"), F.array_join(F.transform(given, lambda g: F.substring(g, 1, 1)), "")))
    return F.when(n < 2, "").otherwise(F.coalesce(key, F.lit("")))


def has_han(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike(f"[{HAN}]")


def han_count(s: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(s, F.lit("")), f"[^{HAN}]", ""))


def is_bare_surname(s: Column) -> Column:
    """One Latin word of 2 to 12 letters and nothing else, but for stars at its end."""
    t = F.regexp_replace(F.trim(F.coalesce(s, F.lit(""))), "[*＊]+$", "")
    return t.rlike("^(?U)\\p{L}{2,12}$") & ~has_han(t)


def looks_like_given(s: Column) -> Column:
    """Has a point, a blank or a hyphen, no Han character, and is no bare surname."""
    t = F.trim(F.coalesce(s, F.lit("")))
    return (t != "") & ~has_han(t) & t.rlike("[. -]") & ~is_bare_surname(t)


def is_fragment(s: Column) -> Column:
    """Cannot name one person: a surname with initials at most."""
    t = F.trim(F.coalesce(s, F.lit("")))
    parts = _latin_parts(t)
    n = F.size(parts)
    given = F.when(t.contains(","), F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))))
    return F.when(t == "", True).when(has_han(t), False).when(n < 2, True).otherwise(~F.exists(given, lambda g: F.length(g) >= 2))


def resplit(raw: Column) -> Column:
    """A |-joined list whose ``Last | First`` pairs were cut apart, joined again from left to right."""
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\\|"), lambda x: F.regexp_replace(F.trim(x), "[*＊]+$", "")), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.struct(x.alias("raw"), F.regexp_replace(x, "(?i)^(and|與|及)\\s+", "").alias("clean")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(acc, x):
        joins = acc["held"].isNotNull() & looks_like_given(x["raw"])
        done = F.when(joins, F.concat(acc["done"], F.array(F.concat(acc["held"], F.lit(", "), x["raw"])))).when(acc["held"].isNotNull(), F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])
        waits = ~joins & is_bare_surname(x["clean"])
        return F.struct(F.when(joins | waits, done).otherwise(F.concat(done, F.array(x["clean"]))).alias("done"), F.when(waits, x["clean"]).alias("held"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["held"].isNotNull(), F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]))


def name_tokens(name: Column) -> Column:
    """Lower-case Latin parts without accents."""
    return F.filter(F.split(F.lower(unicode_form("NFKD", True)(F.coalesce(name, F.lit("")))), "[^a-z]+"), lambda t: t != "")


def compatible(a: Column, b: Column) -> Column:
    """Whether two token lists may name one person: equal surnames (last), given names equal or initials position by position;
    with one more given name on one side, each of the fewer must fit one of the others."""
    sa, sb = F.get(a, F.size(a) - 1), F.get(b, F.size(b) - 1)
    na, nb = F.size(a) - 1, F.size(b) - 1
    ga, gb = F.slice(a, F.lit(1), F.greatest(na, F.lit(0))), F.slice(b, F.lit(1), F.greatest(nb, F.lit(0)))

    def fits(x, y):
        return (x == y) | ((F.length(x) == 1) & F.startswith(y, x)) | ((F.length(y) == 1) & F.startswith(x, y))

    level = F.forall(F.zip_with(ga, gb, lambda x, y: fits(x, y)), lambda z: z)
    short, long_ = F.when(na < nb, ga).otherwise(gb), F.when(na < nb, gb).otherwise(ga)
    loose = (F.abs(na - nb) <= 1) & F.forall(short, lambda x: F.exists(long_, lambda y: fits(x, y)))
    ok = F.when(na == nb, level).otherwise(loose)
    return F.coalesce((sa == sb) & (na > 0) & (nb > 0) & ok, F.lit(False))
