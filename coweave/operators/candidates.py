"""Lines of web pages that may tell a person's degree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import affiliations as A
from .lineage import cut, drop

# How far behind the name a line may stand, and the rank of each kind of page.
MOST_DISTANCE = {"profile": 1500, "personal": 1500, "host_title": 1500, "list": 400}
SOURCE_RANK = {"profile": 0, "personal": 1, "host_title": 2, "list": 3}


ANCHORS = (2, 3, 4, 8)
#: Names are met by as many characters at most; the multiplier of their hashes.
WINDOW, STEP = 16, np.uint64(0x100000001B3)


def _spread(codes: np.ndarray) -> np.ndarray:
    return codes * np.uint64(0x9E3779B97F4A7C15)


def name_index(names: list[str]) -> list[tuple]:
    """By length, up to WINDOW: sorted hashes of the names' first characters, where each range of hashes starts, and the sorted names'
    numbers and characters."""
    wide, index = np.array([min(len(n), WINDOW) for n in names], np.int64), []
    for size in np.unique(wide).tolist():
        own = np.flatnonzero(wide == size)
        codes = np.frombuffer("".join(names[i][:size] for i in own).encode("utf-32-le"), np.uint32).reshape(-1, size)
        h = codes[:, 0].astype(np.uint64)
        for k in range(1, size):
            h = h * STEP + codes[:, k]
        order = np.argsort(_spread(h), kind="stable")
        keys, bits = _spread(h)[order], max(8, (4 * len(own)).bit_length())
        starts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64)).astype(np.int32)
        index.append((size, np.uint64(64 - bits), keys, starts, own[order], codes[order]))
    return index


def names_in(text: str, names: list[str], index: list[tuple]) -> np.ndarray:
    """Numbers, ascending, of the names that stand in the text. Windows of the text meet names of their length, or the first
    characters of longer ones, on equal hashes; what met is compared."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h, done, found = x.astype(np.uint64), 1, [np.empty(0, np.int64)]
    for size, shift, keys, starts, own, codes in index:
        if size > len(x):
            break
        for k in range(done, size):
            h = h[:-1] * STEP + x[k:]
        done, mixed = size, _spread(h)
        slot = mixed >> shift
        at, upto, place = starts[slot], starts[slot + np.uint64(1)], np.full(len(keys), -1)
        here = np.flatnonzero(at < upto)
        at, upto, mixed = at[here], upto[here], mixed[here]
        while len(here):
            same = keys[at] == mixed
            place[at[same]] = here[same]
            at = at + 1
            more = at < upto
            here, at, upto, mixed = here[more], at[more], upto[more], mixed[more]
        met = np.flatnonzero(place >= 0)
        sure = (x[place[met][:, None] + np.arange(size)] == codes[met]).all(1)
        if size == WINDOW or not sure.all():
            sure = np.array([names[i] in text for i in own[met]], bool)
        found.append(own[met[sure]])
    return np.sort(np.concatenate(found))


def names_of_pages(pages: DataFrame, people: DataFrame, local_chars: int = 1 << 23) -> DataFrame:
    """url, names: the different names, of two characters or more and of any script, in ascending order, that stand in a page's text;
    pages without one are left out.

    Names of at most ``local_chars`` characters in all, counted beforehand, go to the pages, so no page and no pair of a page and a
    name is shuffled. With more names, pages and names meet by joins. pages: url (which tells texts apart), text; people: name."""
    spark = pages.sparkSession
    names = cut(people.filter(F.length("name") >= 2).select("name").distinct())
    if (names.agg(F.sum(F.length("name"))).first()[0] or 0) > local_chars:
        return _met_by_anchors(pages, names).groupBy("url").agg(F.array_sort(F.collect_set("name")).alias("names"))
    known = sorted(r[0] for r in names.collect())
    drop(names)
    told = spark.sparkContext.broadcast((known, name_index(known)))

    def run(batches):
        known, index = told.value
        words = pa.array(known, pa.string())
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                each = [names_in(t, known, index) if t else np.empty(0, np.int64) for t in b.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(np.concatenate(each))))
                yield pa.RecordBatch.from_arrays([b.column("url"), lists], ["url", "names"])

    schema = StructType([pages.schema["url"], StructField("names", ArrayType(StringType()))])
    return pages.select("url", "text").mapInArrow(run, schema).filter("size(names) > 0")


def names_on_pages(pages: DataFrame, people: DataFrame) -> DataFrame:
    """url, name of each different name, as in ``names_of_pages``, on a page."""
    return names_of_pages(pages, people).select("url", F.explode("names").alias("name"))


def _met_by_anchors(pages: DataFrame, names: DataFrame) -> DataFrame:
    """url, name. A name is anchored by its first characters, as many as the greatest of ANCHORS that it has; pages and names meet on
    equal anchors, and only longer names are then looked for in the text. A match of the anchors takes a whole character, also one of
    two UTF-16 units."""
    size = F.greatest(*[F.when(F.length("name") >= n, n).otherwise(0) for n in ANCHORS])
    names = names.withColumn("size", size).withColumn("anchor", F.substr("name", F.lit(1), F.col("size")))
    grams = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in ANCHORS])))
    met = pages.select("url", F.explode(grams).alias("anchor")).join(names, "anchor")
    short = met.filter(F.length("name") == F.col("size")).select("url", "name")
    longer = met.filter(F.length("name") > F.col("size")).join(pages.select("url", "text"), "url").filter(F.contains("text", F.col("name"))).select("url", "name")
    return short.union(longer)


def find_candidates(people: DataFrame, pages: DataFrame, degree_word: str, school_word: str, degree_cell: str, other: str, crowded: int = 3) -> DataFrame:
    """teacher_id, src, url, line, lines_after, other_names, rank, best rank first by (rank, url).

    A person's pages are the official one (a list if several people share it), the personal one, and those on the official host
    whose title has the name. The line is the first degree line behind the name, not too far from it for the kind of page; pages
    that name ``crowded`` other people or more rank half a step lower. people: teacher_id, name, profile, website, shared_by;
    pages: url, host, title, text."""
    one = lambda src, url: people.filter(F.coalesce(url, F.lit("")) != "").select("teacher_id", "name", src.alias("src"), url.alias("url"))
    official = one(F.when(F.coalesce("shared_by", F.lit(1)) == 1, "profile").otherwise("list"), F.col("profile"))
    personal = one(F.lit("personal"), F.col("website"))
    hosts = people.select("teacher_id", "name", "profile", F.parse_url("profile", F.lit("HOST")).alias("host")).join(pages.select("url", "host", "title"), "host")
    titled = hosts.filter((F.col("url") != F.col("profile")) & F.contains("title", F.col("name"))).select("teacher_id", "name", F.lit("host_title").alias("src"), "url")
    found = official.unionByName(personal).unionByName(titled).join(pages.select("url", "text"), "url")

    at = F.position(F.col("name"), F.col("text"))
    found = found.withColumn("at", at).filter((F.col("at") > 0) | (F.col("src") == "personal")).withColumn("tail", F.substr("text", F.greatest("at", F.lit(1))))
    plain = A.degree_lines(F.col("tail"), degree_word, school_word, other)
    found = found.withColumn("l", F.when(F.size(plain) > 0, plain).otherwise(A.table_degree_lines(F.col("tail"), degree_cell, school_word, "PhD")))
    first = F.get("l", F.lit(0))
    limit = F.create_map(*[F.lit(x) for pair in MOST_DISTANCE.items() for x in pair])[F.col("src")]
    found = found.filter(F.size("l") > 0).withColumn("far", F.position(first, F.col("tail")) - 1).filter(F.col("far") < limit)

    named = names_on_pages(pages.join(found.select("url").distinct(), "url", "left_semi"), people)
    crowd = named.groupBy("url").agg(F.count(F.lit(1)).alias("named"))
    own = named.select("url", "name", F.lit(1).alias("self"))
    found = found.join(crowd, "url", "left").join(own, ["url", "name"], "left").withColumn("other_names", F.coalesce("named", F.lit(0)) - F.coalesce("self", F.lit(0)))
    rank = F.create_map(*[F.lit(x) for pair in SOURCE_RANK.items() for x in pair])[F.col("src")]
    squeezed = F.trim(F.regexp_replace(first, "\\s+", " "))
    return found.select("teacher_id", "src", "url", squeezed.alias("line"), F.size(F.array_distinct("l")).alias("lines_after"), "other_names", (rank + F.when(F.col("other_names") >= crowded, 0.5).otherwise(0.0)).alias("rank"))
