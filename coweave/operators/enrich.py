"""Enrichment of people with profiles, affiliations and departments, and the tables derived for analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import affiliations as A
from ..functions import classify as C
from ..functions import names as N
from . import grants as G
from . import linkage as L
from .papers import first_by
from .ranges import numbered


def ordered_union(*lists: Column) -> Column:
    """All values of the lists, each once, in the order in which they come."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def merge_aliases(nodes: DataFrame, merges: DataFrame, *columns: str) -> DataFrame:
    """nodes less those merged into others; the lists in ``columns`` of a surviving node, then those of the nodes that it took,
    by their id. nodes: node_id and array columns; merges: from_node_id, to_node_id (one hop)."""
    gone = merges.select(F.col("from_node_id").alias("node_id"), "to_node_id")
    took = nodes.join(gone, "node_id").groupBy(F.col("to_node_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("node_id", *columns))).alias("_took"))
    kept = nodes.join(gone, "node_id", "left_anti").join(took, "node_id", "left")
    more = lambda c: F.flatten(F.transform("_took", lambda x: F.coalesce(x[c], F.array().cast("array<string>"))))
    return kept.withColumns({c: ordered_union(F.col(c), more(c)) for c in columns}).drop("_took")


def own_institution(people: DataFrame, institutions: DataFrame) -> DataFrame:
    """people with ``ours``: the English name of a roster member's institution (its own name where the table lacks it), or an
    external author's first institution. people: is_roster, institution, institutions (array); institutions: name, name_en."""
    english = institutions.select(F.col("name").alias("institution"), F.col("name_en").alias("_english"))
    listed = F.coalesce(F.get("institutions", F.lit(0)), F.lit(""))
    ours = F.when(F.col("is_roster"), F.coalesce("_english", "institution", F.lit(""))).otherwise(listed)
    return people.join(english, "institution", "left").withColumn("ours", ours).drop("_english")


def enrich(people: DataFrame, candidates: DataFrame, profiles: DataFrame, institutions: DataFrame) -> DataFrame:
    """Each person's accepted profile: node_id, author_id, method, confidence, rule, flags and the profile's columns; a profile
    whose flags do not pass the gate is dropped, and its rule stays.

    people (of all populations, marked by is_roster): node_id, is_roster, institution, institutions, n_papers. candidates:
    node_id, method, author_id, evidence, own_works. profiles: author_id, field, country, works, last_institution."""
    known = candidates.join(profiles.select("author_id", "field", "country"), "author_id", "left")
    chosen = L.decide(known.join(people.select("node_id", "is_roster"), "node_id"))
    p = own_institution(people, institutions).join(chosen, "node_id", "left").join(profiles, "author_id", "left")
    p = p.withColumn("flags", C.quality_flags(F.col("is_roster"), F.col("country"), F.col("field"), F.col("works"), F.col("n_papers"), C.PLAUSIBLE_FIELDS))
    found = F.col("author_id").isNotNull() & F.col("field").isNotNull()
    p = p.withColumn("gate", F.when(found, C.flag_gate(F.col("flags"), F.col("ours"), F.col("last_institution"))))
    taken = F.coalesce(F.col("gate.accept"), F.lit(False))
    only = lambda c: F.when(taken, F.col(c)).alias(c)
    return p.select("node_id", "is_roster", only("author_id"), F.when(taken, F.col("method")).otherwise("none").alias("method"), only("confidence"), F.coalesce("gate.rule", F.lit("")).alias("rule"), only("flags"), only("field"), only("country"), only("works"), only("last_institution"))


def missing_affiliations(people: DataFrame, filled_before: DataFrame, sources: tuple[str, ...] = ("none", "journal_pdf")) -> DataFrame:
    """People who lack an affiliation, with those whose present one came from an earlier run of the same stage: a source in
    ``sources``, or listed in filled_before (node_id)."""
    again = filled_before.select("node_id").distinct().withColumn("_again", F.lit(True))
    return people.join(again, "node_id", "left").filter(F.coalesce("affil_source", F.lit("none")).isin(*sources) | F.col("_again")).drop("_again")


def journal_targets(papers: DataFrame, missing: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """paper_id, title, journal of papers with an author in missing (node_id) in one of the journals; rules: journal, pattern of
    its venues; the first that fits counts. papers: paper_id, title, venue, node_ids."""
    journal = F.coalesce(*[F.when(F.coalesce("venue", F.lit("")).rlike(pattern), F.lit(name)) for name, pattern in rules])
    wanted = papers.select("paper_id", F.explode("node_ids").alias("node_id")).join(missing.select("node_id"), "node_id", "left_semi").select("paper_id").distinct()
    return papers.join(wanted, "paper_id", "left_semi").select("paper_id", "title", journal.alias("journal")).filter("journal IS NOT NULL")


def match_titles(targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """targets with the entry of the catalogue (ord, url, title, title_en) that has their title in either language; of several
    the first by ord."""
    both = catalog.select("ord", "url", F.explode(F.array("title", "title_en")).alias("t")).filter("coalesce(t, '') <> ''")
    keyed = first_by(both.withColumn("key", N.strict_title(F.col("t"))).filter("key <> ''"), ["key"], "ord")
    return targets.withColumn("key", N.strict_title(F.col("title"))).join(keyed.select("key", "ord", "url"), "key").drop("key")


def page_affiliations(pages: DataFrame, people: DataFrame, domains: DataFrame) -> DataFrame:
    """node_id, institution, method, confidence from first pages: notes and name lines by the place of the author; else the
    address of a paper's only author, if one institution's domain ends it. The best evidence of each node counts.

    pages: paper_id, text, authors (names in order), node_ids. people: node_id, key (of a name; only those without an affiliation).
    domains: suffix, institution, ord."""
    p = pages.filter(N.has_han(F.col("text"))).withColumn("found", A.author_affiliations(F.col("text"), F.col("authors")))
    named = p.select("paper_id", F.posexplode(F.arrays_zip("authors", "found")).alias("at", "x")).select("paper_id", N.name_key(F.col("x.authors")).alias("key"), F.col("x.found").alias("institution"))
    by_place = named.filter("coalesce(institution, '') <> ''").join(people, "key").select("paper_id", "node_id", "institution", F.lit("place").alias("method"), F.lit("high").alias("confidence"))
    unread = pages.join(named.filter("coalesce(institution, '') <> ''").select("paper_id").distinct(), "paper_id", "left_anti")
    alone = unread.filter(F.size("node_ids") == 1).select("paper_id", F.get("node_ids", F.lit(0)).alias("node_id"), F.explode(A.email_domains(F.col("text"))).alias("domain")).join(people.select("node_id"), "node_id", "left_semi")
    by_mail = L.domain_match(alone, domains).filter("institution IS NOT NULL").select("paper_id", "node_id", "institution", F.lit("email").alias("method"), F.lit("medium").alias("confidence"))
    rank = F.when(F.col("confidence") == "high", 0).otherwise(1)
    return first_by(by_place.unionByName(by_mail), ["node_id"], rank, "paper_id", "institution").select("node_id", "institution", "method", "confidence")


def name_variants(people: DataFrame, places: DataFrame, institutions: DataFrame, aliases: DataFrame, longer_than: int = 4) -> DataFrame:
    """node_id, variants: keys of all names of an external author's institution: as the author has it, those of the roster's
    institution and its aliases, or the label of the place. people: node_id, institution; places: node_id, institution_code,
    label; institutions: institution_code, name, name_en; aliases: alias, name."""
    other = aliases.groupBy("name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    i = institutions.join(other, "name", "left").select("institution_code", F.concat(F.array("name", "name_en"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"))
    p = people.join(places, "node_id", "left").join(i, "institution_code", "left")
    texts = F.concat(F.array("institution"), F.coalesce("names", F.array("label")))
    keys = F.array_distinct(F.transform(texts, lambda x: N.institution_key(x)))
    return p.select("node_id", F.array_sort(F.filter(keys, lambda k: F.length(k) > longer_than)).alias("variants"))


def roster_code(names: DataFrame, institutions: DataFrame, aliases: DataFrame, key: str = "name") -> DataFrame:
    """names with the code of the roster's institution that has one of them, by either of its names or an alias."""
    i = institutions.select("institution_code", F.explode(F.array("name", "name_en")).alias("n")).select("institution_code", N.institution_key(F.col("n")).alias("_k")).filter("_k <> ''")
    a = aliases.select(N.institution_key(F.col("alias")).alias("_k"), N.institution_key(F.col("name")).alias("_to"))
    known = i.groupBy("_k").agg(F.min("institution_code").alias("institution_code"))
    through = a.join(known.withColumnRenamed("_k", "_to"), "_to").select("_k", F.col("institution_code").alias("_alias_code"))
    n = names.withColumn("_k", N.institution_key(F.col(key)))
    return n.join(through, "_k", "left").join(known, "_k", "left").withColumn("institution_code", F.coalesce("_alias_code", "institution_code")).drop("_k", "_alias_code")


def guarded_roster_match(country: Column, code: Column, home: str = "TW") -> Column:
    """The code of a roster institution only for authors who are not known to be abroad: names alone are ambiguous."""
    return F.when(country.isNull() | (country == "") | (country == home), code)


def match_institutions(people: DataFrame, decisions: DataFrame, listed: DataFrame) -> DataFrame:
    """node_id, kind, ids: what an author's affiliation stands for, in order of preference.

    A decision on the affiliation comes first, and one of "none" ends it. Else the ids that the author's own profile lists under the
    same name, in its order; behind them those that profiles list under it in the same country, the most frequent first; and if there
    are none of these, the one id that the name stands for anywhere, if there is only one. people: node_id, affil, country, author_id;
    decisions: affil, decision ("kind:value"); listed: author_id, ord, inst_id, name, country."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))
    p = people.select("node_id", plain(F.col("affil")).alias("affil"), F.coalesce("country", F.lit("")).alias("country"), "author_id").filter("affil <> ''").withColumn("key", N.institution_key(F.col("affil")))
    d = first_by(decisions.select(plain(F.col("affil")).alias("affil"), F.coalesce("decision", F.lit("")).alias("decision")), ["affil"], F.desc("decision"))
    decided = p.join(d, "affil").select("node_id", F.substring_index("decision", ":", 1).alias("kind"), F.array(F.regexp_replace("decision", "^[^:]*:?", "")).alias("ids"))
    decided = decided.filter(F.col("kind").isin("roster", "ror", "wd", "ll") & (F.get("ids", F.lit(0)) != ""))
    rest = p.join(d, "affil", "left_anti")

    known = listed.filter("inst_id IS NOT NULL AND coalesce(name, '') <> ''").select("author_id", "ord", "inst_id", N.institution_key(F.col("name")).alias("key"), F.coalesce("country", F.lit("")).alias("country"))
    ids = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, "inst_id"))), lambda x: x["inst_id"])
    of_author = known.groupBy("author_id", "key", "inst_id").agg(F.min("ord").alias("ord")).groupBy("author_id", "key").agg(ids("ord").alias("own"))
    often = known.groupBy("key", "country", "inst_id").agg((-F.count(F.lit(1))).alias("often"))
    here = often.groupBy("key", "country").agg(ids("often").alias("same"))
    anywhere = known.groupBy("key").agg(F.min("inst_id").alias("a"), F.max("inst_id").alias("z")).filter("a = z").select("key", F.array("a").alias("only"))
    none = F.array().cast(dict(listed.dtypes)["inst_id"].join(("array<", ">")))
    j = rest.join(of_author, ["author_id", "key"], "left").join(here, ["key", "country"], "left").join(anywhere, "key", "left")
    found = F.array_distinct(F.concat(F.coalesce("own", none), F.coalesce("same", "only", none)))
    matched = j.select("node_id", F.lit("oa").alias("kind"), found.cast("array<string>").alias("ids")).filter("size(ids) > 0")
    return decided.unionByName(matched)


def derive_grants(rows: DataFrame, page_rows: DataFrame, people: DataFrame, research: str = "專題研究計畫") -> DataFrame:
    """The grants table: raw rows (record_id, teacher_id, roc_year, grant_category, project_title, role) beside the rows of the
    person's page in the same order (ord, roc_year, project_title, role, amount_text), whether they agree, the amount, year, role
    and marks, the node, and how many years a research grant is taken to span."""
    paired = L.align_by_position(rows, page_rows, "teacher_id", "record_id", "ord", ["roc_year", "project_title", "role"])
    g = paired.withColumns({"aligned": F.col("aligned") & F.col("ord").isNotNull(), "amount": G.money(F.col("amount_text")), "year": G.roc_year(F.trim("roc_year")), "is_pi": G.is_pi(F.col("role")), "marked": G.is_marked(F.col("project_title"))})
    g = g.withColumns({"research": F.startswith(F.col("grant_category"), F.lit(research)) & F.col("year").isNotNull(), "grant_id": F.col("record_id")})
    out = G.with_durations(g, G.SPREAD_FROM).join(people.select("teacher_id", "node_id"), "teacher_id", "left")
    return out.select("record_id", "teacher_id", "node_id", "aligned", "amount", "year", "is_pi", "marked", "gap_next", "dur", "amount_per_year")


def discipline_counts(projects: DataFrame, codes: DataFrame) -> DataFrame:
    """person, counts (map of code to projects) of each person's projects. projects: person, discipline; codes: discipline, code."""
    n = projects.join(codes, "discipline").groupBy("person", "code").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("person").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("counts"))


def coverage(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """population, column, filled, rows: how many rows of each table have a value."""
    out = None
    for name, t in tables.items():
        filled = [F.struct(F.lit(c).alias("column"), F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias("filled")) for c in columns]
        part = t.agg(F.count(F.lit(1)).alias("rows"), F.array(*filled).alias("f")).select(F.lit(name).alias("population"), "rows", F.explode("f").alias("x")).select("population", "x.column", "x.filled", "rows")
        out = part if out is None else out.unionByName(part)
    return out


def roster_attributes(people: DataFrame, short_names: DataFrame, topics: DataFrame) -> DataFrame:
    """people with the short name of their institution (the name itself where there is none) and the label of their main topic.
    short_names: institution, short; topics: code, label; people: institution, topic_code."""
    return people.join(short_names, "institution", "left").withColumn("short", F.coalesce("short", "institution")).join(topics.select(F.col("code").alias("topic_code"), F.col("label").alias("topic")), "topic_code", "left")


def top_institutions(ties: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """country, institution, people, rank: the institutions with most collaborators in each country. ties: alter; nodes: node_id,
    country, institution."""
    n = ties.select(F.col("alter").alias("node_id")).distinct().join(nodes.filter("institution IS NOT NULL"), "node_id").groupBy("country", "institution").agg(F.count(F.lit(1)).alias("people"))
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("people"), "institution"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= most)


def edge_payload(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b (places of the ends in the sorted list of nodes), layer, year, item, w: what a page needs of an event."""
    at = numbered(nodes.select("node_id").distinct(), "node_id", "at")
    e = events.join(at.toDF("u", "i"), "u").join(at.toDF("v", "j"), "v")
    return e.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.when(F.col("layer") == "pub", 0).otherwise(1).alias("layer"), "year", "item", F.round("weight_1n", 4).alias("w"))


def wanted_affiliations(works: DataFrame, authors: DataFrame) -> DataFrame:
    """author_id, year, strings, institutions of the wanted authors' authorships. works: publication_year, authorships (array of
    author_id, strings, institutions); authors: author_id."""
    a = works.select(F.col("publication_year").alias("year"), F.explode("authorships").alias("a")).select("a.author_id", "year", "a.strings", "a.institutions")
    return a.filter(F.size("strings") > 0).join(authors.select("author_id").distinct(), "author_id", "left_semi")


def first_coordinates(answers: DataFrame) -> DataFrame:
    """id, lat, lon: the first point, Point(lon lat), that an id's answers (id, ord, point) have."""
    number = "(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    at = lambda k: F.nullif(F.regexp_extract("point", f"Point[(]{number} {number}[)]", k), F.lit("")).try_cast("double")
    parts = answers.select("id", "ord", at(2).alias("lat"), at(1).alias("lon"))
    return first_by(parts.filter("lat IS NOT NULL AND lon IS NOT NULL"), ["id"], "ord").select("id", "lat", "lon")
