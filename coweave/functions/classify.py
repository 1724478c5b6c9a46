"""Ordered rules that map text to classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grant categories, institution and rank prefixes, and country names as the source data writes them.
YOUNG = ("優秀年輕學者", "國際年輕傑出學者", "新秀學者", "愛因斯坦培植", "吳大猷先生紀念獎")
CATEGORY_ORDER = ("一般研究", "新進人員", "年輕學者獎勵", "特約與其他專題", "推動規劃", "人才培育與圖書", "延攬人才", "交流與會議")
RESEARCH_CATEGORIES = CATEGORY_ORDER[:4]
BLOCKING_REASONS = ("unresolved_author_identity_or_fragment", "published_author_list_conflict", "publication_version_uncertain", "incomplete_author_list")
PLAUSIBLE_FIELDS = ("Economics, Econometrics and Finance", "Business, Management and Accounting", "Social Sciences", "Decision Sciences", "Mathematics", "Psychology", "Arts and Humanities", "Environmental Science", "Energy")
METHOD_STRENGTH = (("orcid_roster", 4), ("coappearance", 3), ("coappearance_single", 2), ("orcid_node", 2), ("node_table", 2), ("teacher_table", 2), ("name_search", 1))
INSTITUTION_HINTS = ("universit", "college", "institute", "academy", "school", "bank", "ministry", "laborator", "center", "centre", "research", "hospital", "foundation", "department of economics")
INSTITUTION_HINTS_HAN = ("大學", "學院", "研究院", "研究所", "中心", "銀行", "部", "署")
INSTITUTION_STOP = ("national", "university", "of", "the", "college", "institute", "and", "taiwan", "academy", "school", "center", "centre", "department")
COUNTRIES = (
    ("taiwan", "TW"), ("r.o.c", "TW"), ("roc", "TW"), ("taipei", "TW"), ("chinese taipei", "TW"), ("china", "CN"), ("hong kong", "HK"), ("macau", "MO"),
    ("japan", "JP"), ("korea", "KR"), ("singapore", "SG"), ("usa", "US"), ("u.s.a", "US"), ("united states", "US"), ("us", "US"), ("uk", "GB"),
    ("united kingdom", "GB"), ("england", "GB"), ("scotland", "GB"), ("canada", "CA"), ("australia", "AU"), ("new zealand", "NZ"), ("germany", "DE"),
    ("france", "FR"), ("italy", "IT"), ("spain", "ES"), ("netherlands", "NL"), ("belgium", "BE"), ("switzerland", "CH"), ("austria", "AT"),
    ("sweden", "SE"), ("norway", "NO"), ("denmark", "DK"), ("finland", "FI"), ("ireland", "IE"), ("portugal", "PT"), ("poland", "PL"), ("czech", "CZ"),
    ("greece", "GR"), ("turkey", "TR"), ("israel", "IL"), ("india", "IN"), ("thailand", "TH"), ("vietnam", "VN"), ("malaysia", "MY"),
    ("indonesia", "ID"), ("philippines", "PH"), ("brazil", "BR"), ("mexico", "MX"), ("chile", "CL"), ("argentina", "AR"), ("south africa", "ZA"),
    ("russia", "RU"),
)


def _any(c: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def grant_category(c: Column) -> Column:
    return (
        F.when(c.isNull(), "交流與會議")
        .when(c.contains("一般研究計畫"), "一般研究")
        .when(c.contains("新進人員"), "新進人員")
        .when(c.contains("推動規劃"), "推動規劃")
        .when(_any(c, YOUNG), "年輕學者獎勵")
        .when(c.contains("人才培育") | c.contains("圖書資料庫"), "人才培育與圖書")
        .when(c.startswith("專題研究計畫"), "特約與其他專題")
        .when(c.startswith("延攬科技人才"), "延攬人才")
        .otherwise("交流與會議")
    )


def institution_type(s: Column) -> Column:
    return F.when(s.startswith("中央研究院"), "中研院").when(s.startswith("國立"), "國立").when(s.isNotNull(), "私立")


def rank_group(s: Column) -> Column:
    return F.when(s.startswith("助"), "助理").when(s.startswith("副"), "副").when(s.isNotNull(), "正")


def phd_origin(country: Column) -> Column:
    return F.when((country == "") | country.isNull(), F.lit(None).cast("string")).when(country == "TW", "國內").when(country == "US", "美國").otherwise("其他國外")


def normalize_affiliation(raw: Column) -> Column:
    """struct(institution, country) of a free text: the last part that is a country name, else the first country name of over
    three letters found anywhere; the first part at university level, else the first that looks like an institution."""
    text = F.coalesce(raw, F.lit(""))
    parts = F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    codes = F.create_map(*[F.lit(x) for pair in COUNTRIES for x in pair])
    listed = F.filter(F.transform(parts, lambda x: F.try_element_at(codes, F.regexp_replace(F.lower(x), "^[.]+|[.]+$", ""))), lambda x: x.isNotNull())
    inside = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in COUNTRIES if len(k) > 3]), lambda p: F.contains(F.lower(text), p["k"]))
    country = F.coalesce(F.get(listed, F.size(listed) - 1), F.get(inside, F.lit(0))["v"], F.lit(""))
    hinted = F.filter(parts, lambda x: _any(F.lower(x), INSTITUTION_HINTS) | _any(x, INSTITUTION_HINTS_HAN))
    high = F.filter(hinted, lambda x: _any(F.lower(x), ("universit", "academy")) | _any(x, ("大學", "研究院")))
    institution = F.coalesce(F.get(high, F.lit(0)), F.get(hinted, F.lit(0)), F.get(parts, F.lit(0)), text)
    return F.struct(institution.alias("institution"), country.alias("country"))


def institution_tokens(s: Column) -> Column:
    return F.array_except(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), "[^a-z]+"), lambda t: t != "")), F.array(*[F.lit(w) for w in INSTITUTION_STOP]))


def same_institution(a: Column, b: Column) -> Column:
    """Half of the smaller token set, or more, in common."""
    x, y = institution_tokens(a), institution_tokens(b)
    both, least = F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))
    return F.coalesce((least > 0) & (both > 0) & (both / least >= 0.5), F.lit(False))


def flag_gate(flags: Column, ours: Column, theirs: Column) -> Column:
    """struct(accept, rule) of a profile with quality flags (array) and both institutions."""
    mild = F.size(F.array_except(flags, F.array(F.lit("country_mismatch"), F.lit("works_count_outlier")))) == 0
    rule = (
        F.when(F.size(flags) == 0, "no_flag")
        .when(mild, "rule1_country_or_volume_only")
        .when(F.trim(F.coalesce(ours, F.lit(""))) == "", "rule3_no_institution_on_record")
        .when(same_institution(ours, theirs), "rule2_institution_matches")
        .otherwise("rule4_keep_our_institution_only")
    )
    return F.struct((rule != "rule4_keep_our_institution_only").alias("accept"), rule.alias("rule"))


def quality_flags(is_roster: Column, country: Column, field: Column, works: Column, local_papers: Column, plausible: tuple[str, ...]) -> Column:
    """array of flags of a profile: its country, field and volume of work against what is known locally."""
    c = F.coalesce(country, F.lit(""))
    w, n = F.coalesce(works, F.lit(0)), F.coalesce(local_papers, F.lit(0))
    return F.array_compact(F.array(
        F.when(is_roster & ~c.isin("TW", ""), "country_mismatch"),
        F.when(~F.coalesce(field, F.lit("")).isin(*plausible), "field_atypical"),
        F.when((w >= 250) & ((n == 0) | (w > 8 * n)), "works_count_outlier"),
    ))


def subtract_reasons(reasons: Column, gone: tuple[str, ...]) -> Column:
    """A |-joined list without some of its entries."""
    kept = F.filter(F.split(F.coalesce(reasons, F.lit("")), "\\|"), lambda r: (r != "") & ~r.isin(*gone))
    return F.array_join(kept, "|")


def is_blocked(reasons: Column, blocking: tuple[str, ...] = BLOCKING_REASONS) -> Column:
    return F.arrays_overlap(F.split(F.coalesce(reasons, F.lit("")), "\\|"), F.array(*[F.lit(b) for b in blocking]))


def first_pattern(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the rule whose pattern starts earliest in the text; ties by the order of the rules."""
    found = F.filter(F.array(*[F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, p) in enumerate(rules)]), lambda x: x["at"] > 0)
    return F.array_min(found)["n"]


def first_matches(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Distinct codes of all matching rules, in rule order."""
    hits = F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules])
    return F.array_distinct(F.array_compact(hits))
