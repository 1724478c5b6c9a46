"""Stand-ins for bibliometric tables over the star-schema test tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: Names in braces are base tables or earlier entries.
SQL = {
    "papers_p": "select o_orderkey as paper_id, cast(year(o_orderdate) as int) as year, o_orderpriority as pub_category, o_orderstatus <> 'P' as edge_eligible, o_totalprice as amount from {orders}",
    "pa_p": "select l_orderkey as paper_id, lpad(cast(l_suppkey as varchar(20)), 6, '0') as node_id, min(l_linenumber) as ln from {lineitem} group by l_orderkey, l_suppkey",
    "nodes_p": "select lpad(cast(s_suppkey as varchar(20)), 6, '0') as node_id, case when s_suppkey % 3 = 0 then 'roster' else 'external' end as node_type, case when s_suppkey % 7 = 1 then null else s_nationkey end as institution, n_regionkey as country, (s_suppkey % 3 <> 0 and s_suppkey % 11 = 5) as unknown_place, s_name as name, s_acctbal as value from {supplier} join {nation} on s_nationkey = n_nationkey",
    "merges_p": "select lpad(cast(s_suppkey as varchar(20)), 6, '0') as from_node_id, case when s_suppkey % 100 = 37 then 'gone' else lpad(cast(s_suppkey - 1 as varchar(20)), 6, '0') end as to_node_id from {supplier} where s_suppkey % 10 = 7 and s_suppkey % 3 <> 0",
    "projects_p": "select l_partkey * 100 + cast(l_quantity as int) as family, cast(year(l_shipdate) as int) as year, lpad(cast(l_suppkey as varchar(20)), 6, '0') as member, l_returnflag as category, l_linestatus as discipline from {lineitem}",
    "grants_p": "select o_orderkey as grant_id, o_custkey as teacher_id, o_totalprice as amount, cast(year(o_orderdate) as int) as year, o_orderpriority as grant_category, o_orderstatus <> 'P' as is_pi, o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') as research, o_orderkey % 7 = 0 as marked from {orders}",
    "authors_g": "select l_orderkey as paper_id, lpad(cast(l_partkey as varchar(20)), 12, '0') || '-' || lpad(cast(cast(l_quantity as int) as varchar(20)), 2, '0') as node_id, min(l_linenumber) as ln from {lineitem} group by l_orderkey, l_partkey, cast(l_quantity as int)",
    "people_g": "select lpad(cast(l_partkey as varchar(20)), 12, '0') || '-' || lpad(cast(quantity as varchar(20)), 2, '0') as node_id, case when (l_partkey + quantity) % 2 = 0 then 'roster' else 'external' end as node_type, case when quantity % 7 = 1 then null else l_partkey % 40 end as institution, p_size % 6 as country, p_brand as brand, case when quantity % 5 = 0 then null else p_type end as kind, substr(p_name, 1, 3) as field, cast(floor(p_size / 10) as int) as age, quantity % 3 as rank_group, ((l_partkey + quantity) % 2 <> 0 and quantity % 11 = 5) as unknown_place, p_retailprice + quantity as value from (select distinct l_partkey, cast(l_quantity as int) as quantity from {lineitem}) x join {part} on p_partkey = l_partkey",
    "grants_g": "select l_orderkey as grant_id, lpad(cast(l_partkey as varchar(20)), 12, '0') || '-' || lpad(cast(cast(l_quantity as int) as varchar(20)), 2, '0') as node_id, o_totalprice as amount, o_orderstatus <> 'P' as is_pi, o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') as research from {lineitem} join {orders} on l_orderkey = o_orderkey where l_linenumber = 1",
    "raw_p": "select o_orderkey as id, case when o_custkey % 13 = 5 then null else (case when o_custkey % 3 = 1 then ' ' when o_custkey % 7 = 2 then '0' else '' end) || cast(year(o_orderdate) - 1911 as varchar(9)) || (case o_orderkey % 11 when 4 then '年' when 7 then 'x' else '' end) end as roc, case when o_custkey % 17 = 3 then null else (case o_custkey % 4 when 1 then '共同' when 2 then ' ' else '' end) || (case o_orderkey % 3 when 0 then '研究員' when 1 then '主持人' else '計畫主持人' end) end as role, o_orderpriority || (case o_custkey % 5 when 0 then ' (' when 1 then ' （' when 2 then ' [' else ' ' end) || cast(o_orderkey % 4 as varchar(9)) || (case o_custkey % 3 when 0 then '/' when 1 then '／' else '-' end) || cast(o_custkey % 4 as varchar(9)) || (case o_orderkey % 5 when 0 then ')' when 1 then '）' when 2 then ' )' else '' end) as title, substr((case when o_custkey % 2 = 0 then '|conflicting_author_sets' else '' end) || (case when o_custkey % 5 = 0 then '|incomplete_author_list' else '' end) || (case when o_orderkey % 7 = 0 then '|' || o_orderstatus else '' end) || (case when o_orderkey % 9 = 0 then '|publication_version_uncertain' else '' end) || (case when o_custkey % 11 = 0 then '|published_author_list_conflict' else '' end), 2) as reasons, substr('a經濟b學系，ABカナ研 究所한글統計', cast(1 + o_orderkey % 17 as int), cast(o_custkey % 6 as int)) as mixed from {orders}",
    "persons_p": "select c_custkey as teacher_id, c_nationkey as institution, c_mktsegment as attribute, c_acctbal as value from {customer}",
}


class Views:
    """The base tables and the stand-ins of one folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._made:
            if name in SQL:
                needs = set(re.findall(r"\{(\w+)\}", SQL[name]))
                self._made[name] = self.spark.sql(SQL[name], **{n: getattr(self, n) for n in needs})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def once(self, key, make):
        """What ``make`` gives, made once for these views: programs share it between their tables."""
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    @cached_property
    def name(self) -> str:
        return self.sf_dir


def duckdb_ctes(*names: str) -> str:
    """The stand-ins as the entries of a WITH clause."""
    return ", ".join(f"{n} AS ({re.sub(r'[{}]', '', SQL[n])})" for n in names)
