"""The knowledge model over the driver's tables: evidence, entities, facts, read from parquet.

Each view is defined once as SQL text that Spark and DuckDB both take, so a query's oracle starts from
the same rows. In Spark the views are lazy: only the columns a query names are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VERSIONS = "cast(1 + {k} % 8 as bigint) as created, cast(1 + {k} % 4 as bigint) as valid_from, case when {k} % 3 = 0 then null else cast(1 + {k} % 4 + {k} % 5 as bigint) end as valid_until, case when {k} % 7 = 0 then 'proposed' else 'accepted' end as status"


def _v(k: str) -> str:
    return _VERSIONS.format(k=k)


#: name -> (tables it reads, SQL)
VIEWS: dict[str, str] = {
    "evidence": """select concat('doc:', cast(doc_id as varchar(20))) as evidence_id, source as source_scope, concat(source, '/', lang, '/', cast(doc_id as varchar(20))) as source_path, text as content, cast(1 + doc_id % 8 as bigint) as created, case when doc_id % 10 = 0 then 'rejected' when doc_id % 10 = 1 then 'proposed' else 'accepted' end as status, cast(null as varchar(20)) as parent_id, 'text_span' as modality from documents
      union all select concat('turn:', cast(conv_id as varchar(20)), ':', cast(turn as varchar(20))), 'chat', concat('chat/', cast(conv_id as varchar(20))), text, cast(1 + conv_id % 8 as bigint), 'accepted', concat('conv:', cast(conv_id as varchar(20))), 'caption' from conversations""",
    "evidence_entities": "select concat('doc:', cast(doc_id as varchar(20))) as evidence_id, concat('nation:', cast(doc_id % 25 as varchar(20))) as entity_id from documents",
    "entities": """select concat('region:', cast(r_regionkey as varchar(20))) as entity_id, r_name as label, cast(1 as bigint) as created from region
      union all select concat('nation:', cast(n_nationkey as varchar(20))), n_name, cast(1 as bigint) from nation
      union all select concat('supplier:', cast(s_suppkey as varchar(20))), s_name, cast(1 + s_suppkey % 8 as bigint) from supplier
      union all select concat('part:', cast(p_partkey as varchar(20))), p_name, cast(1 + p_partkey % 8 as bigint) from part
      union all select concat('customer:', cast(c_custkey as varchar(20))), c_name, cast(1 + c_custkey % 8 as bigint) from customer""",
    "relations": f"""select concat('rel:n', cast(n_nationkey as varchar(20))) as fact_id, concat('nation:', cast(n_nationkey as varchar(20))) as src_id, 'part_of' as relation_type, concat('region:', cast(n_regionkey as varchar(20))) as dst_id, cast(n_nationkey as bigint) as ev, {_v("n_nationkey")} from nation
      union all select concat('rel:s', cast(s_suppkey as varchar(20))), concat('supplier:', cast(s_suppkey as varchar(20))), 'located_in', concat('nation:', cast(s_nationkey as varchar(20))), cast(s_suppkey as bigint), {_v("s_suppkey")} from supplier
      union all select concat('rel:c', cast(c_custkey as varchar(20))), concat('customer:', cast(c_custkey as varchar(20))), 'located_in', concat('nation:', cast(c_nationkey as varchar(20))), cast(c_custkey as bigint), {_v("c_custkey")} from customer""",
    "claims": f"select concat('claim:', cast(p_partkey as varchar(20))) as fact_id, concat('part:', cast(p_partkey as varchar(20))) as subject_id, 'has_brand' as predicate, p_brand as object, cast(p_partkey as bigint) as ev, {_v('p_partkey')} from part",
    "graph_events": f"select concat('event:', cast(o_orderkey as varchar(20))) as fact_id, concat('order_', lower(o_orderstatus)) as event_type, substr(cast(o_orderdate as varchar(30)), 1, 10) as occurred_at, concat('customer:', cast(o_custkey as varchar(20))) as entity_id, cast(o_orderkey as bigint) as ev, {_v('o_orderkey')} from orders",
    "facts": """select fact_id, 'relation' as kind, ev, created, valid_from, valid_until, status from relations
      union all select fact_id, 'claim', ev, created, valid_from, valid_until, status from claims
      union all select fact_id, 'event', ev, created, valid_from, valid_until, status from graph_events""",
    # facts are supported by documents of the whole table, two each
    "fact_evidence": "select fact_id, pos, concat('doc:', cast((ev * 31 + pos * 7) % n_docs as varchar(20))) as evidence_id from facts cross join (select 0 as pos union all select 1) two cross join (select count(*) as n_docs from documents) n",
}
_USES = {"facts": ["relations", "claims", "graph_events"], "fact_evidence": ["facts"]}
_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the session has cores, dealt out to all of them; any larger one as it is.

    A small table is often one file with one row group, and would leave all work on its rows to one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def by_keys(df: DataFrame) -> DataFrame:
    """A side of a join that meets the other by its keys, and is never collected to be sent to all tasks.

    Spark guesses a projection's size by its parquet bytes, of which the rows that are made of them may be a hundred
    times, and a join that it plans as a broadcast stays one whatever its side turns out to be. So it is for sides that
    grow with the tables, not for what is small by construction."""
    return df.hint("merge")


_tables: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its plan (schema and file listing, no rows) is made once a session, as the tables never change."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}")
    if key not in _tables:
        _tables[key] = _open(spark, sf_dir, name)
    return _tables[key]


def _open(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in ("region", "nation"):
        df = spread(df)
    for c, kind in df.dtypes:  # zone-less times become instants of the session's zone (UTC)
        if kind == "timestamp_ntz":
            df = df.withColumn(c, df[c].cast("timestamp"))
    return df


def view(spark: SparkSession, sf_dir: str, name: str, views: dict[str, str] | None = None, uses: dict[str, list[str]] | None = None) -> DataFrame:
    """A model view, or a driver table, as a DataFrame."""
    import re

    views, uses = VIEWS | (views or {}), _USES | (uses or {})
    if name not in views:
        return table(spark, sf_dir, name)
    sql = views[name]
    needed = {t for t in [*_TABLES, *views] if t != name and re.search(rf"\b(from|join) {t}\b", sql)}
    large = {t for t in needed & views.keys() if re.search(rf"(?<!cross )\bjoin {t}\b", sql)}
    parts = {t: view(spark, sf_dir, t, views, uses) for t in needed}
    return spark.sql(re.sub(r"\b(from|join) (" + "|".join(sorted(needed, key=len, reverse=True)) + r")\b", r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}")), **{t: by_keys(df) if t in large else df for t, df in parts.items()})


def with_views(sql: str, *names: str, views: dict[str, str] | None = None) -> str:
    """sql for the oracle, with the named views (and those under them) as common table expressions."""
    import re

    every = VIEWS | (views or {})
    order: list[str] = []

    def add(n: str) -> None:
        for t in every:
            if t != n and re.search(rf"\b(from|join) {t}\b", every[n]):
                add(t)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql.strip()
    head = ", ".join(f"{n} as ({every[n]})" for n in order)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {head}, {body[5:]}"
    return f"with {head} {body}"
