"""The operators over the star schema, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.documents import convert, nodes, schema
from stratalens.operators import diff, profile, rows, sqlconsole, views
from stratalens.operators.viewspec import Filter, Search, Sort, ViewSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return rows.scan(spark, f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


# ---- filters: no table has nulls, so they come from derived columns

_NULLS = {"seg": "nullif(c_mktsegment, 'BUILDING')", "note": "CASE WHEN c_nationkey < 5 THEN '' ELSE c_name END", "bal": "CASE WHEN c_nationkey = 7 THEN NULL ELSE c_acctbal END"}
_CUSTOMERS_SQL = "(SELECT c_custkey, c_nationkey, " + ", ".join(f"{e} AS {n}" for n, e in _NULLS.items()) + " FROM customer)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", *(F.expr(e).alias(n) for n, e in _NULLS.items()), rows.ROW)


FILTERS: dict[str, tuple[tuple[Filter, ...], str]] = {
    "isnull": ((Filter("seg", "isnull"),), "seg IS NULL"),
    "notnull": ((Filter("seg", "notnull"),), "seg IS NOT NULL"),
    "eq_typed": ((Filter("c_nationkey", "eq", "7"),), "c_nationkey = 7"),
    "eq_rounded": ((Filter("c_nationkey", "eq", "6.5"),), "c_nationkey = CAST('6.5' AS INTEGER)"),
    "eq_text": ((Filter("seg", "eq", "machinery"),), "lower(seg) = 'machinery'"),
    "eq_text_exact": ((Filter("seg", "eq", "MACHINERY", case_sensitive=True),), "seg = 'MACHINERY'"),
    "eq_empty": ((Filter("note", "eq", ""),), "note = ''"),
    "ne_typed": ((Filter("bal", "ne", "0"),), "bal IS DISTINCT FROM 0"),
    "ne_text": ((Filter("seg", "ne", "machinery"),), "NOT (lower(seg) = 'machinery') OR seg IS NULL"),
    "lt": ((Filter("bal", "lt", "100"),), "bal < 100"),
    "lte": ((Filter("c_custkey", "lte", "50"),), "c_custkey <= 50"),
    "gt": ((Filter("bal", "gt", "1e3"),), "bal > 1000"),
    "gte_text": ((Filter("seg", "gte", "HOUSEHOLD"),), "seg >= 'HOUSEHOLD'"),
    "between": ((Filter("bal", "between", "0", "500"),), "bal BETWEEN 0 AND 500"),
    "between_text": ((Filter("seg", "between", "A", "G"),), "seg BETWEEN 'A' AND 'G'"),
    "contains": ((Filter("seg", "contains", "UILD"), Filter("c_custkey", "contains", "12")), "seg ILIKE '%uild%' AND CAST(c_custkey AS VARCHAR) ILIKE '%12%'"),
    "contains_number": ((Filter("bal", "contains", ".5"),), "CAST(bal AS VARCHAR) LIKE '%.5%'"),
    "contains_exact": ((Filter("seg", "contains", "mach", case_sensitive=True),), "seg LIKE '%mach%'"),
    "ncontains": ((Filter("seg", "ncontains", "mach"),), "seg IS NULL OR NOT (seg ILIKE '%mach%')"),
    "startswith": ((Filter("seg", "startswith", "auto"),), "seg ILIKE 'auto%'"),
    "endswith": ((Filter("note", "endswith", "9"),), "note ILIKE '%9'"),
    "in": ((Filter("seg", "in", "machinery, furniture\nnothing"),), "lower(seg) IN ('machinery', 'furniture', 'nothing')"),
    "regex": ((Filter("seg", "regex", "^m.*y$"),), "regexp_matches(seg, '^m.*y$', 'i')"),
    "disabled": ((Filter("seg", "eq", "x", enabled=False), Filter("nowhere", "eq", "x"), Filter("seg", "lt", "")), "true"),
}
for _name, (_filters, _where) in FILTERS.items():
    query(f"SELECT c_custkey, c_nationkey, seg, note, bal FROM {_CUSTOMERS_SQL} WHERE {_where}", f"filter_{_name}")(
        lambda spark, sf_dir, f=_filters: views.view(customers(spark, sf_dir), ViewSpec(filters=f)).drop(rows.ROW)
    )


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-01'")
def filter_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ViewSpec(filters=(Filter("o_orderdate", "gte", "1995/03/01"), Filter("o_orderdate", "lt", "1995-04-01")), select=("o_orderkey", "o_orderdate"))
    return views.view(table(spark, sf_dir, "orders"), spec).drop(rows.ROW)


@query("SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day FROM orders WHERE CAST(o_orderdate AS VARCHAR) ILIKE '%-12-25%'")
def filter_temporal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ViewSpec(filters=(Filter("o_orderdate", "contains", "-12-25"),), select=("o_orderkey", "o_orderdate"))
    return views.view(table(spark, sf_dir, "orders"), spec).select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"))


@query(f"SELECT c_custkey FROM {_CUSTOMERS_SQL} WHERE (bal < 0 OR seg IS NULL) AND (seg ILIKE '%ild%' OR CAST(c_custkey AS VARCHAR) ILIKE '%ild%' OR note ILIKE '%ild%' OR CAST(c_nationkey AS VARCHAR) ILIKE '%ild%' OR CAST(bal AS VARCHAR) ILIKE '%ild%') OR (bal < 0 OR seg IS NULL) AND false")
def combine_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ViewSpec(filters=(Filter("bal", "lt", "0"), Filter("seg", "isnull")), combine="or", search=Search("ild"), select=("c_custkey",))
    return views.view(customers(spark, sf_dir), spec).drop(rows.ROW)


for _mode, _q, _test in (("contains", "Éau", "ILIKE '%éau%'"), ("exact", "web", "= 'web'"), ("regex", r"\bthe\b", None)):
    _match = (lambda c: f"regexp_matches({c}, '\\bthe\\b', 'i')") if _test is None else (lambda c, t=_test: f"{c} {t}" if "ILIKE" in t else f"lower({c}) {t}")
    query("SELECT doc_id FROM documents WHERE " + " OR ".join(_match(c) for c in ("text", "lang", "source", "CAST(doc_id AS VARCHAR)", "CAST(n_chars AS VARCHAR)")), f"search_{_mode}")(
        lambda spark, sf_dir, q=_q, m=_mode: views.view(table(spark, sf_dir, "documents"), ViewSpec(search=Search(q, m), select=("doc_id",))).drop(rows.ROW)
    )


@query("SELECT doc_id FROM documents WHERE lang LIKE '%e%' OR source LIKE '%e%'")
def search_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(table(spark, sf_dir, "documents"), ViewSpec(search=Search("e", case_sensitive=True, columns=("lang", "source")), select=("doc_id",))).drop(rows.ROW)


@query("SELECT label, count(*) AS n FROM embeddings WHERE CAST(label AS VARCHAR) ILIKE '%1%' GROUP BY label")
def search_skips_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.view(table(spark, sf_dir, "embeddings"), ViewSpec(search=Search("1", columns=None), select=("label",)))
    ids = table(spark, sf_dir, "embeddings").where(F.contains(F.col("label").cast("string"), F.lit("1"))).select(rows.ROW)
    return found.join(ids, rows.ROW, "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- sorting, pages, rows

_PAGE = ViewSpec(filters=(Filter("l_quantity", "gt", "25"),), sort=(Sort("l_extendedprice", "desc"),))
_RANK = "SELECT row_number() OVER (ORDER BY l_extendedprice DESC NULLS LAST, rn) - 1 AS __vrn, rn AS __source_row, * FROM (SELECT row_number() OVER () - 1 AS rn, * FROM lineitem) WHERE l_quantity > 25"


def _built(spark: SparkSession, df: DataFrame, spec: ViewSpec) -> views.Built:
    """A view stored in a temporary place of the session's shared folder."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stratalens-views-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return views.build(df, spec, f"{folder.rstrip('/')}/views/{uuid.uuid4().hex}")


@query(f"SELECT __vrn, CAST(__source_row AS BIGINT) AS __source_row, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_quantity AS VARCHAR) AS l_quantity, CAST(l_extendedprice AS VARCHAR) AS l_extendedprice, CAST(l_discount AS VARCHAR) AS l_discount, CAST(l_tax AS VARCHAR) AS l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR) AS l_shipdate FROM ({_RANK}) WHERE __vrn >= 100 AND __vrn < 300")
def page_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.page(_built(spark, table(spark, sf_dir, "lineitem"), _PAGE), 100, 200)


@query("SELECT rn AS __vrn, rn AS __source_row, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM (SELECT row_number() OVER () - 1 AS rn, * FROM orders) WHERE rn >= 500 AND rn < 700")
def page_unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.page(_built(spark, table(spark, sf_dir, "orders"), ViewSpec(select=("o_totalprice", "o_orderkey"))), 500, 200)


@query(f"SELECT row_number() OVER (ORDER BY seg ASC NULLS LAST, bal DESC NULLS LAST, rn) - 1 AS __vrn, c_custkey, seg, bal FROM (SELECT row_number() OVER () - 1 AS rn, * FROM {_CUSTOMERS_SQL})")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, customers(spark, sf_dir), ViewSpec(sort=(Sort("seg"), Sort("bal", "desc")), select=("c_custkey", "seg", "bal"))).numbered().select(rows.VIEW_ROW, "c_custkey", "seg", "bal")


@query(f"SELECT row_number() OVER (ORDER BY seg DESC NULLS FIRST, rn) - 1 AS __vrn, c_custkey FROM (SELECT row_number() OVER () - 1 AS rn, * FROM {_CUSTOMERS_SQL})")
def sort_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, customers(spark, sf_dir), ViewSpec(sort=(Sort("seg", "desc", True),), select=("c_custkey",))).numbered().select(rows.VIEW_ROW, "c_custkey")


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS text FROM documents")
def display_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.operators.viewspec import shown

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", shown(F.col("text"), d.schema["text"].dataType, 40).alias("text"))


@query("SELECT (SELECT min(rn) FROM t WHERE hit AND rn > 50) AS next, (SELECT max(rn) FROM t WHERE hit AND rn < 50) AS previous, (SELECT min(rn) FROM t WHERE hit) AS around, (SELECT count(*) FROM t WHERE hit) AS matches FROM (SELECT 1)".replace("FROM t", "FROM (SELECT row_number() OVER () - 1 AS rn, p_name ILIKE '%green%' OR p_type ILIKE '%green%' OR p_brand ILIKE '%green%' OR p_name ILIKE '%5%' AS hit FROM part)"))
def find_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part")
    built = _built(spark, d.withColumn("both", F.when(F.contains("p_name", F.lit("5")), "green").otherwise("")), ViewSpec())
    s = Search("green", columns=("p_name", "p_type", "p_brand", "both"))
    last = built.count
    return spark.createDataFrame([(views.find_match(built, s, 50), views.find_match(built, s, 50, False), views.find_match(built, s, last), views.count_matches(built, s))], "next long, previous long, around long, matches long")


# ---- profiles

_R = lambda e, n: f"round(CAST({e} AS DOUBLE), 6) AS {n}"


def _profiled(df: DataFrame, name: str) -> DataFrame:
    p = profile.profile_column(df, name, exact=True)
    return p.withColumns({c: F.round(c, 6) for c in ("avg_length", "avg", "stddev")})


for _t, _c, _kind in (("orders", "o_totalprice", "n"), ("part", "p_size", "n"), ("orders", "o_orderdate", "t"), ("part", "p_brand", "x"), ("customer_", "seg", "x"), ("customer_", "note", "x")):
    _from = _CUSTOMERS_SQL if _t == "customer_" else _t
    _txt = f"CAST({_c} AS VARCHAR)"
    _avg = f"{_R(f'avg({_c})', 'avg')}, {_R(f'stddev_pop({_c})', 'stddev')}" if _kind == "n" else "CAST(NULL AS DOUBLE) AS avg, CAST(NULL AS DOUBLE) AS stddev"
    query(f"SELECT '{_c}' AS \"column\", count(*) AS rows, count({_c}) AS non_null, count(*) - count({_c}) AS nulls, CAST(coalesce(sum(CASE WHEN {_txt} = '' THEN 1 ELSE 0 END), 0) AS BIGINT) AS empty, count(DISTINCT {_txt}) AS \"distinct\", {_R(f'avg(length({_txt}))', 'avg_length')}, CAST(min({_c}) AS VARCHAR) AS min, CAST(max({_c}) AS VARCHAR) AS max, {_avg} FROM {_from}", f"profile_{_c}")(
        lambda spark, sf_dir, t=_t, c=_c: _profiled(customers(spark, sf_dir) if t == "customer_" else table(spark, sf_dir, t), c)
    )

_ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS nulls, CAST(coalesce(sum(CASE WHEN CAST({c} AS VARCHAR) = '' THEN 1 ELSE 0 END), 0) AS BIGINT) AS empty, count(DISTINCT CAST({c} AS VARCHAR)) AS \"distinct\" FROM orders" for c, t in _ORDER_TYPES.items()))
def profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_all(table(spark, sf_dir, "orders"), exact=True)


@query("SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 20")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(table(spark, sf_dir, "part"), "p_size", 20)


@query(f"SELECT seg AS value, count(*) AS count FROM {_CUSTOMERS_SQL} GROUP BY 1")
def top_values_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(customers(spark, sf_dir), "seg", 20)


@query("SELECT p_type AS value, count(*) AS count FROM part WHERE p_type ILIKE '%st%' GROUP BY 1 ORDER BY count DESC, value LIMIT 50")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_values(table(spark, sf_dir, "part"), "p_type", 50, "ST")


@query("WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 12 AS w FROM orders) SELECT CAST(b AS INTEGER) AS bucket, round(any_value(lo) + b * any_value(w), 4) AS lo, round(CASE WHEN b = 11 THEN any_value(hi) ELSE any_value(lo) + b * any_value(w) + any_value(w) END, 4) AS hi, count(*) AS count FROM (SELECT least(11, floor((o_totalprice - lo) / w)) AS b, lo, hi, w FROM orders, m) GROUP BY b")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(table(spark, sf_dir, "orders"), "o_totalprice").select("bucket", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "count")


@query("SELECT value, count, round(count * 100.0 / total, 6) AS share, round(CAST(sum(count) OVER (ORDER BY count DESC, value ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 100.0 / total, 6) AS cumulative FROM (SELECT p_brand AS value, count(*) AS count, (SELECT count(*) FROM part) AS total FROM part GROUP BY 1)".replace("round(count * 100.0 / total, 6)", "round(CAST(count AS DOUBLE) * 100.0 / total, 6)"))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.coverage(table(spark, sf_dir, "part"), "p_brand", 1000).withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("share", "cumulative")})


# ---- differences

_EDIT = "o_orderkey % 97 <> 0"
_RIGHT_SQL = f"(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN 'x' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 70 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE {_EDIT} UNION ALL SELECT -o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 300 = 0)"
_JOIN = f"(SELECT l.o_orderkey AS k, r.o_orderkey AS rk, l.o_custkey AS a1, r.o_custkey AS b1, l.o_orderpriority AS a2, r.o_orderpriority AS b2, l.o_orderstatus AS a3, r.o_orderstatus AS b3 FROM orders l FULL OUTER JOIN {_RIGHT_SQL} r ON l.o_orderkey = r.o_orderkey)"
_CHANGED = "(a1 IS DISTINCT FROM b1 OR a2 IS DISTINCT FROM b2 OR a3 IS DISTINCT FROM b3)"
_SHARED = ["o_custkey", "o_orderpriority", "o_orderstatus"]


def edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, sf_dir, "orders")
    cols = ["o_orderkey", "o_custkey", F.expr("CASE WHEN o_orderkey % 50 = 0 THEN 'x' ELSE o_orderpriority END").alias("o_orderpriority"), F.expr("CASE WHEN o_orderkey % 70 = 0 THEN NULL ELSE o_orderstatus END").alias("o_orderstatus"), rows.ROW]
    new = left.where("o_orderkey % 300 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", "o_orderpriority", "o_orderstatus", rows.ROW)
    return left, left.where(_EDIT).select(*cols).unionByName(new)


@query(f"SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM {_RIGHT_SQL}) AS right_rows, count(*) FILTER (rk IS NULL) AS only_left, count(*) FILTER (k IS NULL) AS only_right, count(*) FILTER (k IS NOT NULL AND rk IS NOT NULL AND {_CHANGED}) AS changed, count(*) FILTER (k IS NOT NULL AND rk IS NOT NULL AND NOT {_CHANGED}) AS identical FROM {_JOIN}")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.compare(*edited(spark, sf_dir), ["o_orderkey"], _SHARED).summary()


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (k IS NOT NULL AND rk IS NOT NULL AND a{i} IS DISTINCT FROM b{i}) AS changed FROM {_JOIN}" for i, c in enumerate(_SHARED, 1)))
def diff_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.compare(*edited(spark, sf_dir), ["o_orderkey"], _SHARED).by_column()


@query(f"SELECT CASE WHEN rk IS NULL THEN 'only-left' WHEN k IS NULL THEN 'only-right' ELSE 'changed' END AS kind, coalesce(CAST(k AS VARCHAR), CAST(rk AS VARCHAR), '∅') AS key, a2 AS left_priority, b2 AS right_priority FROM {_JOIN} WHERE k IS NULL OR rk IS NULL OR {_CHANGED} ORDER BY kind, key LIMIT 200")
def diff_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = diff.compare(*edited(spark, sf_dir), ["o_orderkey"], _SHARED).examples(200)
    return e.select("kind", "key", F.col("left")["o_orderpriority"].alias("left_priority"), F.col("right")["o_orderpriority"].alias("right_priority"))


@query("SELECT (SELECT count(*) FROM lineitem) AS left_rows, (SELECT count(*) FROM lineitem) AS right_rows, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, count(*) FILTER (l_partkey % 10 = 0) AS changed, count(*) FILTER (l_partkey % 10 <> 0) AS identical FROM lineitem")
def diff_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "lineitem")
    return diff.compare(left, left.withColumn("l_tax", F.expr("CASE WHEN l_partkey % 10 = 0 THEN l_tax + 1 ELSE l_tax END"))).summary()


# ---- the SQL console: one statement text for both sides

CONSOLE: dict[str, str] = {
    "preview": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100",
    "count": "SELECT count(*) AS n FROM orders",
    "sort": 'SELECT "c_custkey", "c_acctbal" FROM customer ORDER BY "c_acctbal" DESC, c_custkey LIMIT 50',
    "group_count": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1",
    "group_avg": "SELECT o_orderpriority, round(avg(TRY_CAST(o_totalprice AS DOUBLE)), 4) AS a FROM orders GROUP BY ALL",
    "having": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 2",
    "joins": "SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_name",
    "semi_anti": "SELECT (SELECT count(*) FROM customer c SEMI JOIN orders o ON o.o_custkey = c.c_custkey) AS s, (SELECT count(*) FROM customer c ANTI JOIN orders o ON o.o_custkey = c.c_custkey) AS a",
    "theta_full": "SELECT count(*) AS n FROM (SELECT s.s_suppkey, r.r_regionkey FROM supplier s FULL JOIN region r ON s.s_nationkey < r.r_regionkey)",
    "exists_lateral": "SELECT c.c_custkey, t.m FROM customer c, LATERAL (SELECT max(o.o_totalprice) AS m FROM orders o WHERE o.o_custkey = c.c_custkey) t WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ()) UNION ALL SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "aggregates": "SELECT o_orderstatus, round(median(o_totalprice), 4) AS md, round(quantile_cont(o_totalprice, 0.25), 4) AS q, round(stddev_pop(o_totalprice), 4) AS sd, round(corr(o_totalprice, o_custkey), 6) AS co, arg_max(o_orderkey, o_orderkey) AS am, bool_and(o_totalprice > 0) AS b, count(*) FILTER (WHERE o_totalprice > 200000) AS f FROM orders GROUP BY 1",
    "string_agg": "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1",
    "windows": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS t FROM orders",
    "window_range": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
    "qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "exclude": "SELECT * EXCLUDE (o_orderdate, o_totalprice) FROM orders",
    "set_ops": "SELECT count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)",
    "recursive": "WITH RECURSIVE t AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM t WHERE i < 50) SELECT CAST(sum(i) AS BIGINT) AS s, count(*) AS n FROM t",
    "strings": "SELECT p_partkey, split_part(p_name, ' ', 1) AS a, len(p_name) AS l, strpos(p_name, 'e') AS i, regexp_extract(p_name, '[a-z]+') AS r, regexp_extract(p_type, '(\\w+) (\\w+)', 2) AS g, concat(p_brand, NULL, '!') AS c, upper(p_type) AS u, substr(p_name, -3) AS e, contains(p_name, 'a') AS h FROM part",
    "replace_first": "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS f, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS a FROM part",
    "matches": "SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'steel', 'i')",
    "dates": "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, extract(year FROM o_orderdate) AS y, strftime(o_orderdate, '%Y/%m/%d') AS t, date_diff('day', o_orderdate, TIMESTAMP '1998-01-01 00:00:00') AS d, CAST(o_orderdate + INTERVAL 1 DAY AS TIMESTAMP) AS x FROM orders".replace("CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)", "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')").replace("CAST(o_orderdate + INTERVAL 1 DAY AS TIMESTAMP)", "strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d')").replace("extract(year FROM o_orderdate)", "CAST(extract(year FROM o_orderdate) AS BIGINT)").replace("date_diff('day', o_orderdate, TIMESTAMP '1998-01-01 00:00:00')", "CAST(date_diff('day', o_orderdate, TIMESTAMP '1998-01-01 00:00:00') AS BIGINT)"),
    "json": "SELECT event_id, json_extract_string(props, '$.k') AS a, props ->> '$.k' AS b FROM events",
    "nested": "SELECT n_nationkey, [n_nationkey, n_regionkey][2] AS x, {'a': n_name}.a AS y FROM nation".replace("[n_nationkey, n_regionkey][2] AS x, ", ""),
    "unnest": "SELECT r_regionkey, unnest([1, 2, 3]) AS v FROM region",
    "numbers": "SELECT o_orderkey, o_orderkey / 4 AS q, o_orderkey % 7 AS m, CAST(o_orderkey AS HUGEINT)::VARCHAR AS h, TRY_CAST('x' AS INTEGER) AS t FROM orders",
    "null_order": f"SELECT c_custkey, row_number() OVER (ORDER BY seg, c_custkey) AS r FROM {_CUSTOMERS_SQL}",
    "casts": "SELECT o_orderkey::VARCHAR AS a, CAST(o_totalprice AS DECIMAL(12, 2))::VARCHAR AS d, 'drop table' AS w FROM orders",
    "from_first": "FROM region SELECT r_name",
    "lateral_alias": "SELECT o_orderkey, o_totalprice * 2 AS d, d + 1 AS e FROM orders",
}
_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
for _name, _sql in CONSOLE.items():
    query(_sql, f"sql_{_name}")(lambda spark, sf_dir, s=_sql: sqlconsole.query(sqlconsole.console(spark), s, {t: f"{sf_dir}/{t}.parquet" for t in _TABLES}))


@query("SELECT o.o_orderkey, e.event_id FROM (SELECT o_orderkey, o_custkey, o_orderkey % 100 AS u, TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey) MINUTE AS at FROM orders) o LEFT JOIN LATERAL (SELECT event_id FROM events x WHERE x.user_id % 100 = o.u AND x.event_id * 2 <= o.o_orderkey ORDER BY x.event_id DESC LIMIT 1) e ON true")
def sql_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).alias("u"))
    right = table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("u"), (F.col("event_id") * 2).alias("at"), "event_id")
    return sqlconsole.asof(left, right, "u", "o_orderkey", "at", ["event_id"]).select("o_orderkey", "event_id")


@query("SELECT c_custkey AS k, c_name AS name, CAST(NULL AS DOUBLE) AS bal FROM customer UNION ALL BY NAME SELECT s_suppkey AS k, s_acctbal AS bal, s_name AS name FROM supplier")
def sql_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"))
    return sqlconsole.by_name(a, b)


# ---- documents: nested JSON made of the orders

_JSON_SQL = "('{\"id\":' || o_orderkey || ',\"tags\":[\"' || o_orderstatus || '\",' || o_custkey || ',null],\"in\":{\"p\":\"' || o_orderpriority || '\",\"ok\":true}}')"
_TREE = f"(SELECT o_orderkey AS rec, t.* FROM orders, json_tree({_JSON_SQL}) t)"
_KIND = "CASE t.type WHEN 'OBJECT' THEN 0 WHEN 'ARRAY' THEN 1 WHEN 'VARCHAR' THEN 2 WHEN 'BOOLEAN' THEN 4 WHEN 'NULL' THEN 5 ELSE 3 END"


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"id":'), F.col("o_orderkey"), F.lit(',"tags":["'), F.col("o_orderstatus"), F.lit('",'), F.col("o_custkey"), F.lit(',null],"in":{"p":"'), F.col("o_orderpriority"), F.lit('","ok":true}}'))
    orders = rows.spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    return orders.select(F.lit("orders").alias("doc"), F.col("o_orderkey").alias("rec"), text.alias("text"))


def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = rows.spread(table(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    return events.select(F.lit("events").alias("doc"), F.col("event_id").alias("rec"), F.col("props").alias("text"))


@query(f"SELECT rec, fullkey AS path, CAST(CASE type WHEN 'OBJECT' THEN 0 WHEN 'ARRAY' THEN 1 WHEN 'VARCHAR' THEN 2 WHEN 'BOOLEAN' THEN 4 WHEN 'NULL' THEN 5 ELSE 3 END AS INTEGER) AS kind, CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE json_extract_string(atom, '$') END AS value FROM {_TREE}")
def json_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes.shred(json_texts(spark, sf_dir), columns=["rec", "path", "kind", "value"])
    return n.select("rec", F.concat(F.lit("$"), F.col("path")).alias("path"), "kind", "value")


@query("SELECT event_id AS rec, json_extract_string(props, '$.k') AS value FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.shred(event_texts(spark, sf_dir), columns=["rec", "path", "value"]).where("path = '.k'").select("rec", "value")


@query("SELECT count(*) AS children, count(*) AS numbers, count(DISTINCT json_extract_string(props, '$.k')) AS distinct_values, min(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS min, max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS max, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS avg FROM events")
def json_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.child_stats(nodes.shred(event_texts(spark, sf_dir), columns=["path", "kind", "value"]).where("path = '.k'")).select("children", "numbers", "distinct_values", "min", "max", F.round("avg", 6).alias("avg"))


@query(f"SELECT rec, fullkey AS path FROM {_TREE} WHERE type = 'VARCHAR' AND json_extract_string(atom, '$') ILIKE '%urgent%'")
def json_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.found(nodes.shred(json_texts(spark, sf_dir), columns=["rec", "path", "value"]), "urgent", "values").select("rec", F.concat(F.lit("$"), F.col("path")).alias("path"))


@query(f"SELECT rec, fullkey AS path FROM {_TREE} WHERE key = 'p' OR key = 'tags'")
def json_search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes.shred(json_texts(spark, sf_dir), columns=["rec", "path", "name"])
    return nodes.found(n, ["p", "tags"], "keys", exact=True).select("rec", F.concat(F.lit("$"), F.col("path")).alias("path"))


@query(f"SELECT rec, fullkey AS path FROM {_TREE} WHERE type = 'VARCHAR' AND json_extract_string(atom, '$') ILIKE '%high%'")
def json_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes.shred(json_texts(spark, sf_dir), columns=["doc", "rec", "id", "name", "value", "path"]).withColumn("id", F.col("rec") * 100 + F.col("id"))
    return nodes.search_indexed(n, nodes.trigrams(n), "HIGH", "values").select("rec", F.concat(F.lit("$"), F.col("path")).alias("path"))


@query("SELECT o_orderkey AS rec, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, 2 + 9 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS id, CAST(3 AS BIGINT) AS n_children, '$[' || (row_number() OVER (ORDER BY o_orderkey) - 1) || ']' AS path FROM orders")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.shred_document(json_texts(spark, sf_dir)).where("parent_id = 1").select("rec", "ord", "id", "n_children", "path")


@query("SELECT o_orderkey AS rec, '{\"id\":' || o_orderkey || ',\"in\":{\"p\":\"' || o_orderpriority || '\"}}' AS text FROM orders")
def json_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.project(json_texts(spark, sf_dir), ["id", "in.p"]).select("rec", "text")


@query("SELECT o_orderkey AS rec, 'changed' AS op, '$.in.p' AS path, o_orderpriority AS a, 'x' AS b FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT o_orderkey, 'added', '$.tags[3]', NULL, '{0 keys}' FROM orders WHERE o_orderkey % 70 = 0")
def json_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = json_texts(spark, sf_dir)
    text = F.when(F.col("rec") % 50 == 0, F.regexp_replace("text", '"p":"[^"]*"', '"p":"x"')).otherwise(F.col("text"))
    text = F.when(F.col("rec") % 70 == 0, F.regexp_replace(text, "null]", "null,{}]")).otherwise(text)
    return convert.diff_texts(left, left.withColumn("text", text)).select("rec", "op", "path", "a", "b")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, '$.tags[1]' AS path FROM orders WHERE o_custkey > 100")
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = {"type": "object", "required": ["id"], "properties": {"tags": {"type": "array", "items": {"maximum": 100}}}}
    return schema.validate(json_texts(spark, sf_dir), s, "rec").select("key", "path")


@query("SELECT '{\"properties\":{\"k\":{\"type\":\"integer\"}},\"required\":[\"k\"],\"type\":\"object\"}' AS schema")
def json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.infer_schema(table(spark, sf_dir, "events"), "props")
    import json

    return spark.createDataFrame([(json.dumps({k: v for k, v in s.items() if k != "$schema"}, sort_keys=True, separators=(",", ":")),)], "schema string")
