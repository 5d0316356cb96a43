"""Registry of the queries on the reference's operators and of their DuckDB SQL. Every query reads its whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates
from .functions.columns import md5fold, number, quoted
from .operators import candidates, experiments, families, meta, metrics, models, pairs, prepare, profile, verdicts
from .operators.transforms import Step, apply, fit, fit_and_apply
from .plans import collect, recommend
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Views of the tables, in expressions that both engines understand.
ITEMS = ["l_quantity AS quantity", "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS gap", "l_extendedprice AS price", "l_discount AS discount", "nullif(l_tax, 0.0) AS tax", "l_returnflag AS flag", "l_linestatus AS status", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label"]
ORDERS = ["o_orderkey AS key", "o_custkey AS customer", "o_totalprice AS total", "o_orderstatus AS status", "o_orderpriority AS priority", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label"]
SCORED = ["CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label", "round(l_extendedprice / 120000.0, 2) AS score", "CASE WHEN l_extendedprice / 120000.0 >= 0.5 THEN 1 ELSE 0 END AS prediction"]
NUM, CAT = ["quantity", "gap", "price", "discount", "tax"], ["flag", "status"]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new one in /tmp in local mode, an error on a cluster."""
    if path := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _items(spark, d):
    return _table(spark, d, "lineitem").selectExpr(*ITEMS)


def _orders(spark, d):
    return _table(spark, d, "orders").selectExpr(*ORDERS)


def _scored(spark, d):
    return _table(spark, d, "lineitem").selectExpr(*SCORED)


def _users(spark, d):
    return _table(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_nationkey AS nation", "c_acctbal AS balance", "c_mktsegment AS segment")


SQL_ITEMS = f"items AS (SELECT {', '.join(ITEMS)} FROM lineitem)"
SQL_ORDERS = f"ords AS (SELECT {', '.join(ORDERS)} FROM orders)"
SQL_SCORED = f"scored AS (SELECT {', '.join(SCORED)} FROM lineitem)"
SQL_FOLD = "('0x' || substr(md5({k}), 1, 8))::bigint % {n}"
FOLD = SQL_FOLD.format(k="key::varchar", n=5)


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__.strip("_")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def _each(columns: list[str], sql: str) -> str:
    return " UNION ALL ".join(sql.format(c=c) for c in columns)


def _r(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """df with its doubles rounded, as the SQL does; own: digits of single columns."""
    return df.select(*(F.round(quoted(c), own.get(c, digits)).alias(c) if t == "double" else quoted(c) for c, t in df.dtypes))


# --- preparation ---


@query(f"WITH {SQL_ORDERS} SELECT key, (dense_rank() OVER (ORDER BY priority) - 1)::double AS code FROM ords")
def encode_target(spark, d):
    return prepare.encode_target(_orders(spark, d), "priority", "code").select("key", "code")


@query(f"WITH {SQL_ORDERS}, n AS (SELECT customer, count(*) AS c FROM ords GROUP BY 1) SELECT key, customer FROM ords WHERE customer IN (SELECT customer FROM n WHERE c >= 16)")
def filter_rare_classes(spark, d):
    return prepare.filter_rare_classes(_orders(spark, d), "customer", 5, 3).select("key", "customer")


@query(f"WITH {SQL_ITEMS}, n AS (SELECT label, count(*) AS c FROM items GROUP BY 1) SELECT CASE WHEN count(*) = 2 THEN max(c) / min(c) ELSE 1.0 END AS scale_pos_weight FROM n")
def scale_pos_weight(spark, d):
    return prepare.scale_pos_weight(_items(spark, d), "label")


@query(f"WITH {SQL_ITEMS}, n AS (SELECT flag, count(*) AS n FROM items GROUP BY 1) SELECT flag, n, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM n")
def class_weights(spark, d):
    return prepare.class_weights(_items(spark, d), "flag")


@query(f"WITH {SQL_ORDERS} SELECT key, {FOLD} = 4 AS is_test FROM ords")
def stratified_split(spark, d):
    return prepare.stratified_split(_orders(spark, d), "status", "key").select("key", "is_test")


@query(f"WITH {SQL_ORDERS}, r AS (SELECT key, row_number() OVER (PARTITION BY priority ORDER BY md5(key::varchar), key) AS k, count(*) OVER (PARTITION BY priority) AS n FROM ords) SELECT key, n >= 2 AND k <= floor(n * 0.2) AS is_test FROM r")
def exact_stratified_split(spark, d):
    return prepare.exact_stratified_split(_orders(spark, d), "priority", "key").select("key", "is_test")


@query(f"""WITH {SQL_ORDERS}, n AS (SELECT priority, count(*) AS n, sum(count(*)) OVER () AS t FROM ords GROUP BY 1), z AS (SELECT *, CASE WHEN t <= least(20000, greatest(2000, t // 10)) THEN t ELSE least(20000, greatest(2000, t // 10)) END AS size FROM n),
    q AS (SELECT priority, n * size // t + (row_number() OVER (ORDER BY (n * size) % t DESC, priority) <= size - sum(n * size // t) OVER ())::int AS quota FROM z)
    SELECT key, priority FROM (SELECT key, priority, quota, row_number() OVER (PARTITION BY priority ORDER BY md5(key::varchar), key) AS k FROM ords JOIN q USING (priority)) AS r WHERE k <= quota""")
def quick_sample(spark, d):
    return prepare.quick_sample(_orders(spark, d), "priority", "key").select("key", "priority")


@query(f"WITH {SQL_ORDERS} SELECT key FROM ords QUALIFY row_number() OVER (ORDER BY md5(key::varchar), key) <= 3000 // 6")
def capped_cells(spark, d):
    return prepare.cap_cells(_orders(spark, d), "key", 3_000).select("key")


@query(f"WITH {SQL_ORDERS} SELECT key, " + ", ".join(f"({SQL_FOLD.format(k=f"'r{r}:' || key::varchar", n=5)})::int AS fold_{r}" for r in range(3)) + " FROM ords")
def repeated_folds(spark, d):
    return prepare.repeated_folds(_orders(spark, d), "key").select("key", "fold_0", "fold_1", "fold_2")


@query(f"WITH {SQL_ORDERS} SELECT key, ({SQL_FOLD.format(k="'g:' || customer::varchar", n=5)})::int AS fold FROM ords")
def group_folds(spark, d):
    return prepare.group_folds(_orders(spark, d), "customer").select("key", "fold")


@query(f"WITH {SQL_ORDERS} SELECT floor(total / 20)::bigint AS band, count(*) AS n FROM ords WHERE {FOLD} = 4 AND floor(total / 20) NOT IN (SELECT floor(total / 20) FROM ords WHERE {FOLD} <> 4) GROUP BY 1")
def unseen_labels(spark, d):
    df = _orders(spark, d).select(F.floor(F.col("total") / 20).alias("band"), md5fold(F.col("key"), 5).alias("f"))
    return prepare.unseen_labels(df.where("f <> 4"), df.where("f = 4"), "band")


@query(f"WITH {SQL_ORDERS} SELECT key, total, 0.0::double AS discount FROM ords")
def aligned_columns(spark, d):
    return prepare.aligned(_orders(spark, d), ["key", "total", "discount"])[0]


_TASK = "SELECT '{c}' AS target, count(DISTINCT {c}) AS k, count({c}) AS n, coalesce(max({x}), false) AS broken, {num} AS num FROM items"


@query(
    f"WITH {SQL_ITEMS}, s AS (" + " UNION ALL ".join(_TASK.format(c=c, x=f"{c} % 1 <> 0", num="true") for c in [*NUM, "label"]) + " UNION ALL " + " UNION ALL ".join(_TASK.format(c=c, x="false", num="false") for c in CAT) + """)
    SELECT target, CASE WHEN NOT num OR k <= 2 THEN 'classification' WHEN broken AND k > 20 THEN 'regression' WHEN k / n < 0.05 OR (k <= 200 AND k / n < 0.10) THEN 'classification' ELSE 'regression' END AS task FROM s"""
)
def task_types(spark, d):
    return prepare.task_types(_items(spark, d), [*NUM, "label", *CAT])


@query(f"WITH {SQL_ITEMS}, n AS (SELECT flag, count(*) AS c FROM items GROUP BY 1) SELECT sum(c)::bigint AS n_rows, 7 AS n_columns, sum(c) >= 500 AS usable FROM n WHERE c >= 16")
def usable_dataset(spark, d):
    return prepare.usable(_items(spark, d), "flag")


# --- profiling ---

_BASE = "SELECT '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_missing FROM items"


@query(f"WITH {SQL_ITEMS}, s AS ({_each([*NUM, *CAT, 'label'], _BASE)}) SELECT *, round(n_missing / n_rows, 6) AS missing, round(n_unique / n_rows, 6) AS unique_ratio FROM s")
def base_stats(spark, d):
    return _r(profile.base_stats(_items(spark, d)).drop("sample", "numeric"))


@query(f"""WITH items AS (SELECT *, 1 AS one, NULL::varchar AS empty, CASE WHEN l_linenumber = 1 THEN l_tax END AS rare FROM lineitem),
    s AS ({_each(['one', 'empty', 'rare', 'l_linestatus', 'l_shipdate'], _BASE)})
    SELECT "column", 'constant: all missing' AS problem FROM s WHERE n_unique = 0 UNION ALL SELECT "column", 'constant: one value' FROM s WHERE n_unique = 1
    UNION ALL SELECT "column", 'high_missing' FROM s WHERE n_missing > 0.5 * n_rows UNION ALL SELECT "column", 'binary' FROM s WHERE "column" NOT IN ('l_linestatus', 'l_shipdate', 'empty') AND n_unique = 2""")
def simple_problems(spark, d):
    df = _table(spark, d, "lineitem").selectExpr("1 AS one", "cast(NULL AS string) AS empty", "CASE WHEN l_linenumber = 1 THEN l_tax END AS rare", "l_linestatus", "l_shipdate")
    return profile.simple_problems(profile.base_stats(df))


@query("""WITH s AS (SELECT 'text' AS "column", count(text) AS n, count(DISTINCT text) AS n_unique, round(avg(length(text)), 6) AS mean_length FROM documents
    UNION ALL SELECT 'lang', count(lang), count(DISTINCT lang), round(avg(length(lang)), 6) FROM documents UNION ALL SELECT 'source', count(source), count(DISTINCT source), round(avg(length(source)), 6) FROM documents)
    SELECT *, n >= 5 AND mean_length > 30 AND n_unique > 0.1 * n AS is_text FROM s""")
def text_columns(spark, d):
    return _r(profile.text_stats(_table(spark, d, "documents")))


_DATE_SQL = """SELECT '{c}' AS "column", count({c}) AS n, count(t) AS parsed, count(*) FILTER (hour(t) <> 0) AS with_hour, count(DISTINCT t::date) AS n_days FROM (SELECT {c}, {p} AS t FROM src) AS x"""


@query(f"""WITH src AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment, strftime(ts, '%Y-%m-%d') AS day, event_type AS kind FROM events),
    s AS ({_DATE_SQL.format(c='moment', p="try_strptime(moment, '%Y-%m-%d %H:%M:%S')")} UNION ALL {_DATE_SQL.format(c='day', p="try_strptime(day, '%Y-%m-%d')")} UNION ALL {_DATE_SQL.format(c='kind', p="try_strptime(kind, '%Y-%m-%d')")}),
    r AS (SELECT "column", n, parsed / n AS parse_rate, with_hour / greatest(parsed, 1) AS hour_share, n_days FROM s)
    SELECT "column", n, round(parse_rate, 6) AS parse_rate, round(hour_share, 6) AS hour_share, n_days, hour_share >= 0.2 AS has_hour,
    CASE WHEN parse_rate < 0.7 THEN NULL WHEN hour_share >= 0.2 AND n_days < greatest(3, floor(0.02 * n)) THEN 'time' WHEN hour_share >= 0.2 THEN 'datetime' ELSE 'date' END AS kind FROM r""")
def date_columns(spark, d):
    df = _table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("moment"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("kind"))
    return _r(profile.date_stats(df))


#: name, Spark's pattern, and to what DuckDB's original is cut. The last ones mix shapes by row.
_SHAPES = [
    ("micros", "yyyy-MM-dd HH:mm:ss.SSSSSS", "microsecond"), ("iso", "yyyy-MM-dd'T'HH:mm:ss'Z'", "second"), ("zone", "yyyy-MM-dd HH:mm:ss'+02:00'", "second"), ("minutes", "yyyy-MM-dd HH:mm", "minute"), ("slashes", "yyyy/MM/dd", "day"), ("one_digit", "M/d/yyyy", "day"), ("dots", "dd.MM.yyyy", "day"),
    ("short", "d/M/yy HH:mm", "minute"), ("name", "MMM d, yyyy", "day"), ("full_name", "d MMMM yyyy h:mm a", "minute"), ("mail", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "second"), ("digits", "yyyyMMdd", "day"),
]
_DAY_FIRST = ("dots", "short")


@query(
    "WITH src AS (SELECT event_id, ts FROM events), s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS shape, date_trunc('{u}', ts) AS t FROM src" for n, _, u in _SHAPES)
    + " UNION ALL SELECT 'mixed', CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('minute', ts) ELSE NULL END FROM src) SELECT shape, count(t) AS parsed, min(epoch_us(t)) AS first, max(epoch_us(t)) AS last, sum(epoch_us(t) // 1000000)::bigint AS total, shape IN ('dots', 'short') AS day_first FROM s GROUP BY shape"
)
def parsed_dates(spark, d):
    """Dates of the events as text of many shapes, read back; day and month are told apart once for each column."""
    ts = _table(spark, d, "events")
    mixed = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "MMM d, yyyy")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "M/d/yyyy h:mm a")).otherwise(F.lit("no date"))
    df = ts.select(*(F.date_format("ts", f).alias(n) for n, f, _ in _SHAPES), mixed.alias("mixed"))
    texts = dates.counted_texts(df, df.columns).persist()
    try:
        first = F.create_map(*(F.lit(x) for pair in dates.counted_day_first(texts, df.columns).items() for x in pair))[F.col("column")]
        us = F.unix_micros("t")
        long = texts.select(F.col("column").alias("shape"), "n", first.alias("day_first"), dates.parsed_date(F.col("text"), first).alias("t"))
        found = long.groupBy("shape", "day_first").agg(F.sum(F.when(F.col("t").isNotNull(), F.col("n")).otherwise(0)).alias("parsed"), F.min(us).alias("first"), F.max(us).alias("last"), F.sum(F.floor(us / 1_000_000) * F.col("n")).alias("total"))
        return spark.createDataFrame(found.collect(), found.schema)  # a row for each shape
    finally:
        texts.unpersist()


@query("""WITH src AS (SELECT dayname(o_orderdate) AS day, o_orderpriority AS priority FROM orders),
    s AS (SELECT 'day' AS "column", count(day) AS n, avg((lower(day) IN ('monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'))::int) AS recognised FROM src UNION ALL SELECT 'priority', count(priority), 0.0 FROM src)
    SELECT "column", n, recognised, recognised >= 1 AS is_weekday FROM s""")
def weekday_columns(spark, d):
    df = _table(spark, d, "orders").select(F.date_format("o_orderdate", "EEEE").alias("day"), F.col("o_orderpriority").alias("priority"))
    return profile.weekday_stats(df)


@query("""SELECT 'key' AS "column", true AS rising, false AS falling UNION ALL SELECT 'total', false, false UNION ALL
    SELECT 'minus', false, min(lag_ok) FROM (SELECT coalesce(-o_orderkey < lag(-o_orderkey) OVER (ORDER BY o_orderkey), true) AS lag_ok FROM orders) AS x""")
def monotonic_columns(spark, d):
    df = _table(spark, d, "orders").selectExpr("o_orderkey AS key", "o_totalprice AS total", "-o_orderkey AS minus")
    return profile.order_flags(df, ["key", "total", "minus"], "key")


_CV = """SELECT '{c}' AS "column", round(stddev_pop(d) / abs(avg(d)), 6) AS cv FROM (SELECT {c} - lag({c}) OVER (ORDER BY {c}) AS d FROM ords WHERE {c} IS NOT NULL) AS x"""


@query(f"WITH {SQL_ORDERS} {_each(['key', 'total'], _CV)}")
def step_variation(spark, d):
    return _r(profile.step_variation(_orders(spark, d), ["key", "total"]))


@query("""SELECT 'key' AS "column", 'monotonic' AS reason FROM customer HAVING count(DISTINCT c_custkey) = count(*) AND count(*) > 10""")
def id_columns(spark, d):
    return profile.id_columns(_users(spark, d), "key")


_KINDS = "kinds AS (" + " UNION ALL ".join(
    f"""SELECT '{name}' AS "column", CASE WHEN count(DISTINCT {c}) <= 1 THEN 'Constant' WHEN {"true" if name == "key" else "false"} AND count(DISTINCT {c}) = count(*) AND count(*) > 10 THEN 'ID'
        WHEN avg(length({c}::varchar)) > 30 AND count(DISTINCT {c}) > 0.1 * count(*) THEN 'Free Text' WHEN count(DISTINCT {c}) <= 2 THEN 'Binary' ELSE '{kind}' END AS detected FROM customer"""
    for name, c, kind in (("key", "c_custkey", "Numerical"), ("name", "c_name", "Categorical"), ("nation", "c_nationkey", "Numerical"), ("balance", "c_acctbal", "Numerical"), ("segment", "c_mktsegment", "Categorical"))
) + ")"


@query(f"""WITH {_KINDS} SELECT "column", detected, detected IN ('Constant', 'ID') AS drop_suggested FROM kinds""")
def column_types(spark, d):
    return profile.column_types(_users(spark, d), "key")


@query(f"WITH {_KINDS} SELECT detected, count(*) AS n FROM kinds GROUP BY 1")
def type_counts(spark, d):
    return profile.type_counts(profile.column_types(_users(spark, d), "key"))


@query(f"WITH {SQL_ITEMS}, n AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::varchar AS v, count(*) AS n FROM items GROUP BY 2" for c in ("quantity", "gap", "flag")) + ') SELECT "column", round(max(n) / sum(n), 6) AS share FROM n GROUP BY 1')
def top_shares(spark, d):
    return _r(profile.top_shares(_items(spark, d), ["quantity", "gap", "flag"]))


@query("""SELECT 'twin' AS "column", 'leakage' AS reason FROM lineitem HAVING abs(corr(CASE WHEN l_returnflag = 'R' THEN 2.5 ELSE 1.0 END, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)) > 0.95
    UNION ALL SELECT 'one', 'constant' FROM lineitem HAVING count(DISTINCT 1) <= 1 UNION ALL SELECT 'row_id', 'id' FROM lineitem HAVING count(l_orderkey) > 0""")
def pruned_columns(spark, d):
    df = _table(spark, d, "lineitem").selectExpr("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label", "CASE WHEN l_returnflag = 'R' THEN 2.5 ELSE 1.0 END AS twin", "1 AS one", "l_orderkey AS row_id", "l_quantity AS quantity")
    return profile.pruned(df, "label")


_SUMMARY = """SELECT '{c}' AS "column", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS lo, max({c}) AS hi,
    (avg(pow({c}, 3)) - 3 * avg({c}) * avg(pow({c}, 2)) + 2 * pow(avg({c}), 3)) / pow(stddev_pop({c}), 3) AS skew, count(*) FILTER ({c} < (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM items) OR {c} > (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM items)) / count({c}) AS outliers FROM items"""


@query(f"""WITH {SQL_ITEMS}, s AS ({_each(['quantity', 'gap', 'price', 'tax'], _SUMMARY)}) SELECT "column", round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS lo, round(hi, 6) AS hi, round(skew, 4) AS skew, round(outliers, 6) AS outliers FROM s""")
def numeric_summary(spark, d):
    return _r(profile.numeric_summary(_items(spark, d), ["quantity", "gap", "price", "tax"]), skew=4)


@query(f"""WITH {SQL_ITEMS}, s AS ({_each([*NUM, *CAT], _BASE)}) SELECT "column", n_missing, round(n_missing / n_rows, 6) AS missing FROM s WHERE n_missing > 0 ORDER BY n_missing DESC, "column" LIMIT 5""")
def missing_summary(spark, d):
    return _r(profile.missing_summary(profile.base_stats(_items(spark, d))))


@query(f"WITH {SQL_ITEMS}, n AS (SELECT flag AS label, count(*) AS n FROM items GROUP BY 1), t AS (SELECT max(n) / min(n) AS r, sum(n) AS t FROM n) SELECT label, n, round(n / t, 6) AS share, CASE WHEN r > 3 THEN 'red' WHEN r > 1.5 THEN 'yellow' ELSE 'green' END AS verdict FROM n, t")
def class_balance(spark, d):
    return _r(profile.class_balance(_items(spark, d), "flag"))


@query("""WITH l AS (SELECT count(*) AS n, (2 * count(*) - count(nullif(l_tax, 0.0)) - count(CASE WHEN l_linenumber > 3 THEN NULL ELSE l_quantity END)) / (2 * count(*)) AS m FROM lineitem),
    t AS (SELECT 'lineitem' AS name, n, 2 AS k, m FROM l UNION ALL SELECT 'supplier', count(*), 2, 0 FROM supplier UNION ALL SELECT 'region', count(*), 60, 0 FROM region)
    SELECT name, 'Small Dataset' AS category, 'medium' AS severity, n || ' rows' AS detail, 'colsample_bytree=0.7,min_child_samples=30.0,num_leaves=15.0,reg_alpha=0.1,reg_lambda=0.1,subsample=0.7' AS params FROM t WHERE n < 500
    UNION ALL SELECT name, 'High Dimensionality', 'medium', k || ' features', 'colsample_bytree=0.5,min_child_samples=20.0,reg_alpha=0.5' FROM t WHERE k > 0.5 * n AND k > 50
    UNION ALL SELECT name, 'High Missingness', 'low', printf('%.4f missing', m), '' FROM t WHERE m > 0.2""")
def dataset_advisories(spark, d):
    own = {
        "lineitem": _table(spark, d, "lineitem").selectExpr("l_returnflag AS flag", "nullif(l_tax, 0.0) AS tax", "CASE WHEN l_linenumber > 3 THEN NULL ELSE l_quantity END AS gap"),
        "supplier": _table(spark, d, "supplier").selectExpr("s_nationkey AS flag", "s_suppkey", "s_acctbal"), "region": _table(spark, d, "region").selectExpr("r_name AS flag", *(f"r_regionkey + {i} AS c{i}" for i in range(60))),
    }
    params = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("suggested_params")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    parts = [profile.advisories(df, "flag").select(F.lit(name).alias("name"), "category", "severity", "detail", params.alias("params")) for name, df in own.items()]
    return reduce(DataFrame.unionByName, parts)


@query("""WITH src AS (SELECT o_orderpriority AS p, dayname(o_orderdate) AS day FROM orders), v AS (
        SELECT 'day' AS "column", 'Day-of-Week' AS wanted, count(DISTINCT day) FILTER (lower(day) IN ('monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday')) / count(DISTINCT day) AS value FROM src
        UNION ALL SELECT 'o_orderpriority', 'Numerical', count(try_cast(p AS DOUBLE)) / count(p) FROM src UNION ALL SELECT 'o_orderpriority', 'Binary', count(DISTINCT p) FROM src
        UNION ALL SELECT 'day', 'Date', count(try_cast(day AS DATE)) / count(day) FROM src UNION ALL SELECT 'day', 'Free Text', avg(length(day)) FROM src UNION ALL SELECT 'day', 'Categorical', count(DISTINCT day) FROM src)
    SELECT "column", wanted, CASE WHEN wanted IN ('Date', 'Day-of-Week') AND value < 0.5 THEN 'warning' WHEN wanted = 'Numerical' AND value < 0.7 THEN 'error' WHEN wanted = 'Numerical' AND value < 0.95 THEN 'warning' WHEN wanted = 'Free Text' AND value < 10 THEN 'warning' WHEN wanted = 'Binary' AND value > 2 THEN 'error' WHEN wanted = 'Categorical' AND value > 500 THEN 'warning' ELSE 'ok' END AS severity, round(value::double, 6) AS value FROM v""")
def override_checks(spark, d):
    df = _table(spark, d, "orders").select("o_orderpriority", F.date_format("o_orderdate", "EEEE").alias("day"))
    out = profile.override_check(df, "day", "Day-of-Week")
    for c, k in (("o_orderpriority", "Numerical"), ("o_orderpriority", "Binary"), ("day", "Date"), ("day", "Free Text"), ("day", "Categorical")):
        out = out.unionByName(profile.override_check(df, c, k))
    return _r(out)


# --- meta-features ---


@query(
    f"WITH {SQL_ITEMS}, one AS (SELECT count(*) AS n, count(DISTINCT label) AS k, (count(*) * 7 - count(quantity) - count(gap) - count(price) - count(discount) - count(tax) - count(flag) - count(status)) / (count(*) * 7) AS gone, "
    + ", ".join(f"abs(corr({a}, {b})) AS r{i}" for i, (a, b) in enumerate((a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]))
    + ", "
    + ", ".join(f"abs(corr({a}, label)) AS t{i}" for i, a in enumerate(NUM))
    + " FROM items), c AS (SELECT max(n) / min(n) AS r FROM (SELECT count(*) AS n FROM items GROUP BY label) AS x) SELECT n AS n_rows, 7 AS n_cols, 5 AS n_numeric_cols, 2 AS n_cat_cols, round(2 / 7.0, 6)::double AS cat_ratio, round(n / 7, 6) AS row_col_ratio, k AS n_classes, round(gone, 6) AS missing_ratio, round(r, 6) AS class_imbalance_ratio, round(2 * ("
    + " + ".join(f"r{i}" for i in range(10)) + ") / 25, 6) AS avg_feature_corr, round(greatest(" + ", ".join(f"r{i}" for i in range(10)) + "), 6) AS max_feature_corr, round((" + " + ".join(f"t{i}" for i in range(5)) + ") / 5, 6) AS avg_target_corr, round(greatest(" + ", ".join(f"t{i}" for i in range(5)) + "), 6) AS max_target_corr FROM one, c"
)
def dataset_meta(spark, d):
    return _r(meta.dataset_meta(_items(spark, d), "label"))


_FILLED = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM items)) AS x{i}" for i, c in enumerate(NUM))
_XS = [f"x{i}" for i in range(5)]
_MEAN = f"(({' + '.join(_XS)}) / 5)"
_PLACE = "CASE WHEN hi > lo THEN least(4, floor(({x} - lo) / ((hi - lo) / 5)))::int ELSE 2 END"


@query(
    f"WITH {SQL_ITEMS}, f AS (SELECT *, {_FILLED} FROM items), g AS (SELECT *, {_MEAN} AS m, least({', '.join(_XS)}) AS lo, greatest({', '.join(_XS)}) AS hi, "
    + " + ".join(f"({c} IS NULL)::int" for c in NUM) + " AS gone, " + " + ".join(f"coalesce(({c} = 0)::int, 0)" for c in NUM) + " AS zeros FROM f), "
    + f"h AS (SELECT *, [{', '.join(_PLACE.format(x=x) for x in _XS)}] AS p FROM g), e AS (SELECT *, list_sum(list_transform(range(0, 5), lambda b: CASE WHEN len(list_filter(p, lambda y: y = b)) > 0 THEN -(len(list_filter(p, lambda y: y = b)) / 5) * log2(len(list_filter(p, lambda y: y = b)) / 5) ELSE 0 END)) AS h FROM h), one AS (SELECT "
    + f"({' + '.join(f'avg({c})' for c in NUM)}) / 5 AS avg_numeric_mean, ({' + '.join(f'stddev_samp({c})' for c in NUM)}) / 5 AS avg_numeric_std, ({' + '.join(f'avg(({c} IS NULL)::int)' for c in NUM)}) / 5 AS avg_missing_pct, greatest({', '.join(f'avg(({c} IS NULL)::int)' for c in NUM)}) AS max_missing_pct, avg(({' + '.join(f'pow({x} - m, 2)' for x in _XS)}) / 4) AS avg_row_variance, avg((gone > 0)::int) AS pct_rows_with_any_missing, sum(zeros) / (count(*) * 5) AS pct_cells_zero, avg((zeros > 0)::int) AS pct_rows_with_any_zero, "
    + f"2 * ({' + '.join(f'abs(corr({a}, {b}))' for i, a in enumerate(_XS) for b in _XS[i + 1:])}) / 25 AS numeric_col_corr_mean, greatest({', '.join(f'abs(corr({a}, {b}))' for i, a in enumerate(_XS) for b in _XS[i + 1:])}) AS numeric_col_corr_max, avg(h) AS avg_row_entropy, ({' + '.join(f'max({x}) - min({x})' for x in _XS)}) / 5 / (sqrt(({' + '.join(f'avg({x} * {x})' for x in _XS)}) / 5 - pow(({' + '.join(f'avg({x})' for x in _XS)}) / 5, 2)) + 1e-8) AS numeric_range_ratio FROM e) "
    + "SELECT 5 AS n_numeric_cols_used, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("avg_numeric_mean", "avg_numeric_std", "avg_missing_pct", "max_missing_pct", "avg_row_variance", "pct_rows_with_any_missing", "pct_cells_zero", "pct_rows_with_any_zero", "numeric_col_corr_mean", "numeric_col_corr_max", "avg_row_entropy", "numeric_range_ratio")) + " FROM one"
)
def row_meta(spark, d):
    return _r(meta.row_meta(_items(spark, d).drop("flag", "status"), "label"), 4)


_QM = ["quantity", "gap", "price", "tax"]
_NUMERIC_META = """SELECT '{c}' AS "column", 1 - count({c}) / count(*) AS null_pct, count(DISTINCT {c}) / count(*) AS unique_ratio, (count(DISTINCT {c}) = 2)::int AS is_binary,
    count(*) FILTER ({c} < (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM items) OR {c} > (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM items)) / count({c}) AS outlier_ratio,
    (max({c}) - min({c})) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM items) AS range_iqr_ratio,
    avg(pow({c} - (SELECT avg({c}) FROM items), 3)) / pow(stddev_pop({c}), 3) AS skewness, avg(pow({c} - (SELECT avg({c}) FROM items), 4)) / pow(stddev_pop({c}), 4) - 3 AS kurtosis_val, stddev_samp({c}) / abs(avg({c})) AS coeff_variation,
    count(*) FILTER ({c} = 0) / count({c}) AS zeros_ratio, count(*) FILTER ({c} < 0) / count({c}) AS pct_negative, count(*) FILTER ({c} BETWEEN 0 AND 1) / count({c}) AS pct_in_0_1_range, count({c}) AS n FROM items"""
_ENTROPY = """SELECT '{c}' AS "column", -sum(p * log2(p)) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM (SELECT least(b - 1, floor(({c} - lo) / ((hi - lo) / b))) AS k FROM items, (SELECT min({c}) AS lo, max({c}) AS hi, least(50, greatest(floor(sqrt(count({c}))), 5)) AS b FROM items) AS r WHERE {c} IS NOT NULL) AS z GROUP BY k) AS y"""
_SPEARMAN = """SELECT '{c}' AS "column", abs(corr(rx, ry)) AS spearman_corr_target FROM (SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rx, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2 AS ry FROM items WHERE {c} IS NOT NULL) AS x"""


@query(
    f"""WITH {SQL_ITEMS}, a AS ({_each(_QM, _NUMERIC_META)}), e AS ({_each(_QM, _ENTROPY)}), s AS ({_each(_QM, _SPEARMAN)})
    SELECT "column", round(null_pct, 6) AS null_pct, round(unique_ratio, 6) AS unique_ratio, is_binary, round(outlier_ratio, 6) AS outlier_ratio, round(range_iqr_ratio, 6) AS range_iqr_ratio, round(skewness, 5) AS skewness, round(kurtosis_val, 5) AS kurtosis_val, round(coeff_variation, 6) AS coeff_variation,
    round(zeros_ratio, 6) AS zeros_ratio, round(pct_negative, 6) AS pct_negative, round(pct_in_0_1_range, 6) AS pct_in_0_1_range, round(exp(-n / 6 * (skewness * skewness + kurtosis_val * kurtosis_val / 4) / 2), 4) AS normality_p_value, round((skewness * skewness + 1) / (kurtosis_val + 3), 5) AS bimodality_coefficient,
    round(entropy, 5) AS entropy, round(spearman_corr_target, 5) AS spearman_corr_target FROM a JOIN e USING ("column") JOIN s USING ("column")"""
)
def numeric_column_meta(spark, d):
    return _r(meta.numeric_column_meta(_items(spark, d), _QM, "label"), skewness=5, kurtosis_val=5, bimodality_coefficient=5, entropy=5, spearman_corr_target=5, normality_p_value=4)


_MI = """SELECT '{c}' AS "column", greatest(0, sum(c / n * ln(c * n / (a * b)))) AS mi FROM (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY v) AS a, sum(c) OVER (PARTITION BY y) AS b FROM (SELECT len(list_filter((SELECT list_distinct(quantile_cont({c}, [{q}])) FROM items), lambda e: {c} > e)) AS v, label AS y, count(*) AS c FROM items WHERE {c} IS NOT NULL GROUP BY 1, 2) AS g) AS h"""
_QS = ", ".join(str(i / 20) for i in range(1, 20))


@query(f'WITH {SQL_ITEMS}, s AS (' + " UNION ALL ".join(_MI.format(c=c, q=_QS) for c in _QM) + ') SELECT "column", round(mi, 6) AS mi FROM s')
def numeric_mutual_information(spark, d):
    return _r(meta.binned_mutual_information(_items(spark, d), _QM, "label"))


_CAT_META = """SELECT '{c}' AS "column", (SELECT 1 - count({c}) / count(*) FROM src) AS null_pct, count(*) AS n_unique, count(*) / (SELECT count(*) FROM src) AS unique_ratio, max(p) AS top_category_dominance, sum(p) FILTER (k <= 3) AS top3_category_concentration, avg((p < 0.01)::int) AS rare_category_pct, -sum(p * log2(p)) AS entropy
    FROM (SELECT n / sum(n) OVER () AS p, row_number() OVER (ORDER BY n DESC, {c}) AS k FROM (SELECT {c}, count(*) AS n FROM src WHERE {c} IS NOT NULL GROUP BY 1) AS g) AS h"""
_CAT_Y = """SELECT '{c}' AS "column", sum(t / (SELECT count(*) FROM src) * h) AS conditional_entropy, any_value(mi) AS mutual_info_score FROM (SELECT t, -sum(c / t * log2(c / t)) AS h FROM (SELECT c, sum(c) OVER (PARTITION BY v) AS t, v FROM (SELECT {c} AS v, label AS y, count(*) AS c FROM src WHERE {c} IS NOT NULL GROUP BY 1, 2) AS a) AS b GROUP BY v, t) AS q,
    (SELECT sum(c / n * ln(c * n / (a * b))) AS mi FROM (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY v) AS a, sum(c) OVER (PARTITION BY y) AS b FROM (SELECT {c} AS v, label AS y, count(*) AS c FROM src WHERE {c} IS NOT NULL GROUP BY 1, 2) AS a) AS b) AS m"""
_SRC = "SELECT o_orderstatus AS label, o_orderpriority AS priority, nullif(o_custkey % 60, 0)::varchar AS bucket FROM orders"


@query(
    f"""WITH src AS ({_SRC}), a AS ({_each(['priority', 'bucket'], _CAT_META)}), y AS ({_each(['priority', 'bucket'], _CAT_Y)})
    SELECT "column", round(null_pct, 6) AS null_pct, n_unique, round(unique_ratio, 6) AS unique_ratio, (n_unique <= 2)::int AS is_binary, (n_unique <= 10)::int AS is_low_cardinality, (n_unique > 50)::int AS is_high_cardinality, round(top_category_dominance, 6) AS top_category_dominance, round(top3_category_concentration, 6) AS top3_category_concentration,
    round(rare_category_pct, 6) AS rare_category_pct, round(entropy, 6) AS entropy, round(entropy / log2(greatest(n_unique, 2)), 6) AS normalized_entropy, round(conditional_entropy, 6) AS conditional_entropy, round(mutual_info_score, 6) AS mutual_info_score FROM a JOIN y USING ("column")"""
)
def categorical_column_meta(spark, d):
    df = _table(spark, d, "orders").selectExpr("o_orderstatus AS label", "o_orderpriority AS priority", "cast(nullif(o_custkey % 60, 0) AS string) AS bucket")
    return _r(meta.categorical_column_meta(df, ["priority", "bucket"], "label"))


_PAIR = """SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS pearson_corr, greatest(stddev_samp({a}), stddev_samp({b})) / least(stddev_samp({a}), stddev_samp({b})) AS scale_ratio, 2 - (count({a}) + count({b})) / count(*) AS sum_null_pct,
    (count(DISTINCT {a}) + count(DISTINCT {b})) / count(*) AS sum_unique_ratio, avg({a}) * avg({b}) AS product_of_means, abs(avg({a}) / avg({b})) AS abs_mean_ratio, stddev_samp({a}) / avg({a}) + stddev_samp({b}) / avg({b}) AS sum_cv FROM items"""


@query(f"WITH {SQL_ITEMS}, s AS ({_PAIR.format(a='quantity', b='price')} UNION ALL {_PAIR.format(a='price', b='tax')} UNION ALL {_PAIR.format(a='gap', b='discount')}) SELECT a, b, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("pearson_corr", "scale_ratio", "sum_null_pct", "sum_unique_ratio", "product_of_means", "abs_mean_ratio", "sum_cv")) + " FROM s")
def numeric_pair_meta(spark, d):
    out = meta.numeric_pair_meta(_items(spark, d), [("quantity", "price"), ("price", "tax"), ("gap", "discount")])
    return _r(out.select("a", "b", "pearson_corr", "scale_ratio", "sum_null_pct", "sum_unique_ratio", "product_of_means", "abs_mean_ratio", "sum_cv"), 5)


@query(f"WITH {SQL_ITEMS} SELECT round(abs(corr(rx, ry)), 6) AS spearman_corr FROM (SELECT rank() OVER (ORDER BY gap) + (count(*) OVER (PARTITION BY gap) - 1) / 2 AS rx, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2 AS ry FROM items WHERE gap IS NOT NULL) AS x")
def pair_spearman(spark, d):
    return _r(meta.pair_spearman(_items(spark, d), "gap", "price"))


@query(f"""WITH {SQL_ITEMS}, c AS (SELECT len(list_filter((SELECT list_distinct(quantile_cont(quantity, [{_QS}])) FROM items), lambda e: quantity > e)) AS x, len(list_filter((SELECT list_distinct(quantile_cont(price, [{_QS}])) FROM items), lambda e: price > e)) AS y, count(*) AS c FROM items GROUP BY 1, 2),
    w AS (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY x) AS a, sum(c) OVER (PARTITION BY y) AS b FROM c), h AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT sum(c) / sum(sum(c)) OVER () AS p FROM c GROUP BY y) AS g)
    SELECT round(least(1, greatest(0, sum(c / n * ln(c * n / (a * b)))) / any_value(h)), 6)::double AS mic_score FROM w, h""")
def mic_score(spark, d):
    return _r(meta.mic_score(_items(spark, d), "quantity", "price"))


@query(
    f"""WITH {SQL_ITEMS}, g AS (SELECT flag, count(*) AS n, avg(gap) AS m, var_pop(gap) AS v FROM items WHERE gap IS NOT NULL GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS tm FROM g)
    SELECT round(sum(n * pow(m - tm, 2)) / (sum(n * pow(m - tm, 2)) + sum(n * v) + 1e-10), 8) AS eta_squared, count(*) AS n_groups, round((sum(n * pow(m - tm, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 4) AS anova_f_stat FROM g, t"""
)
def mixed_pair_meta(spark, d):
    out = meta.mixed_pair_meta(_items(spark, d), "gap", "flag")
    return out.select(F.round("eta_squared", 8).alias("eta_squared"), "n_groups", F.round("anova_f_stat", 4).alias("anova_f_stat"))


_KINDS = ["quantity", "gap", "price", "tax", "flag", "status", "mode"]
_KIND_PAIRS = [("quantity", "gap"), ("gap", "tax"), ("price", "quantity"), ("flag", "tax"), ("gap", "mode"), ("flag", "mode"), ("status", "flag"), ("status", "late")]
_KIND_SRC = [*ITEMS, "CASE WHEN l_linenumber = 3 THEN NULL ELSE concat('m', l_linenumber) END AS mode", "CASE WHEN l_linenumber > 5 THEN 'late' ELSE 'soon' END AS late"]
_KIND_NUM = ("quantity", "gap", "price", "tax")


def _pair_features() -> str:
    """SQL of all features of the pairs, with a CTE for each column's codes and facts."""
    points = ", ".join(str(i / 20) for i in range(1, 20))
    columns = sorted({c for p in _KIND_PAIRS for c in p})
    code = {c: f"len(list_filter((SELECT list_distinct(quantile_cont(f_{c}, [{points}])) FROM filled), lambda e: f_{c} > e))::varchar" if c in _KIND_NUM else f"coalesce({c}, 'nan')" for c in columns}
    mi = "(SELECT greatest(0, sum(c / n * ln(c * n / (x * y)))) FROM (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY {a}) AS x, sum(c) OVER (PARTITION BY {b}) AS y FROM (SELECT {a}, {b}, count(*) AS c FROM coded GROUP BY 1, 2) AS g) AS h)"
    h = "(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {t} GROUP BY {k}) AS g)"
    ranks = "(SELECT abs(corr(rx, ry)) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS rx, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS ry FROM src WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS x)"
    facts = []
    for i, c in enumerate(columns):
        if c in _KIND_NUM:
            e = h.format(t=f"(SELECT least(b - 1, floor(({c} - lo) / ((hi - lo) / b))) AS k FROM src, (SELECT min({c}) AS lo, max({c}) AS hi, least(50, greatest(floor(sqrt(count({c}))), 5)) AS b FROM src) AS r WHERE {c} IS NOT NULL) AS z", k="k")
            own = f"avg({c}) AS mean, stddev_samp({c}) AS std, abs(avg(pow({c} - (SELECT avg({c}) FROM src), 3)) / pow(stddev_pop({c}), 3)) AS skew, {ranks.format(a=c, b='label')} AS tc"
        else:
            e, own = h.format(t=f"(SELECT {c} AS k FROM src WHERE {c} IS NOT NULL) AS z", k="k"), "0.0 AS mean, 0.0 AS std, 0.0 AS skew, 0.0 AS tc"
        facts.append(f"SELECT '{c}' AS k, {c in _KIND_NUM} AS num, {i / 10} AS imp, 1 - count({c}) / count(*) AS g, count(DISTINCT {c}) AS u, count(DISTINCT {c}) / count(*) AS ur, {own}, {e} AS e, {mi.format(a=f'c_{c}', b='label')} AS mi FROM src")
    pairs = []
    for a, b in _KIND_PAIRS:
        na, nb = a in _KIND_NUM, b in _KIND_NUM
        m = mi.format(a=f"c_{a}", b=f"c_{b}")
        own = {"mutual_info_pair": m, "mic_score": f"least(1, {m} / {h.format(t='coded', k=f'c_{b}')})"}
        if na and nb:
            own |= {"pearson_corr": f"(SELECT abs(corr({a}, {b})) FROM src)", "spearman_corr": ranks.format(a=a, b=b), "sign_concordance": f"(SELECT avg((({a} >= 0) = ({b} >= 0))::int) FROM src WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"}
        elif na or nb:
            v, g = (a, b) if na else (b, a)
            groups = f"(SELECT {g} AS g, count(*) AS n, avg({v}) AS m, var_pop({v}) AS s FROM src WHERE {v} IS NOT NULL GROUP BY 1) AS x"
            known = f"(SELECT * FROM {groups} WHERE g IS NOT NULL AND n > 1) AS y, (SELECT sum(n * m) / sum(n) AS bm FROM {groups} WHERE g IS NOT NULL AND n > 1) AS z"
            own |= {
                "eta_squared": f"(SELECT sum(n * pow(m - (SELECT avg({v}) FROM src), 2)) FILTER (g IS NOT NULL) / ((SELECT var_pop({v}) * count({v}) FROM src) + 1e-10) FROM {groups})",
                "anova_f_stat": f"(SELECT (sum(n * pow(m - bm, 2)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) FROM {known})", "n_groups": f"(SELECT count(DISTINCT {g}) FROM src)",
            }
        else:
            cell = f"(SELECT c_{a} AS x, c_{b} AS y, count(*) AS c FROM coded GROUP BY 1, 2) AS c"
            every = f"(SELECT r.x, t.y, r.r, t.t, coalesce(c.c, 0) AS c, (SELECT count(*) FROM src) AS n FROM (SELECT c_{a} AS x, count(*) AS r FROM coded GROUP BY 1) AS r CROSS JOIN (SELECT c_{b} AS y, count(*) AS t FROM coded GROUP BY 1) AS t LEFT JOIN {cell} ON c.x = r.x AND c.y = t.y) AS w"
            k = f"(SELECT least(count(DISTINCT c_{a}), count(DISTINCT c_{b})) - 1 FROM coded)"
            two = f"(SELECT count(DISTINCT c_{a}) = 2 AND count(DISTINCT c_{b}) = 2 FROM coded)"
            own |= {"cramers_v": f"(SELECT least(1, sqrt(sum(CASE WHEN {two} THEN pow(abs(c - r * t / n) - least(0.5, abs(c - r * t / n)), 2) ELSE pow(c - r * t / n, 2) END / (r * t / n)) / (max(n) * {k}))) FROM {every})", "observed": f"(SELECT count(*) FROM {cell})"}
        pairs.append(f"SELECT '{a}' AS a, '{b}' AS b, " + ", ".join(f"{own.get(c, '0.0')} AS {c}" for c in ("mutual_info_pair", "mic_score", "pearson_corr", "spearman_corr", "sign_concordance", "eta_squared", "anova_f_stat", "n_groups", "cramers_v", "observed")))
    n = "(x.num::int + y.num::int)"
    # what needs a number and a category is one step from two numbers and two from two categories
    step = lambda k, v: f"CASE WHEN {n} = {k} THEN {v} WHEN {n} = {2 if k == 1 else 1} THEN -10 ELSE -20 END"
    cv = lambda k: f"{k}.std / (abs({k}.mean) + 1e-8)"
    made = {
        "n_numerical_cols": n, "mutual_info_pair": "mutual_info_pair", "mic_score": "mic_score", "max_importance": "greatest(x.imp, y.imp)", "min_importance": "least(x.imp, y.imp)", "max_null_pct": "greatest(x.g, y.g)", "both_binary": "(x.u <= 2 AND y.u <= 2)::int",
        **{f"sum_{k}": f"x.{c} + y.{c}" for k, c in (("importance", "imp"), ("null_pct", "g"), ("unique_ratio", "ur"), ("entropy", "e"), ("mi_target", "mi"))}, **{f"abs_diff_{k}": f"abs(x.{c} - y.{c})" for k, c in (("unique_ratio", "ur"), ("entropy", "e"), ("mi_target", "mi"))},
        **{k: step(2, v) for k, v in {
            "pearson_corr": "pearson_corr", "spearman_corr": "spearman_corr", "scale_ratio": "greatest(x.std, y.std) / least(x.std, y.std)", "sum_target_corr": "x.tc + y.tc", "abs_diff_target_corr": "abs(x.tc - y.tc)", "product_of_means": "x.mean * y.mean", "abs_mean_ratio": "greatest(abs(x.mean), abs(y.mean)) / (least(abs(x.mean), abs(y.mean)) + 1e-8)",
            "sum_cv": f"{cv('x')} + {cv('y')}", "abs_diff_cv": f"abs({cv('x')} - {cv('y')})", "sum_skewness": "x.skew + y.skew", "abs_diff_skewness": "abs(x.skew - y.skew)", "sign_concordance": "sign_concordance", "n_positive_means": "(x.mean > 0)::int + (y.mean > 0)::int"}.items()},
        **{k: step(1, k) for k in ("eta_squared", "anova_f_stat", "n_groups")}, "cramers_v": step(0, "cramers_v"), "joint_cardinality": step(0, "x.u * y.u"), "cardinality_ratio": step(0, "least(x.u, y.u) / (greatest(x.u, y.u) + 1e-10)"), "joint_sparsity": step(0, "1 - observed / greatest(x.u * y.u, 1)"),
    }
    filled = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM src)) AS f_{c}" for c in columns if c in _KIND_NUM)
    return (
        f"WITH src AS (SELECT {', '.join(_KIND_SRC)} FROM lineitem), filled AS (SELECT *, {filled} FROM src), coded AS MATERIALIZED (SELECT label, {', '.join(f'{v} AS c_{c}' for c, v in code.items())} FROM filled), f AS MATERIALIZED ({' UNION ALL '.join(facts)}), p AS MATERIALIZED ({' UNION ALL '.join(pairs)}) "
        f"SELECT p.a, p.b, {', '.join(f'round(({v})::double, 4) AS {k}' for k, v in made.items())} FROM p JOIN f AS x ON p.a = x.k JOIN f AS y ON p.b = y.k"
    )


@query(_pair_features())
def pair_features(spark, d):
    df = _table(spark, d, "lineitem").selectExpr(*_KIND_SRC)
    imps = spark.createDataFrame([(c, i / 10) for i, c in enumerate(sorted({c for p in _KIND_PAIRS for c in p}))], "column string, importance double")
    return _r(pairs.pair_meta(df, _KIND_PAIRS, "label", imps), 4)


_V = """c AS (SELECT {a} AS a, {b} AS b, count(*) AS c FROM {t} GROUP BY 1, 2), x AS (SELECT a.a, b.b, a.r, b.s, coalesce(c.c, 0) AS c, (SELECT sum(c) FROM c) AS n FROM (SELECT a, sum(c) AS r FROM c GROUP BY 1) AS a CROSS JOIN (SELECT b, sum(c) AS s FROM c GROUP BY 1) AS b LEFT JOIN c ON c.a = a.a AND c.b = b.b),
    k AS (SELECT count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM x), chi AS (SELECT sum(CASE WHEN ka = 2 AND kb = 2 THEN pow(abs(c - r * s / n) - least(0.5, abs(c - r * s / n)), 2) ELSE pow(c - r * s / n, 2) END / (r * s / n)) AS chi, max(n) AS n FROM x, k)
    SELECT round(least(1, sqrt(chi / (n * (least(ka, kb) - 1)))), 6)::double AS cramers_v, (SELECT count(*) FROM c) AS joint_cardinality, round(least(ka, kb) / greatest(ka, kb), 6)::double AS cardinality_ratio, round(1 - (SELECT count(*) FROM c) / (ka * kb), 6)::double AS joint_sparsity FROM chi, k"""


@query(f"WITH {SQL_ORDERS}, {_V.format(a='status', b='priority', t='ords')}")
def category_pair_meta(spark, d):
    return _r(meta.category_pair_meta(_orders(spark, d), "status", "priority"))


@query(f"WITH {SQL_ITEMS}, {_V.format(a='status', b='label::varchar', t='items')}")
def category_pair_meta_2x2(spark, d):
    return _r(meta.category_pair_meta(_items(spark, d).withColumn("label", F.col("label").cast("string")), "status", "label"))


# --- metrics ---

_RATES = "(tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall"
_CELLS = "count(*) FILTER (label = 1 AND score >= {t}) AS tp, count(*) FILTER (label = 0 AND score >= {t}) AS fp, count(*) FILTER (label = 1 AND score < {t}) AS fn, count(*) FILTER (label = 0 AND score < {t}) AS tn"


@query(f"WITH {SQL_SCORED}, c AS (SELECT {_CELLS.format(t=0.4)} FROM scored) SELECT 0.4::double AS threshold, tp, fp, fn, tn, (tp + fp) / (tp + fp + fn + tn) AS positive_rate, {_RATES} FROM c")
def metrics_at_threshold(spark, d):
    return metrics.metrics_at_threshold(_scored(spark, d), 0.4)


_CURVE = f"WITH {SQL_SCORED}, pts AS (SELECT 0.01::double + i * ((0.99::double - 0.01::double) / 199) AS t FROM range(0, 200) AS r(i)), dist AS (SELECT score, label, count(*) AS n FROM scored GROUP BY 1, 2), c AS (SELECT t, coalesce(sum(n) FILTER (label = 1 AND score >= t), 0) AS tp, coalesce(sum(n) FILTER (label = 0 AND score >= t), 0) AS fp, coalesce(sum(n) FILTER (label = 1 AND score < t), 0) AS fn, coalesce(sum(n) FILTER (label = 0 AND score < t), 0) AS tn FROM pts, dist GROUP BY 1), m AS (SELECT t, {_RATES} FROM c)"


@query(f"{_CURVE} SELECT round(t, 9) AS threshold, round(accuracy, 9) AS accuracy, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall FROM m")
def threshold_curve(spark, d):
    return _r(metrics.threshold_curve(_scored(spark, d)), 9)


@query(f"{_CURVE}, l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, t, {m} AS v FROM m" for m in ("accuracy", "f1", "precision", "recall")) + ") SELECT metric, round(min(t), 9) AS threshold, round(max(v), 9) AS value FROM l WHERE v = (SELECT max(v) FROM l AS k WHERE k.metric = l.metric) GROUP BY metric")
def optimal_thresholds(spark, d):
    return _r(metrics.optimal_thresholds(_scored(spark, d)), 9)


_DIST = f"WITH {SQL_SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM scored GROUP BY 1), c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query(f"{_DIST} SELECT score AS threshold, round(fp / nq, 9) AS fpr, round(tp / np, 9) AS tpr FROM c UNION ALL SELECT 'inf'::double, 0, 0")
def roc_points(spark, d):
    return _r(metrics.roc_points(_scored(spark, d)), 9)


@query(f"{_DIST} SELECT score AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / np, 9) AS recall FROM c")
def pr_points(spark, d):
    return _r(metrics.pr_points(_scored(spark, d)), 9)


@query(f"{_DIST} SELECT round(sum(p * (nq - fp + q / 2)) / max(np * nq), 9) AS roc_auc, round(sum(p / np * tp / (tp + fp)), 9) AS average_precision FROM c")
def ranking_metrics(spark, d):
    return _r(metrics.ranking_metrics(_scored(spark, d)), 9)


@query(
    f"""WITH prob AS (SELECT l_returnflag AS flag, round(l_extendedprice / 120000.0, 2) AS "A", round(l_discount * 10, 1) AS "N", round(l_tax * 10, 1) AS "R" FROM lineitem), l AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, (flag = '{c}')::int AS y, \"{c}\" AS s FROM prob" for c in 'ANR')}),
    g AS (SELECT c, s, sum(y) AS p, sum(1 - y) AS q FROM l GROUP BY 1, 2), u AS (SELECT c, p, q, p * (sum(q) OVER (PARTITION BY c ORDER BY s ROWS UNBOUNDED PRECEDING) - q / 2) AS u FROM g), e AS (SELECT c, sum(u) AS u, sum(p) AS np, sum(q) AS nq FROM u GROUP BY 1) SELECT round(sum(u / nq) / sum(np), 9) AS roc_auc FROM e"""
)
def multiclass_auc(spark, d):
    df = _table(spark, d, "lineitem").selectExpr("l_returnflag AS label", "round(l_extendedprice / 120000.0, 2) AS prob_A", "round(l_discount * 10, 1) AS prob_N", "round(l_tax * 10, 1) AS prob_R")
    return _r(metrics.multiclass_auc(df, ["A", "N", "R"]), 9)


@query(f"WITH {SQL_SCORED} SELECT label, prediction, count(*) AS n FROM scored GROUP BY 1, 2")
def confusion(spark, d):
    return metrics.confusion(_scored(spark, d))


@query(
    """WITH s AS (SELECT l_returnflag AS y, CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.06 THEN 'N' ELSE 'R' END AS z FROM lineitem), e AS (SELECT c, count(*) FILTER (y = c) AS a, count(*) FILTER (z = c) AS s, count(*) FILTER (y = c AND z = c) AS t FROM s, (VALUES ('A'), ('N'), ('R')) AS v(c) GROUP BY 1)
    SELECT round(sum(t) / sum(a), 9) AS accuracy, round(sum(a * 2 * t / (a + s)) / sum(a), 9) AS f1, round(sum(a * t / s) / sum(a), 9) AS precision, round(sum(a * t / a) / sum(a), 9) AS recall FROM e"""
)
def class_metrics(spark, d):
    df = _table(spark, d, "lineitem").selectExpr("l_returnflag AS label", "CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.06 THEN 'N' ELSE 'R' END AS prediction")
    return _r(metrics.class_metrics(df), 9)


@query(f"WITH {SQL_SCORED} SELECT round(avg(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)), 8) AS log_loss FROM (SELECT label, least(1 - 2.220446049250313e-16, greatest(2.220446049250313e-16, score)) AS p FROM scored) AS x")
def log_loss(spark, d):
    return _r(metrics.log_loss(_scored(spark, d)), 8)


@query(f"WITH {SQL_SCORED}, l AS (SELECT t::double AS threshold, (score >= t)::int AS predicted FROM scored, (VALUES (0.3), (0.5)) AS v(t)), n AS (SELECT threshold, predicted, count(*) AS n FROM l GROUP BY 1, 2) SELECT *, n / sum(n) OVER (PARTITION BY threshold) AS share FROM n")
def prediction_shares(spark, d):
    return metrics.prediction_shares(_scored(spark, d), 0.3)


@query(f"WITH {SQL_SCORED}, b AS (SELECT least(49, greatest(0, floor(score / 0.02::double)))::int AS bin FROM scored) SELECT bin, round(bin * 0.02, 6)::double AS lower, count(*) AS n FROM b GROUP BY 1")
def score_histogram(spark, d):
    return _r(metrics.histogram(_scored(spark, d), "score"))


def _two(spark, d):
    s = _scored(spark, d)
    a, b = metrics.metrics_at_threshold(s, 0.5), metrics.metrics_at_threshold(s, 0.3)
    long = lambda x: x.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "f1", "recall")))))
    return long(a), long(b)


@query(
    f"WITH {SQL_SCORED}, a AS (SELECT {_RATES} FROM (SELECT {_CELLS.format(t=0.5)} FROM scored) AS x), b AS (SELECT {_RATES} FROM (SELECT {_CELLS.format(t=0.3)} FROM scored) AS x), l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, a.{m} AS baseline, b.{m} AS enhanced FROM a, b" for m in ("accuracy", "f1", "recall"))
    + ") SELECT metric, round(baseline, 9) AS baseline, round(enhanced, 9) AS enhanced, round(enhanced - baseline, 9) AS delta, CASE WHEN enhanced > baseline THEN 'enhanced' WHEN enhanced < baseline THEN 'baseline' ELSE 'tie' END AS winner FROM l"
)
def compared_metrics(spark, d):
    return _r(metrics.compared(*_two(spark, d)), 9)


# --- transforms, fitted on folds 0-3 of orders and replayed on fold 4 ---

_TRAIN, _TEST = f"train AS (SELECT * FROM ords WHERE {FOLD} <> 4)", f"test AS (SELECT * FROM ords WHERE {FOLD} = 4)"
_OWN = [*ORDERS, "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS gap", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS level", "o_totalprice - 200000.0 AS signed"]
_SQL_OWN = f"WITH ords AS (SELECT {', '.join(_OWN)} FROM orders), {_TRAIN}, {_TEST}"


def _own(spark, d):
    df = _table(spark, d, "orders").selectExpr(*_OWN).withColumn("f", md5fold(F.col("key"), 5))
    return df.where("f <> 4").drop("f"), df.where("f = 4").drop("f")


def _transform(name: str, steps: list[Step], columns: list[str], sql: str):
    """A query that fits on train and replays on test; sql: the columns' expressions over test."""

    @query(f"{_SQL_OWN} SELECT key, {sql} FROM test", name)
    def run(spark, d):
        train, test = _own(spark, d)
        return _r(apply(test, fit(train, steps)).select("key", *(quoted(c) for c in columns)), 6)


_MED = "coalesce({c}, (SELECT median({c}) FROM train))"
_G, _T, _S = _MED.format(c="gap"), _MED.format(c="total"), _MED.format(c="signed")
_transform("log_transform", [Step("log_transform", "signed")], ["signed"], f"round(ln(1 + {_S} + (SELECT CASE WHEN min(signed) <= 0 THEN abs(min(signed)) + 1 ELSE 0 END FROM train)), 6) AS signed")
_transform("sqrt_transform", [Step("sqrt_transform", "gap")], ["gap"], f"round(sqrt({_G} + (SELECT CASE WHEN min(gap) < 0 THEN abs(min(gap)) ELSE 0 END FROM train)), 6) AS gap")
_transform("polynomials", [Step("polynomial_square", "signed"), Step("polynomial_cube", "signed"), Step("reciprocal_transform", "signed")], ["signed_sq", "signed_recip"], f"round({_S} * {_S}, 6) AS signed_sq, round(1 / (abs({_S}) + 1e-5), 6) AS signed_recip")


@query(f"{_SQL_OWN} SELECT key, round({_S} * {_S} * {_S} / 1e12, 6) AS signed_cube FROM test")
def polynomial_cube(spark, d):
    train, test = _own(spark, d)
    return _r(apply(test, fit(train, [Step("polynomial_cube", "signed")])).select("key", (F.col("signed_cube") / 1e12).alias("signed_cube")))


_transform("quantile_binning", [Step("quantile_binning", "gap")], ["gap"], "CASE WHEN gap IS NOT NULL THEN (" + " + ".join(f"(gap > (SELECT quantile_cont(gap, {q}) FROM train))::int" for q in (0.2, 0.4, 0.6, 0.8)) + ")::double END AS gap")
_transform("impute_and_indicate", [Step("impute_median", "gap"), Step("missing_indicator", "gap"), Step("missing_indicator", "level")], ["gap", "gap_is_na", "level_is_na"], f"round({_G}, 6) AS gap, (gap IS NULL)::int AS gap_is_na, (level IS NULL)::int AS level_is_na")
_LEVEL = "coalesce({t}.level, 'nan')"
_transform("frequency_encoding", [Step("frequency_encoding", "level")], ["level"], "round(coalesce((SELECT count(*) FROM train WHERE coalesce(train.level, 'nan') = coalesce(test.level, 'nan')) / (SELECT count(*) FROM train), 0), 6) AS level")
_transform("target_encoding", [Step("target_encoding", "level")], ["level"], "round(coalesce((SELECT (sum(label) + 10 * (SELECT avg(label) FROM train)) / (count(*) + 10) FROM train WHERE coalesce(train.level, 'nan') = coalesce(test.level, 'nan')), (SELECT avg(label) FROM train)), 6) AS level")
_transform("onehot_encoding", [Step("onehot_encoding", "status")], ["status_O", "status_P"], "(status = 'O')::int AS \"status_O\", (status = 'P')::int AS \"status_P\"")
_transform("hashing_encoding", [Step("hashing_encoding", "level")], ["level"], "('0x' || substr(md5(coalesce(level, 'nan')), 31, 2))::int % 32 AS level")
_transform("interactions", [Step(f"{m}_interaction", "gap", "signed") for m in ("product", "division", "addition", "abs_diff")], ["gap_x_signed", "gap_div_signed", "gap_plus_signed", "gap_absdiff_signed"], f"round({_G} * {_S}, 6) AS gap_x_signed, round({_G} / (abs({_S}) + 1e-5), 6) AS gap_div_signed, round({_G} + {_S}, 6) AS gap_plus_signed, round(abs({_G} - {_S}), 6) AS gap_absdiff_signed")
_SAME = "coalesce(train.level, 'nan') = coalesce(test.level, 'nan')"
_transform("group_statistics", [Step("group_mean", "gap", "level"), Step("group_std", "gap", "level")], ["grpmean_gap_by_level", "grpstd_gap_by_level"], f"round((SELECT avg(gap) FROM train WHERE {_SAME}), 6) AS grpmean_gap_by_level, round((SELECT stddev_samp(gap) FROM train WHERE {_SAME}), 6) AS grpstd_gap_by_level")
_transform("cat_concat", [Step("cat_concat", "status", "level")], ["status_concat_level"], "coalesce((SELECT k FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT status || '_' || coalesce(level, 'nan') AS v FROM train) AS a) AS b WHERE v = status || '_' || coalesce(level, 'nan')), -1)::int AS status_concat_level")
_R3 = [_T, _G, _S]
_C3 = f"coalesce(customer, (SELECT median(customer) FROM train))::double"
_R4 = [_C3, *_R3]
_transform("row_statistics", [Step("row_numeric_stats"), Step("row_zero_stats"), Step("row_missing_stats")], ["row_mean", "row_median", "row_sum", "row_std", "row_min", "row_max", "row_range", "row_zero_count", "row_missing_count", "row_missing_percentage"],
    f"round(list_avg([{', '.join(_R4)}]), 6) AS row_mean, round(list_median([{', '.join(_R4)}]), 6) AS row_median, round(list_sum([{', '.join(_R4)}]), 6) AS row_sum, round(list_stddev_samp([{', '.join(_R4)}]), 6) AS row_std, round(least({', '.join(_R4)}), 6) AS row_min, round(greatest({', '.join(_R4)}), 6) AS row_max, round(greatest({', '.join(_R4)}) - least({', '.join(_R4)}), 6) AS row_range, (customer = 0)::int + coalesce((total = 0)::int, 0) + coalesce((gap = 0)::int, 0) + coalesce((signed = 0)::int, 0) AS row_zero_count, (gap IS NULL)::int + (level IS NULL)::int AS row_missing_count, round(((gap IS NULL)::int + (level IS NULL)::int) / 7, 6) AS row_missing_percentage")


@query(
    f"""{_SQL_OWN}, s AS (SELECT coalesce(level, 'nan') AS v, {FOLD} AS f, count(*) AS n, sum(label) AS s FROM train GROUP BY 1, 2), t AS (SELECT v, sum(n) AS n, sum(s) AS s FROM s GROUP BY 1)
    SELECT key, round((t.s - s.s + 10 * (SELECT avg(label) FROM train)) / (t.n - s.n + 10), 6) AS level FROM train JOIN s ON s.v = coalesce(level, 'nan') AND s.f = {FOLD} JOIN t ON t.v = s.v"""
)
def target_encoding_out_of_fold(spark, d):
    return _r(fit_and_apply(_own(spark, d)[0], [Step("target_encoding", "level")])[0].select("key", "level"))


_PARTS = ["year", "month", "day", "dayofweek", "is_weekend", "quarter", "weekofyear", "days_since_min", "hour"]


@query(
    """SELECT event_id, year(ts)::int AS ts_year, month(ts)::int AS ts_month, day(ts)::int AS ts_day, (isodow(ts) - 1)::int AS ts_dayofweek, (isodow(ts) > 5)::int AS ts_is_weekend, quarter(ts)::int AS ts_quarter, weekofyear(ts)::int AS ts_weekofyear, floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400000000)::int AS ts_days_since_min, hour(ts)::int AS ts_hour,
    """ + ", ".join(f"round(sin(2 * pi() * {x} / {p}), 6) AS ts_{k}_sin, round(cos(2 * pi() * {x} / {p}), 6) AS ts_{k}_cos" for k, x, p in (("month", "month(ts)", 12), ("dow", "(isodow(ts) - 1)", 7), ("dom", "day(ts)", 31), ("hour", "hour(ts)", 24))) + " FROM events"
)
def date_features(spark, d):
    df = _table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("plain"), "ts").drop("plain")
    return _r(fit_and_apply(df, [Step("date_features", "ts"), *(Step(f"date_cyclical_{k}", "ts") for k in ("month", "dow", "dom", "hour"))], key="event_id")[0])


@query("SELECT event_id, " + ", ".join(f"round(sin(2 * pi() * {x} / {p}), 6) AS ts_{k}_sin, round(cos(2 * pi() * {x} / {p}), 6) AS ts_{k}_cos" for k, x, p in (("month", "month(ts)", 12), ("dow", "(isodow(ts) - 1)", 7))) + " FROM events")
def legacy_date_waves(spark, d):
    """Month and weekday together, of dates in text."""
    df = _table(spark, d, "events").select("event_id", F.date_format("ts", "MMM d, yyyy h:mm a").alias("ts"))
    made = fit_and_apply(df, [Step("date_features", "ts"), Step("date_cyclical", "ts")], key="event_id")[0]
    return _r(made.select("event_id", *(f"ts_{k}_{f}" for k in ("month", "dow") for f in ("sin", "cos"))))


@query("""SELECT o_orderkey AS key, (isodow(o_orderdate) - 1)::int AS day_dow, round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) AS day_dow_sin, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) AS day_dow_cos FROM orders""")
def weekday_features(spark, d):
    df = _table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "EEEE").alias("day"))
    return _r(fit_and_apply(df, [Step("dow_ordinal", "day"), Step("dow_cyclical", "day")])[0])


@query(
    r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, len(w)::int AS text_word_count, length(text)::int AS text_char_count, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END, 6) AS text_avg_word_len,
    round(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / greatest(length(text), 1), 6) AS text_uppercase_ratio, round(length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) / greatest(length(text), 1), 6) AS text_digit_ratio, round(length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / greatest(length(text), 1), 6) AS text_punct_ratio FROM w"""
)
def text_statistics(spark, d):
    return _r(fit_and_apply(_table(spark, d, "documents").select("doc_id", "text"), [Step("text_stats", "text")], key="doc_id")[0])


@query()
def text_tfidf(spark, d):
    return _r(fit_and_apply(_table(spark, d, "documents").select("doc_id", "text"), [Step("text_tfidf", "text")], key="doc_id")[0])


# --- candidates, on a table of made-up scores derived from the columns' statistics ---


def _suggested(spark, d) -> DataFrame:
    """Suggestions for every column of lineitem, scored by a plain expression of its statistics."""
    m = meta.numeric_column_meta(_items(spark, d), NUM, "label")
    rows = candidates._methods(m, candidates.NUMERICAL).select(F.lit("numerical").alias("type"), "column", F.lit(None).cast("string").alias("column_b"), "method", (F.col("unique_ratio") + F.length("method") / 100 - F.length("column") / 50).alias("predicted_delta_raw"), F.lit(False).alias("pinned"), F.lit(None).cast("boolean").alias("auto_checked"))
    return rows


_SUGG = f"""WITH {SQL_ITEMS}, u AS ({_each(NUM, "SELECT '{c}' AS \"column\", count(DISTINCT {c}) / count(*) AS r FROM items")}), s AS (SELECT 'numerical' AS type, "column", method, r + length(method) / 100 - length("column") / 50 AS raw FROM u, (VALUES {', '.join(f"('{m}')" for m in candidates.NUMERICAL)}) AS v(method)), z AS (SELECT *, (raw - avg(raw) OVER ()) / stddev_pop(raw) OVER () AS z FROM s)"""
_ADD = ", ".join(f"'{m}'" for m in candidates.ADDITIVE)


@query(f'{_SUGG} SELECT "column", method, round(raw, 6) AS predicted_delta_raw, round(z, 6) AS predicted_delta FROM z')
def normalised_suggestions(spark, d):
    return _r(candidates.normalised(_suggested(spark, d)).select("column", "method", "predicted_delta_raw", "predicted_delta"))


@query(f'{_SUGG} SELECT "column", method, round(z, 6) AS predicted_delta FROM z QUALIFY method IN ({_ADD}) OR row_number() OVER (PARTITION BY "column", method IN ({_ADD}) ORDER BY z DESC, method) = 1')
def deduplicated_suggestions(spark, d):
    return _r(candidates.deduplicated(candidates.normalised(_suggested(spark, d))).select("column", "method", "predicted_delta"))


@query(f'{_SUGG} SELECT count(*) AS evaluated, count(*) FILTER (raw > 0) AS positive, type, round(max(z), 6) AS best_delta FROM z GROUP BY type')
def suggestions_by_type(spark, d):
    return _r(candidates.summary_by_type(candidates.normalised(_suggested(spark, d))).drop("best_column", "best_method"))


@query(f"""{_SUGG}, p AS (SELECT z, CASE WHEN method IN ('impute_median', 'missing_indicator') THEN 'missing_values' WHEN method IN ('log_transform', 'sqrt_transform', 'reciprocal_transform', 'quantile_binning') THEN 'skewed' WHEN method LIKE 'polynomial%' THEN 'nonlinear' END AS problem FROM z) SELECT problem, count(*) AS n, round(max(z), 6) AS best_delta FROM p GROUP BY 1""")
def suggestions_by_problem(spark, d):
    return _r(candidates.grouped_by_problem(candidates.normalised(_suggested(spark, d))).drop("best_method"))


@query(f"""{_SUGG}, r AS (SELECT min(z) AS lo, max(z) AS hi FROM z), b AS (SELECT least(29, floor((z - lo) / ((hi - lo) / 30)))::int AS bin, count(*) AS n FROM z, r GROUP BY 1) SELECT bin, n, round(lo + bin * (hi - lo) / 30, 6) AS low FROM b, r""")
def delta_histogram(spark, d):
    return _r(candidates.delta_histogram(candidates.normalised(_suggested(spark, d))))


@query("SELECT CASE WHEN n < 500 THEN 3 WHEN n < 2000 THEN 5 WHEN n < 10000 THEN 8 WHEN n < 50000 THEN 12 ELSE 15 END + 1 AS k FROM (SELECT count(*) AS n FROM lineitem) AS x")
def recommended_top_k(spark, d):
    return _table(spark, d, "lineitem").agg(F.count("*").alias("n")).select(candidates.recommended_top_k(F.col("n"), F.lit(20)).alias("k"))


_GATED = f"""WITH {SQL_ITEMS}, f AS ({_each(NUM, "SELECT '{c}' AS \"column\", 1 - count({c}) / count(*) AS g, count(DISTINCT {c}) / count(*) AS u, count(DISTINCT {c}) = 2 AS b, min({c}) AS lo FROM items")})
    SELECT "column", method FROM f, (VALUES {', '.join(f"('{m}')" for m in candidates.NUMERICAL)}) AS v(method) WHERE CASE WHEN method IN ('impute_median', 'missing_indicator') THEN g > 0 WHEN g > 0.5 THEN false WHEN method = 'sqrt_transform' THEN lo >= 0 AND NOT b WHEN method = 'quantile_binning' THEN u >= 0.01 AND NOT b ELSE NOT b END"""


@query(_GATED)
def numerical_candidates(spark, d):
    df = _items(spark, d)
    least = df.agg(*(F.struct(F.lit(c).alias("column"), F.min(number(c)).alias("min_value")).alias(f"__{i}") for i, c in enumerate(NUM))).select(F.inline(F.array(*(F.col(f"__{i}") for i in range(len(NUM))))))
    return candidates.numerical_candidates(meta.numeric_column_meta(df, NUM, "label").join(F.broadcast(least), "column")).select("column", "method")


@query(f"""WITH src AS ({_SRC}), f AS ({_each(['priority', 'bucket'], "SELECT '{c}' AS \"column\", 1 - count({c}) / count(*) AS g, count(DISTINCT {c}) AS u FROM src")}) SELECT "column", method FROM f, (VALUES {', '.join(f"('{m}')" for m in candidates.CATEGORICAL)}) AS v(method) WHERE CASE method WHEN 'missing_indicator' THEN g > 0 WHEN 'onehot_encoding' THEN u BETWEEN 2 AND 10 WHEN 'hashing_encoding' THEN u > 10 ELSE true END""")
def categorical_candidates(spark, d):
    df = _table(spark, d, "orders").selectExpr("o_orderstatus AS label", "o_orderpriority AS priority", "cast(nullif(o_custkey % 60, 0) AS string) AS bucket")
    return candidates.categorical_candidates(meta.categorical_column_meta(df, ["priority", "bucket"], "label")).select("column", "method")


_BI = [("flag", "copy"), ("flag", "status"), ("part", "price"), ("part", "other"), ("part", "supplier"), ("other", "price")]
_BI_COLUMNS = ["l_returnflag AS flag", "concat(l_returnflag, '!') AS copy", "l_linestatus AS status", "l_partkey AS part", "3 * l_partkey + 1 AS price", "CASE WHEN l_partkey % 50 = 0 AND l_linenumber > 3 THEN -l_partkey ELSE 7 * l_partkey END AS other", "l_suppkey AS supplier"]


@query(f"WITH src AS (SELECT {', '.join(_BI_COLUMNS)} FROM lineitem), r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, (SELECT count(DISTINCT {a}) FROM src) AS ua, (SELECT count(DISTINCT {b}) FROM src) AS ub, (SELECT avg((k = 1)::int) FROM (SELECT count(DISTINCT {b}) AS k FROM src GROUP BY {a}) AS x) AS sa, (SELECT avg((k = 1)::int) FROM (SELECT count(DISTINCT {a}) AS k FROM src GROUP BY {b}) AS x) AS sb" for a, b in _BI) + ") SELECT a, b, least(ua, ub) >= 3 AND least(ua, ub) / greatest(ua, ub) >= 0.8 AND sa >= 0.95 AND sb >= 0.95 AS near_bijection FROM r")
def near_bijections(spark, d):
    return candidates.near_bijections(_table(spark, d, "lineitem").selectExpr(*_BI_COLUMNS), _BI)


# --- experiments: folds of lineitem by supplier stand for datasets ---

_FOLDS_SQL = """folds AS (SELECT 'd' || (l_suppkey % 10) AS dataset_name, l_returnflag AS method, l_linenumber AS fold, 0.6 + avg(l_discount) AS baseline, 0.6 + avg(l_tax) + avg(l_discount) / 2 AS changed FROM lineitem GROUP BY 1, 2, 3)"""


def _folds(spark, d):
    g = _table(spark, d, "lineitem").groupBy(F.concat(F.lit("d"), F.col("l_suppkey") % 10).alias("dataset_name"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("fold"))
    return g.agg((0.6 + F.avg("l_discount")).alias("baseline"), (0.6 + F.avg("l_tax") + F.avg("l_discount") / 2).alias("changed"))


_EFFECT = f"""WITH {_FOLDS_SQL}, g AS (SELECT dataset_name, method, count(*) AS n, avg(baseline) AS baseline, avg(changed) AS changed, avg(changed - baseline) AS delta, stddev_samp(changed - baseline) AS sd, stddev_samp(baseline) AS noise FROM folds GROUP BY 1, 2)"""


@query(f"""{_EFFECT} SELECT dataset_name, method, n, round(delta, 8) AS delta, round(delta / greatest(1 - baseline, 0.001) * 100, 6) AS delta_normalized, round(greatest(noise, 0.001), 8) AS noise_floor, round(delta / greatest(noise, 0.001), 5) AS calibrated_delta, round(delta / sd, 5) AS cohens_d, round(delta / (sd / sqrt(n)), 5) AS t_stat FROM g""")
def fold_effects(spark, d):
    e = experiments.fold_effects(_folds(spark, d), ["dataset_name", "method"])
    r = lambda c, k: F.round(c, k).alias(c)
    return e.select("dataset_name", "method", "n", r("delta", 8), r("delta_normalized", 6), r("noise_floor", 8), r("calibrated_delta", 5), r("cohens_d", 5), r("t_stat", 5))


#: Seven folds leave six degrees of freedom, for which Student's distribution has a closed form.
@query(f"""{_EFFECT}, t AS (SELECT *, atan(abs(delta / (sd / sqrt(n))) / sqrt(6)) AS th FROM g WHERE n = 7), p AS (SELECT *, 1 - sin(th) * (1 + pow(cos(th), 2) / 2 + 3 * pow(cos(th), 4) / 8) AS p FROM t)
    SELECT dataset_name, method, round(p, 8) AS p_value, round(least(1, p * count(*) OVER (PARTITION BY dataset_name)), 8) AS p_bonferroni, p < 0.05 AS is_significant FROM p""")
def fold_significance(spark, d):
    e = experiments.fold_effects(_folds(spark, d), ["dataset_name", "method"])
    return experiments.bonferroni(e).select("dataset_name", "method", F.round("p_value", 8).alias("p_value"), F.round("p_bonferroni", 8).alias("p_bonferroni"), "is_significant")


@query(f"""{_EFFECT}, q AS (SELECT delta / sd AS x FROM g) SELECT round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std, round(quantile_cont(x, 0.25), 5) AS q25, round(median(x), 5) AS median, round(quantile_cont(x, 0.75), 5) AS q75, avg((x > 0)::int) AS positive_share FROM q""")
def target_stats(spark, d):
    return _r(experiments.target_stats(experiments.fold_effects(_folds(spark, d), ["dataset_name", "method"]), "cohens_d"), 5)


_RES = """res AS (SELECT 'd' || (o_custkey % 40) AS dataset_name, o_orderpriority AS method, o_orderkey AS task_id, o_totalprice AS delta, o_totalprice > 250000 AS is_significant, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status, o_orderkey % 2 AS part FROM orders)"""


def _res(spark, d):
    return _table(spark, d, "orders").selectExpr("concat('d', o_custkey % 40) AS dataset_name", "o_orderpriority AS method", "o_orderkey AS task_id", "o_totalprice AS delta", "o_totalprice > 250000 AS is_significant", "CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status", "o_orderkey % 2 AS part")


@query(f"WITH {_RES} SELECT dataset_name, method, task_id, delta FROM res QUALIFY row_number() OVER (PARTITION BY dataset_name, method ORDER BY part, task_id) = 1")
def merged_results(spark, d):
    r = _res(spark, d)
    return tables.merged([r.where("part = 0"), r.where("part = 1")], ["dataset_name", "method"], ["task_id"]).select("dataset_name", "method", "task_id", "delta")


@query(f"WITH {_RES} SELECT method, count(*) AS n_rows, count(DISTINCT dataset_name) AS n_datasets, avg(is_significant::int) AS significant_share FROM res GROUP BY 1 UNION ALL SELECT NULL, count(*), count(DISTINCT dataset_name), avg(is_significant::int) FROM res")
def results_summary(spark, d):
    return tables.summary(_res(spark, d))


@query(f"WITH {_RES} SELECT status, count(*) AS n FROM res GROUP BY 1")
def status_counts(spark, d):
    return tables.status_counts(_res(spark, d))


@query(f"WITH {_RES} SELECT task_id, method FROM res WHERE status <> 'ok' ORDER BY task_id LIMIT 20")
def failed_tasks(spark, d):
    return tables.failed_tasks(_res(spark, d)).select("task_id", "method")


@query(f"WITH {_RES} SELECT task_id FROM res WHERE task_id NOT IN (SELECT task_id FROM res WHERE status = 'ok')")
def pending_tasks(spark, d):
    r = _res(spark, d)
    return experiments.pending(r.select("task_id"), r.where("status = 'ok'"), ["task_id"])


_CATALOG = ["o_custkey AS dataset_id", "o_orderkey AS task_id", "CASE WHEN o_orderstatus = 'O' THEN 'Classification' ELSE 'regression' END AS task_type", "CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'active' END AS status", "cast(o_totalprice as bigint) AS n_rows", "4 + o_custkey % 500 AS n_cols", "CASE WHEN o_orderpriority = '1-URGENT' THEN 10 ELSE 5 END AS folds", "o_orderkey % 97 AS runs"]


@query(f"""WITH c AS (SELECT {', '.join(_CATALOG)} FROM orders), o AS (SELECT * FROM c WHERE status = 'active' AND n_rows BETWEEN 500 AND 5000000 AND n_cols BETWEEN 4 AND 6000 AND n_rows * n_cols <= 200000000 QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY (folds = 10)::int DESC, runs DESC, task_id) = 1)
    SELECT dataset_id, task_id FROM o ORDER BY md5(dataset_id::varchar), dataset_id LIMIT 300""")
def curated_catalog(spark, d):
    return experiments.curated(_table(spark, d, "orders").selectExpr(*_CATALOG), 300).select("dataset_id", "task_id")


@query(f"WITH c AS (SELECT {', '.join(_CATALOG)} FROM orders) SELECT lower(task_type) AS task_type, count(*) AS n FROM c GROUP BY 1")
def task_counts(spark, d):
    return experiments.task_counts(_table(spark, d, "orders").selectExpr(*_CATALOG))


_CELL = ["l_returnflag AS ctype", "concat('f', l_suppkey % 20) AS formula", "l_extendedprice"]


@query("""WITH c AS (SELECT l_returnflag AS ctype, concat('f', l_suppkey % 20) AS formula, round(avg(l_extendedprice) / 100000, 6) AS r2 FROM lineitem GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY ctype ORDER BY r2 DESC, formula) AS rank_in_family, row_number() OVER (ORDER BY r2 DESC, formula, ctype) AS rank, row_number() OVER (PARTITION BY ctype ORDER BY r2 DESC, formula) = 1 AS best FROM c""")
def ranked_ablation(spark, d):
    cells = _table(spark, d, "lineitem").selectExpr(*_CELL).groupBy("ctype", "formula").agg(F.round(F.avg("l_extendedprice") / 100000, 6).alias("r2"))
    return experiments.ranked_ablation(cells)


# --- verdicts, on importances that stand for a model's: mean prices by part ---

_IMP = """e AS (SELECT p_brand AS "column", avg(p_retailprice) * (p_brand < 'Brand#3')::int + 0.001 AS importance FROM part GROUP BY 1), b AS (SELECT p_brand AS "column", avg(p_size) AS importance FROM part WHERE p_brand < 'Brand#4' GROUP BY 1), es AS (SELECT "column", 100 * importance / sum(importance) OVER () AS share FROM e), bs AS (SELECT "column", 100 * importance / sum(importance) OVER () AS share FROM b)"""


def _imps(spark, d):
    p = _table(spark, d, "part")
    e = p.groupBy(F.col("p_brand").alias("column")).agg((F.avg("p_retailprice") * (F.col("p_brand") < "Brand#3").cast("int") + 0.001).alias("importance"))
    b = p.where("p_brand < 'Brand#4'").groupBy(F.col("p_brand").alias("column")).agg(F.avg("p_size").alias("importance"))
    return e, b


def _made(spark, d):
    return _table(spark, d, "part").select(F.concat(F.lit("date_"), F.substring("p_brand", 7, 1)).alias("transform"), F.col("p_brand").alias("column")).distinct()


_MADE = """made AS (SELECT DISTINCT 'date_' || substr(p_brand, 7, 1) AS transform, p_brand AS "column" FROM part)"""
_VERD = f"""WITH {_IMP}, {_MADE}, v AS (SELECT transform, sum(coalesce(es.share, 0)) AS share, sum(coalesce(es.share, 0)) - sum(bs.share) AS change FROM made LEFT JOIN es USING ("column") LEFT JOIN bs USING ("column") GROUP BY 1), w AS (SELECT *, CASE WHEN share >= 5 THEN 'good' WHEN share >= 1.25 THEN 'marginal' ELSE 'bad' END AS verdict FROM v)"""


@query(f"{_VERD} SELECT transform, round(share, 6) AS share, round(change, 6) AS change, verdict FROM w")
def transform_verdicts(spark, d):
    e, b = _imps(spark, d)
    return _r(verdicts.transform_verdicts(_made(spark, d), e, b, 10))


_KIND = "CASE WHEN p_brand LIKE 'Brand#1%' THEN 'date_features' WHEN p_brand LIKE 'Brand#2%' THEN 'row_numeric_stats' ELSE 'text_stats' END"


@query(f"""WITH {_IMP}, made AS (SELECT DISTINCT {_KIND} AS method, p_brand AS "column" FROM part), g AS (SELECT method FROM made JOIN es USING ("column") GROUP BY 1 HAVING sum(share) >= 12.5)
    SELECT method AS transform, "column", round(share, 6) AS share FROM made JOIN es USING ("column") WHERE method IN (SELECT method FROM g) AND method IN ('date_features', 'row_numeric_stats') AND share < 12.5""")
def bad_parts(spark, d):
    e, b = _imps(spark, d)
    made = _table(spark, d, "part").select(F.expr(_KIND).alias("transform"), F.col("p_brand").alias("column")).distinct()
    return _r(verdicts.bad_parts(made, e, verdicts.transform_verdicts(made, e, b, 4), 4))


_SIDES = "WITH r AS (SELECT l_suppkey % 50 AS g, (l_returnflag = 'R')::int AS y, (l_extendedprice + 40000 * (l_returnflag = 'R')::int * (l_suppkey % 3) >= 60000)::int AS b, (l_extendedprice + 40000 * (l_returnflag = 'R')::int * (l_suppkey % 3) >= 30000 + 1000 * (l_suppkey % 50))::int AS e FROM lineitem), c AS (SELECT g, sum(y * b) AS tb, sum(y * e) AS te, sum(b) AS pb, sum(e) AS pe, sum(y) AS n FROM r GROUP BY g), m AS (SELECT g, tb / pb AS pb, te / pe AS pe, tb / n AS rb, te / n AS re, 2 * tb / (pb + n) AS fb, 2 * te / (pe + n) AS fe FROM c)"


def _sides(spark, d):
    """f1, precision and recall of two sets of predictions, by group of suppliers."""
    score = "l_extendedprice + 40000 * CAST(l_returnflag = 'R' AS INT) * (l_suppkey % 3)"
    rows = _table(spark, d, "lineitem").selectExpr("l_suppkey % 50 AS g", "CAST(l_returnflag = 'R' AS INT) AS y", f"CAST({score} >= 60000 AS INT) AS baseline", f"CAST({score} >= 30000 + 1000 * (l_suppkey % 50) AS INT) AS enhanced")
    hit, said, n = (lambda k: F.sum(F.col("y") * F.col(k))), F.sum, F.sum("y")
    parts = [x for k in ("baseline", "enhanced") for x in ((hit(k) / said(k)).alias(f"{k}_precision"), (hit(k) / n).alias(f"{k}_recall"), (2 * hit(k) / (said(k) + n)).alias(f"{k}_f1"))]
    return rows.groupBy("g").agg(*parts)


@query(f"""{_SIDES} SELECT g, round(fb, 6) AS baseline_f1, round(fe, 6) AS enhanced_f1,
    CASE WHEN fb >= 0.9 AND pb >= 0.9 AND rb >= 0.9 AND fe <= fb + 0.005 THEN 'marginal' WHEN fe < fb - 0.02 THEN 'bad' WHEN re > rb + 0.15 AND pe < pb - 0.15 THEN 'marginal' WHEN fe >= fb - 0.005 THEN 'good' ELSE 'marginal' END AS verdict FROM m""")
def imbalance_verdicts(spark, d):
    return _r(verdicts.imbalance_verdict(_sides(spark, d)).select("g", "baseline_f1", "enhanced_f1", "verdict"))


_TESTED = """t AS (SELECT avg(fb) AS fb, avg(fe) AS fe, avg(pb) AS pb, avg(rb) AS rb FROM m), u AS (SELECT 1 - avg(1 - fb) AS ab, 1 - avg(1 - fe) AS ae FROM m),
    v AS (SELECT count(*) FILTER (share < 5) AS n FROM (SELECT p_brand, 100 * sum(p_retailprice) / sum(sum(p_retailprice)) OVER () AS share FROM part GROUP BY 1) AS x)"""


@query(f"""{_SIDES}, {_TESTED} SELECT CASE WHEN n > 0 THEN 'run again without' ELSE 'all contributed' END AS rule, n || ' transforms' AS detail FROM v
    UNION ALL SELECT CASE WHEN least(fb, pb, rb) < 0.8 THEN 'enable class weights' ELSE 'class weights not needed' END, concat_ws(', ', CASE WHEN fb < 0.8 THEN 'f1' END, CASE WHEN pb < 0.8 THEN 'precision' END, CASE WHEN rb < 0.8 THEN 'recall' END) FROM t
    UNION ALL SELECT 'tuning', CASE WHEN (ae - ab) / greatest(1 - ab, 0.001) >= 0.2 THEN 'likely worth while' ELSE 'moderate headroom' END FROM u WHERE (ae - ab) / greatest(1 - ab, 0.001) >= 0.05
    UNION ALL SELECT 'class weights', CASE WHEN fe - fb > 0.02 THEN 'effective' WHEN fe > fb THEN 'marginal' ELSE 'ineffective' END FROM t""")
def model_recommendations(spark, d):
    """The rules where class weights were offered, and that on their effect where they were applied."""
    own = _table(spark, d, "part").groupBy(F.col("p_brand").alias("column")).agg(F.sum("p_retailprice").alias("importance"))
    found = verdicts.transform_verdicts(own.select(F.col("column").alias("transform"), "column"), own, own, 10)
    means = _sides(spark, d).agg(*(F.avg(f"{k}_{m}").alias(f"{k}_{m}") for k in ("baseline", "enhanced") for m in ("f1", "precision", "recall")))
    each = [(m, F.col(f"baseline_{m}"), F.col(f"enhanced_{m}")) for m in ("f1", "precision", "recall")] + [("roc_auc", F.col("baseline_f1"), F.col("enhanced_f1"))]
    test = means.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), b.alias("baseline"), e.alias("enhanced")) for m, b, e in each))))
    none = own.select("column").where("importance < 0")
    return verdicts.recommendations(found, none, test, offered=True).unionByName(verdicts.recommendations(found, none, test, applied=True).where("rule = 'class weights'"))


@query(f"""WITH {_IMP} SELECT "column", round(share, 6) AS share FROM es WHERE share < 0.5 AND "column" IN (SELECT "column" FROM bs)""")
def low_importance_columns(spark, d):
    e, b = _imps(spark, d)
    return _r(verdicts.low_importance(e, b))


@query(f"""WITH {_IMP} SELECT "column" NOT IN (SELECT "column" FROM bs) AS is_new, round(sum(share), 6) AS share, count(*) AS n FROM es GROUP BY 1""")
def importance_by_origin(spark, d):
    e, b = _imps(spark, d)
    return _r(verdicts.split_by_origin(e, b))


@query(f"""WITH {_IMP} SELECT "column", round(share, 6) AS share FROM es WHERE share <= (SELECT quantile_cont(share, 0.02) FROM es) AND share < 0.05""")
def bottom_features(spark, d):
    return _r(verdicts.bottom_features(_imps(spark, d)[0]))


# --- names and text ---


@query("""SELECT c_custkey AS key, trim(replace(replace(replace(replace(replace(coalesce(CASE WHEN c_nationkey = 3 THEN NULL ELSE concat(' a,"', c_name, '"', chr(10), 'x ') END, ''), ',', '_'), '"', ''), '''', ''), chr(13), ' '), chr(10), ' ')) AS clean FROM customer""")
def cleaned_text(spark, d):
    df = _table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_nationkey") != 3, F.concat(F.lit(' a,"'), F.col("c_name"), F.lit('"\nx '))).alias("clean"))
    return tables.clean_text(df, ["clean"])


@query(f"WITH {SQL_ORDERS} SELECT key, (total > 200000)::int AS baseline_prediction, (total > 210000)::int AS enhanced_prediction, (total > 200000) = (total > 210000) AS models_agree FROM ords")
def model_comparison(spark, d):
    o = _orders(spark, d)
    return tables.comparison(o.select("key", (F.col("total") > 200000).cast("int").alias("prediction")), o.select("key", (F.col("total") > 210000).cast("int").alias("prediction")), "key")


@query(f"WITH {SQL_ORDERS} SELECT avg(((total > 200000) <> (total > 210000))::int) AS disagreement_rate, count(*) AS n FROM ords")
def disagreement_rate(spark, d):
    return tables.disagreement(model_comparison(spark, d))


# --- plans that fit models: rows only ---


# --- suggestions by family models: linear ones, fitted on experiments that follow a formula, saved and loaded again ---

#: feature: weight, by family; a method adds a tenth of its place in the family's list.
_WEIGHTS = {
    "numerical": {"null_pct": 0.7, "unique_ratio": -0.4, "importance_rank_pct": -0.3, "relative_headroom": 0.5}, "categorical": {"n_unique": 0.02, "top_category_dominance": -0.6},
    "interaction": {"sum_null_pct": -0.5, "sum_importance": 0.9, "n_numerical_cols": 0.05}, "row": {"pct_rows_with_any_missing": 0.4, "n_numeric_cols_used": -0.05},
}
_SUGGESTED_ON = ["l_quantity AS quantity", "l_extendedprice AS price", "nullif(l_tax, 0.0) AS tax", "l_returnflag AS flag", "l_linestatus AS status", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label"]
_IMPORTANT = {"quantity": 0.1, "price": 0.4, "tax": 0.2, "flag": 0.25, "status": 0.05}


def _experiments(spark, d, family: str) -> DataFrame:
    """Results of experiments: a row for each part, whose change in quality follows the family's formula exactly."""
    methods = families.METHODS[family]
    features = {f: f"((p_partkey * {7 * i + 3}) % 101) / 101.0D" for i, f in enumerate(_WEIGHTS[family])}
    place = f"p_partkey % {len(methods)}"
    target = " + ".join(f"{w} * {features[f]}" for f, w in _WEIGHTS[family].items()) + f" + ({place} + 1) / 10.0D"
    return _table(spark, d, "part").selectExpr(f"array({', '.join(repr(m) for m in methods)})[{place}] AS method", "concat('d', p_partkey % 20) AS dataset_name", *(f"{x} AS {f}" for f, x in features.items()), f"{target} AS cohens_d")


def _family_store(spark, d) -> str:
    """A store with a linear model of each family, in the folder that driver and executors share."""
    folder = f"{shared_folder(spark)}/families-{uuid.uuid4().hex}"
    for family, weights in _WEIGHTS.items():
        order = [*weights, *(f"method_{m}" for m in families.METHODS[family])]
        families.train(_experiments(spark, d, family), family, "cohens_d", order, LinearRegression(fitIntercept=False)).save(folder)
    return folder


def _suggestion_sql() -> str:
    effect = lambda f: "CASE method " + " ".join(f"WHEN '{m}' THEN {(i + 1) / 10}" for i, m in enumerate(families.METHODS[f])) + " END"
    values = lambda f: "(VALUES " + ", ".join(f"('{m}')" for m in families.METHODS[f]) + ") AS v(method)"
    num, cats = ("quantity", "price", "tax"), ("flag", "status")
    one = _each(list(num), "SELECT '{c}' AS \"column\", 1 - count({c}) / count(*) AS g, count(DISTINCT {c}) AS n_u, count(DISTINCT {c}) / count(*) AS u, min({c}) AS lo, count(*) FILTER ({c} = 0 OR {c} IS NULL) AS z FROM src")
    cat = _each(list(cats), "SELECT '{c}' AS \"column\", 1 - count({c}) / count(*) AS g, count(DISTINCT {c}) AS u, (SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM src GROUP BY {c}) AS x) AS top FROM src")
    imps = "(VALUES " + ", ".join(f"('{c}', {v}, {sorted(_IMPORTANT.values(), reverse=True).index(v) + 1} / 5)" for c, v in _IMPORTANT.items()) + ') AS i("column", imp, pct)'
    gate = "CASE WHEN method IN ('impute_median', 'missing_indicator') THEN g > 0 WHEN g > 0.5 OR n_u = 2 THEN false WHEN method = 'sqrt_transform' THEN lo >= 0 WHEN method = 'quantile_binning' THEN u >= 0.01 ELSE true END"
    additive = ", ".join(f"'{m}'" for m in candidates.ADDITIVE)
    return f"""WITH src AS (SELECT {', '.join(_SUGGESTED_ON)} FROM lineitem), one AS ({one}), cat AS ({cat}), imps AS (SELECT * FROM {imps}),
        sides AS (SELECT "column", g, n_u AS u, z, imp, true AS num FROM one JOIN imps USING ("column") UNION ALL SELECT "column", g, u, 0, imp, false FROM cat JOIN imps USING ("column")),
        rows AS (SELECT avg((tax IS NULL)::int) AS missing FROM src),
        c AS (SELECT 'numerical' AS type, "column", NULL AS column_b, method, 0.7 * g - 0.4 * u - 0.3 * pct + 0.5 * 0.2 + {effect('numerical')} AS raw FROM one JOIN imps USING ("column"), {values('numerical')} WHERE {gate}
            UNION ALL SELECT 'categorical', "column", NULL, method, 0.02 * u - 0.6 * top + {effect('categorical')} FROM cat, {values('categorical')} WHERE CASE method WHEN 'missing_indicator' THEN g > 0 WHEN 'onehot_encoding' THEN u BETWEEN 2 AND 10 WHEN 'hashing_encoding' THEN u > 10 ELSE true END
            UNION ALL SELECT 'interaction', a."column", b."column", method, -0.5 * (a.g + b.g) + 0.9 * (a.imp + b.imp) + 0.05 * (a.num::int + b.num::int) + {effect('interaction')} FROM sides AS a JOIN sides AS b ON (a.num = b.num AND a.imp > b.imp) OR (a.num AND NOT b.num), {values('interaction')}
                WHERE CASE WHEN method = 'division_interaction' THEN a.num AND b.num AND b.z = 0 WHEN method LIKE 'group%' THEN a.num AND NOT b.num WHEN method = 'cat_concat' THEN NOT a.num ELSE a.num AND b.num END
            UNION ALL SELECT 'row', '(all numeric cols)', NULL, method, greatest(0, 0.4 * missing - 0.05 * 3 + {effect('row')}) FROM rows, {values('row')} WHERE method <> 'row_missing_stats' OR missing > 0),
        z AS (SELECT *, CASE WHEN type = 'row' THEN raw ELSE (raw - avg(raw) OVER (PARTITION BY type)) / stddev_pop(raw) OVER (PARTITION BY type) END AS delta FROM c)
        SELECT type, "column", column_b, method, round(raw::double, 5) AS predicted_delta_raw, round(delta::double, 5) AS predicted_delta FROM z
        QUALIFY type IN ('interaction', 'row') OR method IN ({additive}) OR row_number() OVER (PARTITION BY type, "column", method IN ({additive}) ORDER BY delta DESC) = 1"""


@query(_suggestion_sql())
def suggestions(spark, d):
    """Suggestions for lineitem, scored by the models of the store."""
    given = spark.createDataFrame(list(_IMPORTANT.items()), "column string, importance double")
    found = recommend.suggestions(_table(spark, d, "lineitem").selectExpr(*_SUGGESTED_ON), "label", given, families.load(spark, _family_store(spark, d)), baseline=(0.8, 0.02))
    return _r(found.select("type", "column", "column_b", "method", "predicted_delta_raw", "predicted_delta"), 5)


@query(
    f"WITH src AS (SELECT {', '.join(_SUGGESTED_ON)} FROM lineitem), s AS (SELECT count(*) AS n, (SELECT 'leakage') AS category FROM src) SELECT category, 'high' AS severity, '1 columns may give the label away' AS title, 'copy: rank correlation' AS detail FROM s UNION ALL SELECT 'Small Dataset', 'medium', 'few rows: keep the model simple', n || ' rows' FROM s WHERE n < 500"
)
def leakage_advisories(spark, d):
    """What the plan advises where a column follows the label."""
    df = _table(spark, d, "lineitem").selectExpr(*_SUGGESTED_ON, "CASE WHEN l_returnflag = 'R' THEN 7 ELSE 0 END AS copy").select("quantity", "copy", "label")
    related = meta.spearman_with_target(df, ["quantity", "copy"], "label").select("column", F.col("spearman").alias("spearman_corr_target"), F.lit(0.0).alias("mutual_info_score"))
    return recommend.advisories(df, "label", [related]).select("category", "severity", "title", "detail")


@query(
    """WITH r AS (SELECT p_partkey % 3 AS fold, p_size / 10.0 AS label, (p_retailprice - 900) / 40 AS said FROM part), s AS (SELECT *, (label > 2)::int AS y, (said > 2)::int AS yes, rank() OVER (PARTITION BY fold ORDER BY said) + (count(*) OVER (PARTITION BY fold, said) - 1) / 2 AS r FROM r)
    SELECT fold::int AS fold, round(avg(abs(label - said)), 5) AS mae, round(sqrt(avg(pow(label - said, 2))), 5) AS rmse, round(1 - avg(pow(label - said, 2)) / var_pop(label), 5) AS r2, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 5) AS auc,
    round(2 * sum(y * yes) / (sum(y) + sum(yes)), 5) AS f1, round(sum(y * yes) / sum(yes), 5) AS precision, round(sum(y * yes) / sum(y), 5) AS recall, round(avg((y = yes)::int), 5) AS accuracy FROM s GROUP BY fold"""
)
def family_measures(spark, d):
    rows = _table(spark, d, "part").selectExpr("CAST(p_partkey % 3 AS INT) AS fold", "p_size / 10.0D AS label", "(p_retailprice - 900) / 40 AS said").selectExpr("*", "CAST(label > 2 AS DOUBLE) AS positive", "said AS rank", "said > 2 AS yes")
    return _r(families.measures(rows).drop("median_ae"), 5)


@query()
def family_cross_validation(spark, d):
    """Regression and classification of the interaction family over folds of whole datasets, with the default trees."""
    from pyspark.ml.classification import GBTClassifier

    rows = _experiments(spark, d, "interaction").withColumn("cohens_d", F.col("cohens_d") - 1)
    order = [*_WEIGHTS["interaction"], *(f"method_{m}" for m in families.METHODS["interaction"])]
    return families.cross_validated(rows, "interaction", "cohens_d", "dataset_name", order, classifier=GBTClassifier(seed=42, maxIter=20, maxDepth=4))


@query()
def compared_models(spark, d):
    df = _table(spark, d, "orders").selectExpr("o_orderkey AS key", "o_totalprice AS total", "o_custkey AS customer", "o_orderpriority AS priority", "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS label")
    return recommend.compare_models(df, "label", "key", [Step("log_transform", "total"), Step("frequency_encoding", "priority")], {"maxIter": 3, "maxDepth": 3})


@query()
def baseline_importances(spark, d):
    df = _table(spark, d, "orders").selectExpr("o_totalprice AS total", "o_custkey AS customer", "o_orderpriority AS priority", "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS label")
    return models.baseline_importances(df, "label", 2, {"maxIter": 3, "maxDepth": 3})


@query()
def experiment_results(spark, d):
    df = _table(spark, d, "orders").selectExpr("o_orderkey AS key", "o_totalprice AS total", "o_orderpriority AS priority", "CASE WHEN o_totalprice + 50000 * (o_custkey % 3) > 250000 THEN 1 ELSE 0 END AS label")
    return collect.results(collect.collect(df, "label", "key", "orders", folds=3, repeats=1, params={"maxIter": 2, "maxDepth": 3}))


@query()
def tree_accuracies(spark, d):
    df = _table(spark, d, "orders").selectExpr("o_orderkey AS key", "o_totalprice AS total", "o_orderpriority AS priority", "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS label")
    rows = [("landmarking_score", models.landmarking_score(df, "label", "key")), ("pps_score", models.pps_score(df, "priority", "label", "key"))]
    return spark.createDataFrame(rows, "measure string, value double")


_POOL = ["l_partkey AS part", "3 * l_partkey + 1 AS code", "l_suppkey AS supplier", "l_quantity AS quantity", "l_discount AS discount", "l_returnflag AS flag", "concat(l_returnflag, '!') AS copy", "l_linestatus AS status", "CAST(l_shipdate AS DATE) AS day", "concat(l_partkey, '/', l_suppkey, '/', l_extendedprice) AS line"]
_POOL_NUM = ["part", "code", "supplier", "quantity", "discount"]
_POOL_ALL = [x.rsplit(" ", 1)[1] for x in _POOL]


@query(f"""WITH src AS (SELECT {', '.join(_POOL)} FROM lineitem), u AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, {c in _POOL_NUM} AS num, count(DISTINCT {c}) AS u, count(*) AS n FROM src" for c in _POOL_ALL)}),
    t AS (SELECT *, u / n AS imp, row_number() OVER (PARTITION BY num ORDER BY u DESC, c) AS k FROM u),
    p AS (SELECT a.c AS a, b.c AS b, CASE WHEN a.num AND b.num THEN 'nn' WHEN a.num THEN 'nc' ELSE 'cc' END AS kind, a.k AS ak, b.k AS bk, greatest(a.imp, b.imp) AS top FROM t AS a JOIN t AS b ON (a.num = b.num AND a.k < b.k) OR (a.num AND NOT b.num))
    SELECT a, b, kind, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'nc' THEN bk ELSE ak END, CASE WHEN kind = 'nc' THEN ak ELSE bk END) AS rank FROM p
    WHERE (a, b) NOT IN (('code', 'part'), ('part', 'code'), ('flag', 'copy'), ('copy', 'flag')) AND (kind <> 'cc' OR top <= 0.5) QUALIFY rank <= CASE kind WHEN 'nn' THEN 30 WHEN 'nc' THEN 20 ELSE 10 END""")
def pair_pools(spark, d):
    """Pairs by importances that are the columns' shares of distinct values; near bijections don't count against the caps."""
    df = _table(spark, d, "lineitem").selectExpr(*_POOL)
    own = profile.base_stats(df).select("column", F.col("column").isin(*_POOL_NUM).alias("numeric"), F.col("unique_ratio").alias("importance"), "unique_ratio")
    near = candidates.near_bijections(df, list(combinations(sorted(_POOL_ALL), 2))).where("near_bijection")
    return candidates.pair_pool(own, near)


@query("""WITH n AS (SELECT CASE WHEN l_linenumber = 1 AND l_quantity < 10 THEN 'rare' ELSE l_returnflag END AS label, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT count(*) AS k, max(n) / min(n) AS ratio, max(n) / sum(n) AS dominant FROM n) SELECT 'imbalance' AS type, '(model parameter)' AS "column", 'class_weight_balance' AS method, 1.0::double AS predicted_delta, 0.0::double AS predicted_delta_raw, true AS pinned, dominant, CASE WHEN k = 2 THEN 'binary' WHEN ratio > 15 OR dominant > 0.65 THEN 'none' ELSE 'multiclass_moderate' END AS strategy, ratio, k <> 2 AND NOT (ratio > 15 OR dominant > 0.65) AS auto_checked FROM o WHERE ratio >= 5""")
def imbalance_suggestion(spark, d):
    df = _table(spark, d, "lineitem").selectExpr("CASE WHEN l_linenumber = 1 AND l_quantity < 10 THEN 'rare' ELSE l_returnflag END AS label")
    return candidates.imbalance_suggestion(prepare.class_counts(df, "label")).drop("column_b")


_SUGGESTED = """SELECT "column", method, round(delta::double, 6) AS predicted_delta, 0.0::double AS predicted_delta_raw, pinned FROM d JOIN (VALUES {rows}) AS v(kind, method, delta, pinned) USING (kind)"""
_DATES = ", ".join(f"('{k}', 'date_{m}', {x}, {str(m == 'features').lower()})" for k, own in (("date", ("month", "dow", "dom")), ("datetime", ("month", "dow", "dom", "hour")), ("time", ("hour",))) for m, x in (("features", 0.5), *((f"cyclical_{p}", round(0.49 - 0.001 * i, 6)) for i, p in enumerate(own, 1))))


def _fixed_deltas(found: DataFrame) -> DataFrame:
    return found.select("column", "method", F.round("predicted_delta", 6).alias("predicted_delta"), "predicted_delta_raw", "pinned")


@query(f"""WITH s AS (SELECT count(*) AS n, count(DISTINCT ts::date) AS days, avg((hour(ts) <> 0)::int) AS hours FROM events),
    d AS (SELECT 'moment' AS "column", CASE WHEN hours >= 0.2 AND days < greatest(3, floor(0.02 * n)) THEN 'time' WHEN hours >= 0.2 THEN 'datetime' ELSE 'date' END AS kind FROM s UNION ALL SELECT 'day', 'date' FROM s WHERE n >= 5)
    {_SUGGESTED.format(rows=_DATES)}""")
def date_suggestions(spark, d):
    df = _table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("moment"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("kind"))
    return _fixed_deltas(candidates.date_suggestions(profile.date_stats(df)))


@query(f"""WITH d AS (SELECT 'day' AS "column", 'weekday' AS kind FROM orders HAVING count(*) >= 3) {_SUGGESTED.format(rows="('weekday', 'dow_ordinal', 0.5, true), ('weekday', 'dow_cyclical', 0.49, false)")}""")
def weekday_suggestions(spark, d):
    df = _table(spark, d, "orders").select(F.date_format("o_orderdate", "EEEE").alias("day"), "o_orderpriority")
    return _fixed_deltas(candidates.weekday_suggestions(profile.weekday_stats(df)))


@query(f"""WITH d AS (SELECT 'text' AS "column", 'text' AS kind FROM documents HAVING avg(length(text)) > 30 AND count(DISTINCT text) > 0.1 * count(*)
    UNION ALL SELECT 'source', 'text' FROM documents HAVING avg(length(source)) > 30 AND count(DISTINCT source) > 0.1 * count(*)) {_SUGGESTED.format(rows="('text', 'text_stats', 0.5, true), ('text', 'text_tfidf', 0.5, true)")}""")
def text_suggestions(spark, d):
    return _fixed_deltas(candidates.text_suggestions(profile.text_stats(_table(spark, d, "documents").select("text", "source"))))


@query()
def family_model(spark, d):
    rows = _table(spark, d, "lineitem").selectExpr("concat('d', l_suppkey % 10) AS dataset_name", "l_quantity AS q", "l_discount AS r", "l_extendedprice / l_quantity AS cohens_d")
    return models.train_family_model(rows, ["q", "r", "absent"], "cohens_d", "dataset_name", 2, {"maxIter": 2, "maxDepth": 3})[1]
