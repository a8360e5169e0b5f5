"""One query per operator over the driver's tables, with equivalent SQL where SQL can say it.

The tables have no charts, so the operators run on relations of the same shape:
events as a prediction log, line items as points (an order is a sample, a return
flag a series), and predictions derived from them by arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeframe.functions import numbers as N
from gradeframe.functions import text as T
from gradeframe.functions.assignment import assign_series
from gradeframe.functions.parsing import canonical_json, parse_prediction
from gradeframe.functions.pipes import with_points
from gradeframe.operators import diagnostics as D
from gradeframe.operators import log as L
from gradeframe.operators import scoring as S
from gradeframe.operators import tables as P
from gradeframe.operators.matching import keyed, match_points
from gradeframe.operators.ranks import median, middles
from gradeframe.operators.synth import specs_of, stacked, stacked_values, with_gold
from gradeframe.plans.evaluate import imperfect, probe, samples, sweep
from gradeframe.sources.corpus import materialise, smallest, with_ordinals
from gradeframe.sources.shared import ROWS, parts, spread_out
from gradeframe.types import PROPERTIES, SERIES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- logs ------------------------------------------------------------------


def event_log(spark: SparkSession, d: str) -> DataFrame:
    error = F.when(F.col("event_type") == "error", F.lit("failed"))
    return read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), "event_type", "value", error.alias("gen_error"))


LAST = "SELECT user_id AS id, max(event_id) AS ord, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id"


@query(LAST)
def log_last_write_wins(spark, d):
    return L.compact(event_log(spark, d)).select("id", "ord", "event_type", "value")


@query(f"SELECT id, ord FROM ({LAST}) WHERE event_type <> 'error'")
def log_resume_view(spark, d):
    return L.resume_view(event_log(spark, d)).select("id", "ord")


@query(f"SELECT id, CASE WHEN event_type = 'error' THEN 'failed' END AS error, CASE WHEN event_type <> 'error' THEN value END AS parsed FROM ({LAST})")
def log_scoring_view(spark, d):
    v = L.scoring_view(event_log(spark, d))
    return v.select("id", F.col("gen_error").alias("error"), F.when(~L.is_error(F.col("gen_error")), F.col("value")).alias("parsed"))


@query(f"SELECT quantile_disc(value, 0.5 ORDER BY value DESC) AS median_seconds, round(avg(ord), 6) AS mean_tokens FROM ({LAST})")
def log_timing(spark, d):
    t = L.timing(L.compact(event_log(spark, d)), "value", "ord")
    return t.select("median_seconds", F.round("mean_tokens", 6).alias("mean_tokens"))


@query(f"SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM ({LAST}) l WHERE l.id = o_custkey AND l.event_type <> 'error') GROUP BY ALL")
def resume_antijoin(spark, d):
    work = read(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    return L.pending(work, event_log(spark, d)).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# ---- text and numbers --------------------------------------------------------

SQL_NORM = "regexp_replace(replace(lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))), 'ß', 'ss'), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"


@query(f"SELECT p_partkey, {SQL_NORM.format('m')} AS label FROM (SELECT p_partkey, '  ' || upper(p_name) || '   (' || p_brand || '):! ' AS m FROM part)")
def text_normalize(spark, d):
    messy = F.concat(F.lit("  "), F.upper("p_name"), F.lit("   ("), "p_brand", F.lit("):! "))
    return read(spark, d, "part").select("p_partkey", T.normalize_text(messy).alias("label"))


@query(
    f"""SELECT source, count(*) AS n, round(avg(CASE WHEN toxic IS NOT NULL THEN ok END), 6) AS toxic_accuracy, round(avg(ok), 6) AS accuracy FROM (
    SELECT source, toxic, ({SQL_NORM.format('lang')} = {SQL_NORM.format("CASE WHEN d.doc_id % 7 = 0 THEN source ELSE ' ' || upper(lang) || '!' END")})::INT::DOUBLE AS ok
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY source"""
)
def label_accuracy(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id", "lang", "source"), read(spark, d, "labels")
    pred = F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise(F.concat(F.lit(" "), F.upper("lang"), F.lit("!")))
    ok = T.text_correct(F.col("lang"), pred).cast("double")
    rows = docs.join(labels, "doc_id", "left").withColumn("ok", ok)
    masked = F.avg(F.when(F.col("toxic").isNotNull(), F.col("ok")))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(masked, 6).alias("toxic_accuracy"), F.round(F.avg("ok"), 6).alias("accuracy"))


#: Awkward numbers by line: template and what it should read as, in terms of q (whole number).
CELLS = (("' ' || q || ' '", "q"), ("q || '.5'", "q + 0.5"), ("q || ',000'", "q * 1000"), ("q || '_000'", "q * 1000"), ("q || 'd'", "NULL"), ("'1e999'", "NULL"), ("'-' || q", "-q"))


def cases(parts: tuple, which: int) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {p[which]}" for i, p in enumerate(parts)) + " END"


LINES = "(SELECT *, l_quantity::BIGINT AS qq, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rn FROM lineitem)"


def sql_cells(parts: tuple) -> str:
    return f"SELECT k, qq AS quantity, count(*) AS n, ({cases(parts, 1).replace('q', 'qq')})::DOUBLE AS number FROM (SELECT l_quantity::BIGINT AS qq, (l_orderkey * 7 + l_linenumber) % {len(parts)} AS k FROM lineitem) GROUP BY ALL"


def cells(spark, d, parts, read_cell: Callable[[Column], Column]) -> DataFrame:
    k = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(parts)
    rows = read(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("quantity"), k.alias("k"))
    counted = rows.groupBy("k", "quantity").agg(F.count("*").alias("n")).withColumn("q", F.col("quantity").cast("string"))
    return counted.select("k", "quantity", "n", read_cell(F.expr(cases(parts, 0))).alias("number"))


@query(sql_cells(CELLS))
def as_float_cells(spark, d):
    return cells(spark, d, CELLS, N.as_float)


TABLE_CELLS = (
    ("' $' || q || ' '", "q"), ("q || '%'", "q"), ("'(' || q || ')'", "q"), ("'n/a'", "NULL"), ("' -- '", "NULL"), ("q || '-99'", "q"),
    ("'1,' || q || '000.5'", "('1' || q || '000.5')::DOUBLE"), ("'- ' || q", "-q"), ("'none at all'", "NULL"), ("'approx 0.5 of ' || q", "0.5"),
)


@query(sql_cells(TABLE_CELLS))
def parse_number_cells(spark, d):
    return cells(spark, d, TABLE_CELLS, N.parse_number)


#: Gold and predicted points of every line item.
SQL_POINTS = """SELECT l_orderkey AS sample, l_returnflag AS series, l_linenumber AS line, l_extendedprice AS g,
  l_extendedprice * ((l_partkey % 13) + 94)::DOUBLE / 100 * CASE WHEN l_orderkey % 17 = 0 THEN 1000.0 ELSE 1.0 END AS p, l_suppkey % 11 <> 0 AS has_p FROM lineitem"""


def points(spark, d, n: int = 0) -> DataFrame:
    """Points of line items; n: into how many partitions they will be dealt by sample."""
    p = F.col("l_extendedprice") * (F.col("l_partkey") % 13 + 94).cast("double") / 100 * F.when(F.col("l_orderkey") % 17 == 0, 1000.0).otherwise(1.0)
    return spread_out(read(spark, d, "lineitem"), n, "l_orderkey").select(
        F.col("l_orderkey").alias("sample"), F.col("l_returnflag").alias("series"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("g"), p.alias("p"), (F.col("l_suppkey") % 11 != 0).alias("has_p")
    )


SQL_ERROR = "CASE WHEN abs(g) < 1e-9 THEN CASE WHEN abs(p) < 1e-9 THEN 0 ELSE 'inf'::DOUBLE END ELSE abs(p - g) / abs(g) END"


@query(f"SELECT series, count(*) AS n, count(*) FILTER (e <= 0.01) AS hits_01, count(*) FILTER (e <= 0.05) AS hits_05, count(*) FILTER (e <= 0.10) AS hits_10 FROM (SELECT *, {SQL_ERROR} AS e FROM ({SQL_POINTS})) GROUP BY series")
def relative_error_tolerances(spark, d):
    hits = [F.count_if(N.within(F.col("g"), F.col("p"), t)).alias(f"hits_{S.SHORT[t]}") for t in N.TOLERANCES]
    return points(spark, d).groupBy("series").agg(F.count("*").alias("n"), *hits)


PER_SAMPLE = f"SELECT sample, count(*) AS matched, count(*) FILTER (e <= 0.05) AS hits, median(e) AS med, avg(e) AS mean FROM (SELECT *, {SQL_ERROR} AS e FROM ({SQL_POINTS}) WHERE has_p) GROUP BY sample"


def per_sample(spark, d) -> DataFrame:
    e = points(spark, d).filter("has_p").withColumn("e", N.relative_error(F.col("g"), F.col("p")))
    return e.groupBy("sample").agg(F.count("*").alias("matched"), F.count_if(F.col("e") <= 0.05).alias("hits"), F.median("e").alias("med"), F.avg("e").alias("mean"))


@query(f"SELECT round(sum(hits) / sum(matched), 9) AS micro, round(avg(hits / matched), 9) AS macro FROM ({PER_SAMPLE})")
def micro_macro_accuracy(spark, d):
    s = per_sample(spark, d)
    return s.agg(F.round(S.micro_average(F.col("hits"), F.col("matched")), 9).alias("micro"), F.round(F.avg(F.col("hits") / F.col("matched")), 9).alias("macro"))


@query(f"SELECT round(100 * avg(mean), 4) AS mape, round(100 * median(med), 6) AS median_ape FROM ({PER_SAMPLE})")
def ape_summary(spark, d):
    own = points(spark, d).filter("has_p").groupBy("sample").agg(F.collect_list(N.relative_error(F.col("g"), F.col("p"))).alias("errors"))
    samples = own.withColumns(S.sample_ape(F.col("errors"))).select(F.lit("all").alias("key"), "mape", "median_ape")
    both = samples.groupBy("key").agg(F.round(F.avg("mape"), 4).alias("mape")).join(median(samples, ["key"], "median_ape"), "key")
    return both.select("mape", F.round("median", 6).alias("median_ape"))


SQL_GROUPED = f"SELECT series, round(e, 1) AS digits, e FROM (SELECT *, {SQL_ERROR} AS e FROM ({SQL_POINTS}))"


@query(f"SELECT series, digits, count(*) AS n, quantile_disc(e, 0.5) AS low, quantile_disc(e, 0.5 ORDER BY e DESC) AS high, median(e) AS median FROM ({SQL_GROUPED}) GROUP BY series, digits")
def exact_medians(spark, d):
    """Both middle values and the median of all points' errors by group: many rows of few groups, with ties."""
    e = points(spark, d).select("series", N.relative_error(F.col("g"), F.col("p")).alias("e")).withColumn("digits", F.round("e", 1))
    return middles(e, ["series", "digits"], "e").select("series", "digits", "n", "low", "high", ((F.col("low") + F.col("high")) / 2).alias("median"))


@query(
    f"""WITH f(i, f) AS (VALUES (1, 1e-6), (2, 1e-3), (3, 1e-2), (4, 1e2), (5, 1e3), (6, 1e6)), p AS ({SQL_POINTS}),
    h AS (SELECT sample, i, f, count(*) AS n, count(*) FILTER (abs(p - g * f) / abs(g * f) <= 0.05) AS hits FROM p, f WHERE has_p AND abs(g) > 1e-9 AND abs(p) > 1e-9 GROUP BY ALL)
    SELECT p.sample, any_value(s.f) AS factor FROM (SELECT DISTINCT sample FROM p WHERE has_p) p LEFT JOIN
      (SELECT sample, arg_min(f, i) AS f FROM h WHERE n >= 3 AND hits >= 0.8 * n GROUP BY sample) s ON p.sample = s.sample GROUP BY p.sample"""
)
def scale_error_flags(spark, d):
    pairs = points(spark, d).filter("has_p").groupBy("sample").agg(F.collect_list(F.struct("g", "p")).alias("pairs"))
    return pairs.select("sample", N.scale_error(F.col("pairs")).alias("factor"))


# ---- matching ------------------------------------------------------------------

ORDER = "line, g, p"


def sample_parts(spark, d) -> int:
    """Partitions that samples are dealt into, by the number of their points."""
    return parts(read(spark, d, "lineitem"), 4 * ROWS)


def series_arrays(spark, d, renamed: int = 19) -> DataFrame:
    """sample, series, gold, pred: points of one series as arrays, x a label that some predictions change."""
    n = sample_parts(spark, d)
    rows = points(spark, d, n).repartition(n, "sample")
    x = lambda prefix: F.concat(prefix, F.col("line").cast("string"))
    wrong = F.when(F.col("sample") % renamed == 0, F.lit("P")).otherwise(F.lit("L"))

    def point(label: Column, y: str) -> Column:
        return F.struct(F.lit("str").alias("x_kind"), label.alias("x_str"), F.lit(None).cast("double").alias("x_num"), F.col(y).alias("y"))

    each = rows.withColumn("o", F.struct("line", "g", "p")).withColumn("gp", point(x(F.lit("L")), "g")).withColumn("pp", F.when(F.col("has_p"), point(x(wrong), "p")))
    lists = each.groupBy("sample", "series").agg(F.array_sort(F.collect_list(F.struct("o", "gp", "pp"))).alias("all"))
    return lists.select("sample", "series", F.transform("all", lambda r: r.gp).alias("gold"), F.transform(F.filter("all", lambda r: r.pp.isNotNull()), lambda r: r.pp).alias("pred"))


def matched(spark, d) -> DataFrame:
    keys = series_arrays(spark, d).withColumn("gold", keyed(F.col("gold"))).withColumn("pred", keyed(F.col("pred")))
    return keys.withColumn("m", match_points(F.col("gold"), F.col("pred")))


# Labels of one series are all of one kind, so first fit is a join on (label, nth of its label).
SQL_MATCH = f"""p AS ({SQL_POINTS}),
g1 AS (SELECT sample, series, line, g, row_number() OVER (PARTITION BY sample, series, line ORDER BY g, p) AS nth, row_number() OVER (PARTITION BY sample, series ORDER BY line, g, p) AS pos FROM p),
p1 AS (SELECT sample, series, line, p, row_number() OVER (PARTITION BY sample, series, line ORDER BY g, p) AS nth, row_number() OVER (PARTITION BY sample, series ORDER BY line, g, p) AS pos FROM p WHERE has_p),
sizes AS (SELECT sample, series, count(*) AS ng, count(*) FILTER (has_p) AS np FROM p GROUP BY ALL),
x AS (SELECT g1.sample, g1.series, g1.g, p1.p FROM g1 JOIN p1 USING (sample, series, line, nth) WHERE g1.sample % 19 <> 0),
nx AS (SELECT s.*, coalesce(c.n, 0) AS n, least(ng, np) > 0 AND coalesce(c.n, 0) < 0.5 * least(ng, np) AS fallback FROM sizes s LEFT JOIN (SELECT sample, series, count(*) AS n FROM x GROUP BY ALL) c USING (sample, series)),
z AS (SELECT g1.sample, g1.series, g1.g, p1.p FROM g1 JOIN p1 USING (sample, series, pos) JOIN nx USING (sample, series) WHERE fallback),
pairs AS (SELECT x.* FROM x JOIN nx USING (sample, series) WHERE NOT fallback UNION ALL SELECT * FROM z)"""


@query(f"WITH {SQL_MATCH} SELECT sample, series, count(*) AS n_pairs, sum((g * 100)::BIGINT)::BIGINT AS gold_cents, sum((p * 100)::BIGINT)::BIGINT AS pred_cents FROM pairs GROUP BY ALL")
def points_match_keyed(spark, d):
    pair = matched(spark, d).select("sample", "series", F.explode("m.pairs").alias("q"))
    cents = lambda c: F.sum(F.rint(F.col(c) * 100).cast("long"))
    return pair.groupBy("sample", "series").agg(F.count("*").alias("n_pairs"), cents("q.g").alias("gold_cents"), cents("q.p").alias("pred_cents"))


@query(f"WITH {SQL_MATCH} SELECT sample, series, fallback FROM nx")
def points_positional_fallback(spark, d):
    return matched(spark, d).select("sample", "series", "m.fallback")


@query(f"WITH {SQL_MATCH}, c AS (SELECT sample, series, count(*) AS k FROM pairs GROUP BY ALL) SELECT sample, series, ng - coalesce(k, 0) AS missing, np - coalesce(k, 0) AS spurious FROM sizes LEFT JOIN c USING (sample, series)")
def missing_spurious(spark, d):
    return matched(spark, d).select("sample", "series", F.col("m.missing").cast("long").alias("missing"), F.col("m.spurious").cast("long").alias("spurious"))


@query(
    """WITH RECURSIVE p AS (SELECT n_name, r_name, lower(trim(n_name)) AS a, lower(trim(r_name)) AS b FROM nation, region),
    t AS (SELECT n_name, r_name, a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0::BIGINT) AS r FROM p
      UNION ALL SELECT n_name, r_name, a, b, i + 1, list_concat([0::BIGINT], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k + 1], CASE WHEN substr(b, k, 1) = substr(a, i + 1, 1) THEN r[k] + 1 ELSE 0 END))))) FROM t WHERE i < length(a))
    SELECT n_name, r_name, round(2.0 * r[length(b) + 1] / (length(a) + length(b)), 9)::DOUBLE AS similarity FROM t WHERE i = length(a)"""
)
def series_similarity_matrix(spark, d):
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    pairs = nation.crossJoin(F.broadcast(region))  # 25 x 5 names: both tables are fixed
    return pairs.select("n_name", "r_name", F.round(T.name_similarity(F.col("n_name"), F.col("r_name")), 9).alias("similarity"))


@query("SELECT sample, unnest(range(n))::INT AS g, (n - 1 - unnest(range(n)))::INT AS p FROM (SELECT l_orderkey AS sample, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY ALL)")
def series_assignment(spark, d):
    both = series_arrays(spark, d).groupBy("sample").agg(F.array_sort(F.collect_list(F.struct(F.col("series").alias("name"), F.col("gold").alias("data")))).alias("gold"))
    both = both.withColumn("pred", F.reverse("gold"))
    return both.select("sample", F.explode(assign_series(F.col("gold"), F.col("pred"))).alias("q")).select("sample", "q.g", "q.p")


@query("SELECT sample, unnest(range(n))::INT AS g, (n - 1 - unnest(range(n)))::INT AS p FROM (SELECT l_orderkey AS sample, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY ALL)")
def series_by_data(spark, d):
    """Series without names, the predicted ones in the opposite order: only their points tell which belong together."""
    y = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 10.0).otherwise(100.0)
    point = F.struct(F.lit("num").alias("x_kind"), F.lit(None).cast("string").alias("x_str"), F.col("l_linenumber").cast("double").alias("x_num"), y.alias("y"))
    series = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), "l_returnflag").agg(F.collect_list(point).alias("data"))
    gold = series.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("l_returnflag", "data"))).alias("s")).select("sample", F.transform("s", lambda s: F.struct(F.lit(" ").alias("name"), s.data.alias("data"))).alias("gold"))
    return gold.select("sample", F.explode(assign_series(F.col("gold"), F.reverse("gold"))).alias("q")).select("sample", "q.g", "q.p")


# ---- samples and summaries --------------------------------------------------------


def sample_records(spark, d, predicted: bool = True) -> DataFrame:
    """Orders as records (gold, pred): types by priority, series by return flag; some predictions don't parse."""
    own = lambda c: F.array_sort(F.collect_list(F.struct(F.col("series").alias("name"), F.col(c).alias("data")))).cast(f"array<{SERIES}>")
    per = series_arrays(spark, d).groupBy("sample").agg(own("gold").alias("gs"), own("pred").alias("ps"))
    n = sample_parts(spark, d)
    orders = spread_out(read(spark, d, "orders"), n, "o_orderkey").select(F.col("o_orderkey").alias("sample"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    rows = orders.repartition(n, "sample").dropDuplicates(["sample"]).join(per, "sample")

    def record(title: Column, series: str) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.col("priority").alias("chart_type"), title.alias("title"), none.alias("x_label"), none.alias("y_label"), F.col(series).alias("series"))

    said = F.when(F.col("sample") % 5 == 0, F.lit("wrong")).otherwise(F.concat(F.upper("status"), F.lit("!")))
    pred = F.when(F.col("sample") % 23 != 0, record(said, "ps")) if predicted else record(F.col("status"), "gs")
    fields = F.when(F.col("sample") % 3 == 0, F.array(F.lit("series_names")))
    return rows.select(
        "sample", record(F.col("status"), "gs").alias("gold"), pred.alias("pred"), F.when(F.col("sample") % 23 == 0, F.lit("empty output")).alias("error"), F.array().cast("array<string>").alias("repairs"), fields.alias("scored_fields")
    )


SQL_SAMPLES = f"""WITH {SQL_MATCH}, o AS (SELECT DISTINCT ON (o_orderkey) o_orderkey AS sample, o_orderstatus AS status, o_orderpriority AS priority FROM orders ORDER BY o_orderkey),
pe AS (SELECT *, {SQL_ERROR} AS e FROM pairs),
s AS (SELECT sample, count(*) AS n_series, sum(ng) AS gold_points, sum(np) AS pred_points, bool_or(fallback) AS fb FROM nx GROUP BY sample),
m AS (SELECT sample, count(*) AS k, count(*) FILTER (e <= 0.01) AS h1, count(*) FILTER (e <= 0.05) AS h5, count(*) FILTER (e <= 0.10) AS h10 FROM pe GROUP BY sample),
r AS (SELECT o.sample, priority AS chart_type, o.sample % 23 <> 0 AS valid, o.sample % 3 <> 0 AS has_title, n_series, gold_points::BIGINT AS gold_points,
  CASE WHEN o.sample % 23 <> 0 THEN coalesce(k, 0) ELSE 0 END AS n_matched, CASE WHEN o.sample % 23 <> 0 THEN (gold_points - coalesce(k, 0))::BIGINT ELSE 0 END AS n_missing,
  CASE WHEN o.sample % 23 <> 0 THEN (pred_points - coalesce(k, 0))::BIGINT ELSE 0 END AS n_spurious, CASE WHEN o.sample % 23 <> 0 THEN coalesce(h1, 0) ELSE 0 END AS hits_01,
  CASE WHEN o.sample % 23 <> 0 THEN coalesce(h5, 0) ELSE 0 END AS hits_05, CASE WHEN o.sample % 23 <> 0 THEN coalesce(h10, 0) ELSE 0 END AS hits_10, o.sample % 23 <> 0 AND fb AS fallback,
  o.sample % 23 <> 0 AND o.sample % 5 <> 0 AS title_ok, o.sample % 23 <> 0 AND gold_points = pred_points AS point_count_ok FROM o JOIN s USING (sample) LEFT JOIN m USING (sample))"""


@query(f"{SQL_SAMPLES} SELECT sample, chart_type, valid, gold_points, n_matched, n_missing, n_spurious, hits_01, hits_05, hits_10, fallback, title_ok, point_count_ok, valid AND point_count_ok AND (title_ok OR NOT has_title) AS structural FROM r")
def sample_metrics(spark, d):
    s = S.score_samples(sample_records(spark, d))
    counts = [F.col(c).cast("long").alias(c) for c in ("gold_points", "n_matched", "n_missing", "n_spurious", "hits_01", "hits_05", "hits_10")]
    return s.select("sample", "chart_type", F.col("valid_json").alias("valid"), *counts, "fallback", "title_ok", "point_count_ok", "structural")


@query(
    f"""{SQL_SAMPLES}, b AS (SELECT *, CASE WHEN n_series <= 1 THEN '1' WHEN n_series <= 3 THEN '2-3' WHEN n_series <= 5 THEN '4-5' ELSE '6+' END AS bucket FROM r)
    SELECT CASE WHEN grouping(chart_type) = 0 THEN 'chart_type' WHEN grouping(bucket) = 0 THEN 'series_count' ELSE 'overall' END AS level, coalesce(chart_type, bucket, 'all') AS key, count(*) AS n,
    round(avg(valid::INT), 6) AS valid_json_rate, round(avg(CASE WHEN has_title THEN title_ok::INT END), 6) AS title_accuracy, count(*) FILTER (NOT has_title) AS n_partially_annotated,
    round(avg(point_count_ok::INT), 6) AS point_count_accuracy, round(avg((valid AND point_count_ok AND (title_ok OR NOT has_title))::INT), 6) AS exact_structural_match,
    round(coalesce(sum(hits_05) / nullif(sum(n_matched), 0), 0), 6) AS va_05, round(avg(n_matched / gold_points), 6) AS point_recall, sum(n_matched)::BIGINT AS n_matched_points, sum(n_missing)::BIGINT AS n_missing_points,
    sum(n_spurious)::BIGINT AS n_spurious_points, count(*) FILTER (fallback) AS n_positional_fallback FROM b GROUP BY GROUPING SETS ((), (chart_type), (bucket))"""
)
def summary_grouping_sets(spark, d):
    s = S.summarise(S.score_samples(sample_records(spark, d)))
    rates = [F.round(c, 6).alias(c) for c in ("valid_json_rate", "title_accuracy", "point_count_accuracy", "exact_structural_match", "va_05", "point_recall")]
    return s.select("level", "key", "n", *rates, "n_partially_annotated", "n_matched_points", "n_missing_points", "n_spurious_points", "n_positional_fallback")


@query("SELECT count(DISTINCT o_orderkey) AS n, count(DISTINCT o_orderkey) AS n_perfect FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def selfcheck_identity(spark, d):
    s = S.score_samples(sample_records(spark, d, predicted=False))
    wrong = imperfect(s).agg(F.count("*").alias("wrong"))
    return s.agg(F.count("*").alias("n")).crossJoin(F.broadcast(wrong)).select("n", (F.col("n") - F.col("wrong")).alias("n_perfect"))  # wrong is one row


def run_log(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as a manifest, and a log of two rows for each of most of them, of others that the manifest lacks too; the second row counts."""
    rows = sample_records(spark, d, predicted=False)
    gold = rows.select(F.col("sample").cast("string").alias("id"), "sample", F.struct(F.lit("bar").alias("chart_type"), "gold.title", "gold.x_label", "gold.y_label", "gold.series").alias("gold"))
    manifest = gold.select("id", "gold", F.lit(None).cast("array<string>").alias("scored_fields"), F.lit(None).cast(PROPERTIES).alias("properties"))
    said = F.when(F.col("sample") % 7 == 0, "no chart").otherwise(canonical_json(F.col("gold")))
    name = F.when(F.col("sample") % 5 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id"))
    last = F.struct(said.alias("raw"), F.when(F.col("sample") % 11 == 0, "OOM").alias("gen_error"), (F.col("sample") + 10**9).alias("ord"))
    first = F.struct(F.lit("").alias("raw"), F.lit("E").alias("gen_error"), F.col("sample").alias("ord"))
    rows = gold.filter(F.col("sample") % 3 != 0).select(name.alias("id"), F.lit(9).alias("n_tokens"), F.lit(1.5).alias("seconds"), F.explode(F.array(first, last)).alias("row"))
    return manifest, rows.select("id", "n_tokens", "seconds", "row.*")


SQL_RUN = """SELECT o_orderkey::VARCHAR AS id, o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AS valid, CASE WHEN o_orderkey % 11 = 0 THEN 'OOM' WHEN o_orderkey % 7 = 0 THEN 'no JSON object found' END AS error,
  CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN count(*) ELSE 0 END AS n_matched
  FROM (SELECT DISTINCT o_orderkey FROM orders) JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 GROUP BY o_orderkey"""


@query(SQL_RUN)
def scored_run(spark, d):
    """A run from its log: the last rows count, predictions without a gold record go, gold records without a prediction don't count."""
    return samples(*run_log(spark, d), parts=sample_parts(spark, d)).select("id", F.col("valid_json").alias("valid"), "error", F.col("n_matched").cast("long").alias("n_matched"))


@query(f"SELECT run, count(*) AS n, count(*) FILTER (valid) AS n_valid, sum(n_matched)::BIGINT AS n_matched FROM (SELECT 'a' AS run, * FROM ({SQL_RUN}) UNION ALL SELECT 'b', id, valid AND id::BIGINT % 2 = 0, error, CASE WHEN id::BIGINT % 2 = 0 THEN n_matched ELSE 0 END FROM ({SQL_RUN})) GROUP BY run")
def scored_sweep(spark, d):
    """Two arms in one plan; the second one says nothing for odd orders."""
    manifest, log = run_log(spark, d)
    silent = F.when(F.col("ord") % 2 == 0, F.col("raw")).otherwise("")
    logs = D.union_runs({"a": log, "b": log.withColumn("raw", silent)})
    s = sweep(manifest, logs, parts=sample_parts(spark, d)).groupBy("run").agg(F.count("*").alias("n"), F.count_if("valid_json").alias("n_valid"), F.sum("n_matched").alias("n_matched"))
    return s.select("run", "n", "n_valid", "n_matched")


@query(
    f"""WITH {SQL_MATCH}, l AS (SELECT sample, max(series) AS last, count(*) AS n FROM sizes GROUP BY sample), kept AS (SELECT s.* FROM sizes s JOIN l USING (sample) WHERE NOT (sample % 4 = 0 AND n > 1 AND series = last)),
    k AS (SELECT sample, count(*) AS k FROM pairs JOIN kept USING (sample, series) GROUP BY sample), g AS (SELECT sample, sum(ng)::BIGINT AS ng FROM sizes GROUP BY sample), q AS (SELECT sample, sum(np)::BIGINT AS np FROM kept GROUP BY sample)
    SELECT o_orderkey AS sample, coalesce(k, 0) AS n_matched, ng - coalesce(k, 0) AS n_missing, np - coalesce(k, 0) AS n_spurious, NOT (o_orderkey % 4 = 0 AND l.n > 1) AS series_count_ok
    FROM (SELECT DISTINCT o_orderkey FROM orders) JOIN l ON l.sample = o_orderkey JOIN g ON g.sample = o_orderkey JOIN q ON q.sample = o_orderkey LEFT JOIN k ON k.sample = o_orderkey"""
)
def unmatched_series(spark, d):
    """Predictions that lack a series, and have one that no gold series is left for."""
    rows = sample_records(spark, d)
    per = series_arrays(spark, d).groupBy("sample").agg(F.array_sort(F.collect_list(F.struct(F.col("series").alias("name"), F.col("pred").alias("data")))).cast(f"array<{SERIES}>").alias("ps"))
    short = F.when((F.col("sample") % 4 == 0) & (F.size("ps") > 1), F.slice("ps", 1, F.size("ps") - 1)).otherwise(F.col("ps"))
    pred = F.struct("gold.chart_type", "gold.title", "gold.x_label", "gold.y_label", short.alias("series"))
    s = S.score_samples(rows.drop("pred").join(per, "sample").withColumn("pred", pred).drop("ps"))
    return s.select("sample", *(F.col(c).cast("long").alias(c) for c in ("n_matched", "n_missing", "n_spurious")), "series_count_ok")


@query("SELECT o_orderkey AS sample, count(DISTINCT l_returnflag) AS n_series, count(*) AS n_points FROM (SELECT DISTINCT o_orderkey FROM orders) JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def chart_rollups(spark, d):
    r = sample_records(spark, d, predicted=False)
    return r.select("sample", F.size("gold.series").cast("long").alias("n_series"), S.n_points(F.col("gold.series")).cast("long").alias("n_points"))


# ---- parsing ----------------------------------------------------------------------

#: What an event's answer looks like, by event_id % 9, and the error and repairs it should give.
ANSWERS = (
    ("body", None, ()),
    ("'```json\n' || body || '\n```'", None, ("stripped markdown fence",)),
    ("'Sure: ' || body || ' as asked'", None, ("extracted from prose",)),
    ("''", "empty output", ()),
    ("'no chart here'", "no JSON object found", ()),
    ("replace(body, '\"data\"', '\"points\"')", None, ("data<-points",)),
    ("replace(replace(body, '\"x\"', '\"label\"'), '\"y\"', '\"value\"')", None, ("x<-label", "y<-value")),
    ("replace(body, 'bar', 'donut')", "schema violation: 1 validation error for ChartData", ()),
    ("body || ' trailing'", "invalid JSON: Extra data", ()),
)


def answers(spark, d) -> DataFrame:
    body = "concat('{\"chart_type\": \"bar\", \"series\": [{\"name\": \"', event_type, '\", \"data\": [{\"x\": \"', cast(user_id as string), '\", \"y\": ', cast(event_id as string), '}]}]}')"
    rows = read(spark, d, "events").selectExpr("event_id", "event_id % 9 AS k", f"{body} AS body")
    raw = "CASE k " + " ".join(f"WHEN {i} THEN {a[0]}" for i, a in enumerate(ANSWERS)) + " END"
    return rows.select("event_id", parse_prediction(F.expr(raw.replace("\n", "\\n"))).alias("r")).select("event_id", "r.*")


@query("SELECT unnest(['" + "', '".join(sorted(a[1] for a in ANSWERS if a[1])) + "']) AS parse_error")
def parse_error_set(spark, d):
    return S.parse_errors(answers(spark, d)).select(F.col("error").alias("parse_error"))


@query("SELECT error, count(*) AS n FROM (SELECT CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{a[1]}'" for i, a in enumerate(ANSWERS) if a[1]) + " END AS error FROM events) WHERE error IS NOT NULL GROUP BY error")
def common_errors(spark, d):
    """The most common errors from a mergeable summary; there are fewer kinds than it tracks, so it is exact."""
    return S.common_errors(answers(spark, d))


@query(
    "SELECT repair, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, unnest(CASE event_id % 9 "
    + " ".join(f"WHEN {i} THEN {list(a[2])}" for i, a in enumerate(ANSWERS) if a[2])
    + " END) AS repair FROM events) GROUP BY repair"
)
def repair_histogram(spark, d):
    return S.repair_histogram(answers(spark, d), "event_id")


@query("SELECT repair, count(*) AS n FROM (SELECT unnest(CASE event_id % 4 WHEN 0 THEN ['series<-datasets'] WHEN 1 THEN ['dropped note', 'dropped series.unit'] WHEN 2 THEN ['series<-data', 'dropped point.z'] END) AS repair FROM events) GROUP BY repair")
def alias_and_unknown_keys(spark, d):
    """Other names of the series list and keys that no record has, at each level."""
    inner = "concat('\"data\": [{\"x\": \"', cast(user_id as string), '\", \"y\": ', cast(event_id as string)"
    tops = (("datasets", "", "", ""), ("series", ', "unit": "t"', "", ', "note": 1'), ("data", "", ', "z": 0', ""), ("series", "", "", ""))
    text = [f"""concat('{{"chart_type": "bar", "{name}": [{{"name": "a", ', {inner}), '{point}}}]{series}}}]{top}}}')""" for name, series, point, top in tops]
    raw = "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(text)) + " END"
    parsed = read(spark, d, "events").select("event_id", parse_prediction(F.expr(raw)).alias("r")).select("event_id", "r.repairs")
    return S.repair_histogram(parsed, "event_id").select("repair", "n")


@query("SELECT event_id, CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{a[1]}'" for i, a in enumerate(ANSWERS) if a[1]) + " END AS error FROM events")
def parse_outcomes(spark, d):
    return answers(spark, d).select("event_id", "error")


@query("SELECT count(DISTINCT o_orderkey) AS n, count(DISTINCT o_orderkey) AS n_same FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def canonical_round_trip(spark, d):
    """Records written as JSON and read back; n_same should be n."""
    r = sample_records(spark, d, predicted=False).select(F.col("gold.series").alias("s"), "sample")
    none = F.lit(None).cast("string")
    chart = F.struct(F.lit("bar").alias("chart_type"), none.alias("title"), none.alias("x_label"), none.alias("y_label"), F.col("s").alias("series"))
    back = r.withColumn("chart", chart).withColumn("again", parse_prediction(canonical_json(F.col("chart")), False).chart)
    return back.agg(F.count("*").alias("n"), F.count_if(F.col("again").eqNullSafe(F.col("chart"))).alias("n_same"))


# ---- tables -----------------------------------------------------------------------


def rendered_tables(spark, d) -> DataFrame:
    """A pipe table for each region: its nations' customers and mean balance; some cells without a number, some rows ragged."""
    c = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.rint("c_acctbal").cast("long")).alias("b"))
    rows = read(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").fillna(0, ["n", "b"])
    value = F.when(F.col("n_nationkey") % 7 == 3, F.lit("n/a")).otherwise(F.concat(F.lit("$"), F.col("b").cast("string")))
    ragged = F.when(F.col("n_nationkey") % 11 == 5, F.lit(" | 1")).otherwise(F.lit(""))
    line = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), value, ragged, F.lit(" |"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda r: r.line), "\n")
    body = rows.groupBy("n_regionkey").agg(joined.alias("body"))
    head = F.when(F.col("n_regionkey") % 2 == 0, F.lit("| Nation | customers | balance |\n|---|---|---|\n")).otherwise(F.lit("Category | customers | balance\n"))
    return body.select("n_regionkey", F.concat(head, "body").alias("table"))


SQL_TABLE = """WITH c AS (SELECT c_nationkey, count(*) AS n, sum(round_even(c_acctbal, 0)::BIGINT)::BIGINT AS b FROM customer GROUP BY ALL),
t AS (SELECT n_regionkey, n_nationkey, n_name, coalesce(n, 0) AS n, CASE WHEN n_nationkey % 7 <> 3 THEN coalesce(b, 0) END AS b FROM nation LEFT JOIN c ON n_nationkey = c_nationkey WHERE n_nationkey % 11 <> 5),
u AS (SELECT n_regionkey, n_nationkey, 'customers' AS series, n_name AS x, n::DOUBLE AS y FROM t UNION ALL SELECT n_regionkey, n_nationkey, 'balance', n_name, b::DOUBLE FROM t WHERE b IS NOT NULL)"""


@query(f"{SQL_TABLE} SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN 'Nation' END AS x_label, series, x, y FROM u")
def pipe_table_ingest(spark, d):
    got = P.ingest(rendered_tables(spark, d)).select("n_regionkey", "gold.x_label", F.explode("gold.series").alias("s"))
    return got.select("n_regionkey", "x_label", F.col("s.name").alias("series"), F.explode("s.data").alias("p")).select("n_regionkey", "x_label", "series", F.col("p.x_str").alias("x"), F.col("p.y").alias("y"))


@query(f"{SQL_TABLE} SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN 'Nation' END AS x_label, series, x, y FROM u")
def pipe_table_lateral(spark, d):
    """The same points from a table function that is joined laterally."""
    return with_points(rendered_tables(spark, d)).select("n_regionkey", "x_label", "series", "x", "y")


@query(f"{SQL_TABLE} SELECT n_series, count(*) AS n, round(avg(p), 6) AS mean_points FROM (SELECT n_regionkey, count(DISTINCT series) AS n_series, count(*) AS p FROM u GROUP BY ALL) GROUP BY n_series")
def corpus_summary(spark, d):
    return P.summary(P.ingest(rendered_tables(spark, d))).select(F.col("n_series").cast("long").alias("n_series"), "n", F.round("mean_points", 6).alias("mean_points"))


@query(
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 29 = 0 THEN 'unparseable' WHEN s > 2 THEN 'too_many_series' WHEN n > 5 THEN 'too_dense' WHEN n = 0 THEN 'empty' ELSE 'eligible' END AS reason
    FROM (SELECT o_orderkey, count(DISTINCT l_returnflag) AS s, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)) GROUP BY reason"""
)
def eligibility_waterfall(spark, d):
    orders, items = read(spark, d, "orders").select("o_orderkey"), read(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    per = items.groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("s"), F.count("*").alias("n"))
    per_order = orders.groupBy("o_orderkey").agg(F.count("*").alias("orders"))  # counted as a join of the rows would
    rows = per_order.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = F.coalesce("n", F.lit(0)) * F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.col("orders"))
    s = F.when(F.col("o_orderkey") % 29 != 0, F.coalesce("s", F.lit(0)))
    return rows.select(P.eligibility(s, n, 2, 5).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT item_id, md5(text) AS digest FROM benchmark ORDER BY md5('7:' || item_id::VARCHAR), item_id LIMIT 20")
def seeded_sample(spark, d):
    return P.seeded_sample(read(spark, d, "benchmark"), 20, "item_id", 7).select("item_id", F.md5("text").alias("digest"))


@query("SELECT k, last_name, v FROM (SELECT r_regionkey AS k, list_sort(list(DISTINCT n_name)) AS names, max(n_nationkey) AS v, arg_max(n_name, n_nationkey) AS last_name FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL)")
def column_zip_last_wins(spark, d):
    """A table for each region with one column per nation, all under one name: the last column's value counts."""
    n = read(spark, d, "nation")
    keys = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("keys"))
    line = lambda head, c: F.concat(head, F.lit(" | "), F.array_join(F.transform("keys", c), " | "))
    table = F.concat(line(F.lit("key"), lambda _: F.lit("v")), F.lit("\n"), line(F.lit("row"), lambda k: k.cast("string")))
    got = P.ingest(keys.select(F.col("n_regionkey").alias("k"), table.alias("table"))).select("k", F.explode("gold.series").alias("s"))
    last = got.select("k", F.explode("s.data").alias("p")).select("k", F.col("p.y").cast("int").alias("v")).distinct()
    return last.join(n, F.col("v") == F.col("n_nationkey")).select("k", F.col("n_name").alias("last_name"), F.col("v").cast(n.schema["n_nationkey"].dataType).alias("v"))


# ---- probes and diagnostics -----------------------------------------------------------


@query(
    r"""WITH q AS (SELECT doc_id, p_norm, a_norm FROM (SELECT doc_id, regexp_replace(lower(trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN upper(w) WHEN doc_id % 3 = 1 THEN w || 'x' ELSE 'zzz' END, '\s+', ' ', 'g'))), '', '') AS p_norm, lower(w) AS a_norm
      FROM (SELECT doc_id, 'answer ' || source || '  ' || lang AS w0, 'answer ' || source || ' ' || lang AS w FROM documents))),
    s AS (SELECT CASE WHEN v < 0.5 THEN 0 ELSE v END AS v, (p_norm = a_norm)::INT AS e FROM (SELECT *, 1 - levenshtein(a_norm, p_norm)::DOUBLE / greatest(length(a_norm), length(p_norm)) AS v FROM q))
    SELECT round(avg(v), 4) AS anls, round(avg(e), 4) AS exact_match, count(*) AS n, 0::BIGINT AS n_errors FROM s"""
)
def anls_exact_match(spark, d):
    w = F.concat(F.lit("answer "), "source", F.lit(" "), "lang")
    said = F.when(F.col("doc_id") % 3 == 0, F.upper(w)).when(F.col("doc_id") % 3 == 1, F.concat(w, F.lit("x"))).otherwise(F.lit("zzz"))
    rows = read(spark, d, "documents").select(said.alias("prediction"), F.array(w).alias("answers"), F.lit(None).cast("string").alias("error"))
    return probe(rows)


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS question, event_id AS id FROM events")
def locale_pick(spark, d):
    """The wanted entry of a keyed value, else a default."""
    picked = T.locale_pick(F.col("props"), "k", F.lit("none"))
    return read(spark, d, "events").select("event_id", picked.alias("question"), F.col("event_id").alias("id"))


HARD = ("lang <> 'en'", "n_chars > 5000", "source = 'src0'")
NAMES = ("foreign", "long", "first_source")


@query("SELECT flag AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 9) AS share FROM (SELECT unnest([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in zip(HARD, NAMES)) + "]) AS flag FROM documents) WHERE flag IS NOT NULL GROUP BY flag")
def hard_flag_frequencies(spark, d):
    flags = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for c, n in zip(HARD, NAMES)]))
    f = D.frequencies(read(spark, d, "documents").select(flags.alias("flags")), "flags")
    return f.select("value", "n", F.round("share", 9).alias("share"))


@query("SELECT lang, count(*) AS n, round(avg((quality = 0)::INT), 9) AS failure_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def hard_flag_breakdown(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id")
    return D.failure_rates(rows, "lang", F.col("quality") == 0).select("lang", "n", F.round("failure_rate", 9).alias("failure_rate"))


@query("SELECT l_orderkey, floor(log10(max(abs(l_extendedprice))))::INT AS value_magnitude FROM lineitem GROUP BY l_orderkey")
def value_magnitude(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(N.magnitude(F.collect_list("l_extendedprice")).alias("value_magnitude"))


#: Prices at the sizes that are rounded differently, many of them on a tie's decimal text.
READABLE = "unnest([p_retailprice, p_retailprice / 100 + 0.05, p_size + 0.25, p_size / 10 + 0.35, p_size / 1000 + 0.0005, 0.0])"


@query(
    f"""SELECT p_partkey, case_nr, CASE WHEN v = 0 THEN 0 WHEN floor(log10(abs(v))) >= 3 THEN printf('%.2e', v)::DOUBLE WHEN floor(log10(abs(v))) >= 1 THEN printf('%.1f', v)::DOUBLE ELSE printf('%.3f', v)::DOUBLE END AS shown
    FROM (SELECT p_partkey, unnest(range(6))::INT AS case_nr, {READABLE} AS v FROM (SELECT p_partkey, p_retailprice::DOUBLE AS p_retailprice, p_size::DOUBLE AS p_size FROM part))"""
)
def readable_round(spark, d):
    price, size = F.col("p_retailprice").cast("double"), F.col("p_size").cast("double")
    sizes = F.array(price, price / 100 + F.lit(0.05), size + F.lit(0.25), size / 10 + F.lit(0.35), size / 1000 + F.lit(0.0005), F.lit(0.0))
    each = read(spark, d, "part").select("p_partkey", F.posexplode(sizes).alias("case_nr", "v"))
    return each.select("p_partkey", "case_nr", N.readable(F.col("v")).alias("shown"))


@query("SELECT count(*) AS n, count(*) FILTER (doc_id % 10 <> 0) AS n_identical FROM documents")
def run_diff_identity(spark, d):
    a = read(spark, d, "documents").select("doc_id", F.col("text").alias("raw"))
    b = a.withColumn("raw", F.when(F.col("doc_id") % 10 == 0, F.concat("raw", F.lit("."))).otherwise(F.col("raw")))
    return D.run_difference(a, b, "doc_id", "raw").select("n", "n_identical")


@query(
    """SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, count(*) FILTER (a = b) AS n_identical, count(*) FILTER (b IS NULL) AS n_only_first, count(*) FILTER (a IS NULL) AS n_only_second
    FROM (SELECT l_orderkey AS k, max(l_shipdate)::VARCHAR AS a FROM lineitem GROUP BY ALL) FULL JOIN (SELECT o_orderkey AS k, max(o_orderdate)::VARCHAR AS b FROM orders GROUP BY ALL) USING (k)"""
)
def run_diff_both_ways(spark, d):
    """Two runs with ids of their own: orders' last shipping days and orders' days."""
    a = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").cast("string").alias("raw"))
    b = read(spark, d, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.max("o_orderdate").cast("string").alias("raw"))
    return D.run_difference(a, b, "k", "raw")


@query("SELECT run, count(*) AS n, count(r_name) AS n_named FROM (SELECT 'nations' AS run, n_name AS name, NULL AS r_name FROM nation UNION ALL SELECT 'regions', r_name, r_name FROM region) GROUP BY run")
def run_union(spark, d):
    runs = D.union_runs({"nations": read(spark, d, "nation").select(F.col("n_name").alias("name")), "regions": read(spark, d, "region").select(F.col("r_name").alias("name"), "r_name")})
    return runs.groupBy("run").agg(F.count("*").alias("n"), F.count("r_name").alias("n_named"))


@query("SELECT doc_id, len(w)::INT AS n, len(list_distinct(w))::INT AS n_unique FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def degenerate_repetition(spark, d):
    return read(spark, d, "documents").select("doc_id", D.repetition(F.split("text", " ")).alias("r")).select("doc_id", "r.n", "r.n_unique")


@query("SELECT event_id, va_05, valid_json FROM (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS va_05, event_type <> 'error' AS valid_json FROM events) WHERE NOT (va_05 >= 0.9 AND valid_json) ORDER BY event_id LIMIT 25")
def top_failures(spark, d):
    rows = read(spark, d, "events").select("event_id", ((F.col("event_id") % 100) / 100).alias("va_05"), (F.col("event_type") != "error").alias("valid_json"))
    return D.first_failures(rows, 25, "event_id")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def semi_join_materialise(spark, d):
    path = f"{d}/events.parquet"
    chosen = with_ordinals(spark, path, "event_type").filter("event_type = 'error'")
    return materialise(spark, path, chosen, "event_id", "user_id").select("event_id", "user_id")


@query("SELECT event_id, nth, running_mean FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS nth, round(avg(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS running_mean FROM events) WHERE nth % 10 = 0")
def running_mean(spark, d):
    r = D.running_mean(read(spark, d, "events"), "value", "event_id")
    return r.select("event_id", "nth", F.round("running_mean", 9).alias("running_mean"))


@query("SELECT user_id, event_id, r AS mb_s, coalesce(r < 0.01, false) AS stalled FROM (SELECT user_id, event_id, (event_id * 1000 - lag(event_id * 1000) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 / 2.0 AS r FROM events)")
def throughput_delta(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 1000).alias("size"), F.lit(2.0).alias("s"))
    return D.throughput(rows, "user_id", "event_id", "size", "s").fillna(False, ["stalled"])


@query("SELECT p_brand, sum(p_size)::BIGINT AS total, sum(CASE WHEN p_type LIKE '%STEEL%' THEN p_size ELSE 0 END)::BIGINT AS steel FROM part GROUP BY p_brand")
def group_sums(spark, d):
    return D.group_sums(read(spark, d, "part"), "p_brand", "p_size", {"steel": F.col("p_type").contains("STEEL")})


@query(
    """SELECT user_id, quantile_disc(value, 0.5 ORDER BY value DESC) AS median_s, count(*) AS runs FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth,
    (user_id % 7)::DOUBLE AS warm FROM events) WHERE nth <= CASE WHEN warm > 3 THEN 1 ELSE 3 END GROUP BY user_id"""
)
def timing_median_of_k(spark, d):
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    rows = read(spark, d, "events").select("user_id", "value", nth.alias("nth"), (F.col("user_id") % 7).cast("double").alias("warm"))
    return D.median_of_runs(rows, "user_id", "warm", "value", "nth")


@query("SELECT p_partkey, greatest(1, round_even(p_size * 448.0 / 50, 0))::INT AS scaled, CASE WHEN 50 <= p_size * 10 THEN greatest(1, round_even(p_size * 48.0 / 50, 0))::INT ELSE greatest(1, round_even(p_size * 48.0 / 50, 0))::INT END AS shrunk FROM part")
def resize_dimensions(spark, d):
    scaled = N.scaled_side(F.col("p_size"), F.lit(50.0), 448)
    return read(spark, d, "part").select("p_partkey", scaled.alias("scaled"), N.scaled_side(F.col("p_size"), F.lit(50.0), 48, upscale=False).alias("shrunk"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'OOM' ELSE 'FAILED: ' || event_type END AS class, event_type || ': ' || substr(m, 1, 12) AS message, value > 50 AS spilled FROM
    (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'CUDA Out Of Memory at ' ELSE 'bad value at ' END || event_id AS m FROM events)"""
)
def failure_classes(spark, d):
    m = F.concat(F.when(F.col("event_id") % 4 == 0, F.lit("CUDA Out Of Memory at ")).otherwise(F.lit("bad value at ")), F.col("event_id").cast("string"))
    return read(spark, d, "events").select("event_id", T.failure_class(m, F.col("event_type")).alias("class"), T.error_text(F.col("event_type"), m, 12).alias("message"), N.over_capacity(F.col("value"), F.lit(50)).alias("spilled"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(source || '<&>' || lang || '\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS shown FROM documents")
def html_escaping(spark, d):
    return read(spark, d, "documents").select("doc_id", T.html_escape(F.concat("source", F.lit("<&>"), "lang", F.lit('"'))).alias("shown"))


@query(
    f"""{SQL_SAMPLES} SELECT sample, unnest(['JSON', 'chart type', 'title', 'x label', 'y label', 'value@5%']) AS label, unnest([CASE WHEN valid THEN 'ok' ELSE 'bad' END,
    CASE WHEN NOT has_title THEN 'n/a' WHEN valid THEN 'ok' ELSE 'bad' END, CASE WHEN NOT has_title THEN 'n/a' WHEN title_ok THEN 'ok' ELSE 'bad' END, CASE WHEN NOT has_title THEN 'n/a' WHEN valid THEN 'ok' ELSE 'bad' END,
    CASE WHEN NOT has_title THEN 'n/a' WHEN valid THEN 'ok' ELSE 'bad' END, CASE WHEN n_matched > 0 AND hits_05 / n_matched >= 0.9 THEN 'ok' ELSE 'bad' END]) AS state FROM r"""
)
def verdict_chips(spark, d):
    s = S.score_samples(sample_records(spark, d))
    columns = {c: F.col(c) for c in ("valid_json", "va_05", "chart_type_ok", "title_ok", "x_label_ok", "y_label_ok")}
    return s.select("sample", F.explode(D.chips(columns, F.col("fields"))).alias("c")).select("sample", "c.label", "c.state")


@query("SELECT doc_id, quality IS NOT NULL AS scores_quality, quality IS NOT NULL AND toxic IS NOT NULL AS complete FROM documents LEFT JOIN labels USING (doc_id)")
def scored_field_masks(spark, d):
    rows = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    fields = F.array_compact(F.array(F.when(F.col("toxic").isNotNull(), F.lit("toxic")), F.when(F.col("quality").isNotNull(), F.lit("quality"))))
    return rows.withColumn("f", fields).select("doc_id", F.array_contains("f", "quality").alias("scores_quality"), S.fully_annotated(F.col("f"), ("quality", "toxic")).alias("complete"))


@query("SELECT l_orderkey, l_linenumber, n, sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT - n AS base FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT)::BIGINT AS n FROM lineitem GROUP BY ALL)")
def stacked_baseline(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    return stacked(rows.withColumn("place", F.lit(0)), "l_orderkey", "l_linenumber", "place", "n").drop("place")


# ---- generator and sources ---------------------------------------------------------


def charts(spark: SparkSession, d: str, seed: int) -> DataFrame:
    """A generated chart for each order. Numbers are few bytes and charts many, so they are dealt by their count."""
    orders = read(spark, d, "orders")
    return specs_of(orders.select(F.col("o_orderkey").alias("nth")).repartition(parts(orders), "nth").distinct(), seed)


def sql_draw(name: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || nth || ':' || {name}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sql_specs(seed: int) -> str:
    """Relations c (charts, one for each order) and v (their values) of the generator."""
    u = lambda name: sql_draw(f"'{name}'", seed)
    value = sql_draw("'value ' || s || ' ' || j", seed)
    return f"""WITH a AS (SELECT nth, ['bar', 'line', 'pie', 'scatter', 'stacked_bar'][1 + floor({u("type")} * 5)::INT] AS kind FROM (SELECT DISTINCT o_orderkey AS nth FROM orders)),
    b AS (SELECT *, kind = 'scatter' AND {u("dense_scatter")} < 0.35 AS dense, kind NOT IN ('pie', 'scatter') AND {u("many_series")} < 0.35 AS many, kind NOT IN ('pie', 'stacked_bar') AND {u("log_axis")} < 0.35 AS log_y FROM a),
    n AS (SELECT *, CASE WHEN kind = 'pie' THEN 1 WHEN kind = 'scatter' THEN floor({u("series")} * 2) + 1 WHEN many THEN floor({u("series")} * 3) + 4 ELSE floor({u("series")} * 3) + 1 END::INT AS n_series,
      CASE WHEN dense THEN floor({u("points")} * 16) + 12 ELSE floor({u("points")} * 7) + 4 END::INT AS n_points, pow(10.0, floor({u("scale")} * 7) - 1) AS scale FROM b),
    c AS (SELECT *, printf('synth_%05d', nth) AS id, kind IN ('bar', 'line') AND n_series = 2 AND {u("dual_axis")} < 0.35 AS dual_axis, {u("no_title")} >= 0.35 AS has_title, {u("no_gridlines")} >= 0.35 AS grid,
      CASE WHEN {u("rotated_labels")} < 0.35 THEN 30 * (floor({u("turn")} * 3)::INT + 1) ELSE 0 END AS label_rotation, [80, 110, 140][1 + floor({u("dpi")} * 3)::INT] AS dpi FROM n),
    e AS (SELECT *, unnest(range(n_points)) AS j FROM (SELECT *, unnest(range(n_series)) AS s FROM c)),
    w AS (SELECT id, s, j, scale * CASE WHEN log_y THEN exp(5 * {value}) WHEN kind IN ('line', 'scatter') THEN 3 + s + 2 * sin(j / 2 + s) + {value} / 2 ELSE 1 + 4 * {value} * {value} + s / 4 END AS x FROM e),
    v AS (SELECT id, s::INT AS s, j::INT AS j, CASE WHEN x >= 1000 THEN round_even(x / pow(10.0, floor(log10(x)) - 2), 0) * pow(10.0, floor(log10(x)) - 2) WHEN x >= 10 THEN round_even(x * 10, 0) / 10 ELSE round_even(x * 1000, 0) / 1000 END AS y FROM w)"""


@query(
    f"""{sql_specs(1)} SELECT id, kind AS chart_type, n_series, n_points, log_y, dual_axis, label_rotation, grid, n_series > 1 OR kind = 'pie' AS legend, dpi, has_title, kind = 'scatter' AS numeric_x,
    (SELECT floor(log10(max(y)))::INT FROM v WHERE v.id = c.id) AS value_magnitude, concat_ws(',', CASE WHEN dense THEN 'dense_scatter' END, CASE WHEN many THEN 'many_series' END, CASE WHEN log_y THEN 'log_axis' END,
    CASE WHEN dual_axis THEN 'dual_axis' END, CASE WHEN NOT has_title THEN 'no_title' END, CASE WHEN NOT grid THEN 'no_gridlines' END, CASE WHEN label_rotation > 0 THEN 'rotated_labels' END) AS hard_flags,
    (SELECT round(sum(y), 3) FROM v WHERE v.id = c.id) AS total FROM c"""
)
def synth_records(spark, d):
    total = F.aggregate("gold.series", F.lit(0.0), lambda a, s: F.aggregate(s.data.y, a, lambda b, y: b + y))
    rows = with_gold(charts(spark, d, 1)).select("id", "properties", F.round(total, 3).alias("total")).select("id", "properties.*", "total")  # total in a step with the records, which aren't kept
    return rows.withColumn("hard_flags", F.array_join("hard_flags", ","))


@query(f"{sql_specs(1)} SELECT kind AS chart_type, count(*) AS n, count(*) AS n_perfect FROM c GROUP BY kind")
def synth_self_check(spark, d):
    """Type counts of generated charts and how many score perfectly against themselves."""
    g = with_gold(charts(spark, d, 1)).withColumn("pred", F.col("gold")).withColumn("error", F.lit(None).cast("string"))
    s = S.score_samples(g.select("gold", "pred", "error", F.array().cast("array<string>").alias("repairs"), F.lit(None).cast("array<string>").alias("scored_fields")))
    return s.groupBy("chart_type").agg(F.count("*").alias("n"), F.count_if("structural").alias("n_perfect"))


@query(f"{sql_specs(2)} SELECT id, s, j, y, round(coalesce(sum(y) OVER (PARTITION BY id, j ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS base FROM v")
def synth_stacked(spark, d):
    return stacked_values(charts(spark, d, 2)).withColumn("base", F.round("base", 3))


@query("SELECT source AS shard, sum(coalesce(strlen(text), 0))::BIGINT AS size FROM documents GROUP BY source ORDER BY size, source LIMIT 1")
def shard_choice(spark, d):
    """The documents' smallest source by bytes of text, as a shard is chosen by its bytes."""
    return smallest(read(spark, d, "documents"), "source", F.octet_length("text")).withColumnRenamed("source", "shard")
