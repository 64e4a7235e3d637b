"""Panel inputs derived from order, customer and nation tables, in DataFrame form and as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.lineage import checkpoint
from tessella.operators.features import run_features
from tessella.operators.index import dev_index, domain_scores

DOMAINS = ["economy", "income", "demography", "labor"]
EXPERT = {"economy": 0.4, "income": 0.3, "demography": 0.1, "labor": 0.2}
SCHEMES = {"equal": dict.fromkeys(DOMAINS, 0.25), "expert": EXPERT}
POPULATION = 5
YEARS = (1995, 2001)
METRICS = [
    (1, "orders", "economy", "absolute", True, True, 1.0),
    (2, "revenue", "economy", "absolute", True, True, 0.9),
    (3, "ticket", "income", "per_capita", True, True, 0.7),
    (4, "finished share", "labor", "share", False, True, 0.85),
    (5, "customers", "demography", "population", True, True, 0.96),
    (6, "urgent share", "labor", "share", None, True, 0.4),
]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_kept: dict[tuple, DataFrame] = {}


def _keep(spark: SparkSession, name: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of a session, made at its first use and checkpointed."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _kept:
        _kept[key] = checkpoint(make())
    return _kept[key]


def forget() -> None:
    """Make kept tables anew at their next use."""
    _kept.clear()


def metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, "metric_id long, metric_name string, domain string, value_type string, higher_is_better boolean, is_core boolean, coverage double")


def regions(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return rows.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("entity"), F.col("n_name").alias("region_name"), F.col("r_name").alias("district"), (F.col("n_nationkey") % 12 != 11).alias("included"))


def fact(spark: SparkSession, d: str) -> DataFrame:
    """(entity, metric_id, year, value, source): six metrics of nations by order year. Averages and shares are withheld,
    as in published statistics, where they rest on few orders, fewer than nine tenths of the year's mean of a nation."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    rows = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", F.year("o_orderdate").cast("long").alias("year")).agg(
        F.count("*").cast("double").alias("1"), F.sum("o_totalprice").alias("2"), F.avg("o_totalprice").alias("3"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("4"),
        F.countDistinct("o_custkey").cast("double").alias("5"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("6"),
    )
    means = rows.groupBy("year").agg(F.sum("1").alias("all"), F.count("*").alias("k"))
    rows = rows.join(means, "year").withColumn("few", 10 * F.col("1") * F.col("k") < 9 * F.col("all"))
    rows = rows.unpivot(["c_nationkey", "year", "few"], ["1", "2", "3", "4", "5", "6"], "metric_id", "value").withColumn("metric_id", F.col("metric_id").cast("long"))
    rows = rows.where(~(F.col("few") & F.col("metric_id").isin(3, 4, 6)))
    return rows.select(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("entity"), "metric_id", "year", "value", F.lit("orders").alias("source"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """The dense panel, kept: every job of a session that starts from it shares one computation."""
    return _keep(spark, ("features", d), lambda: run_features(fact(spark, d), regions(spark, d), metrics(spark), POPULATION, YEARS))


def wide(spark: SparkSession, d: str) -> DataFrame:
    return domain_scores(features(spark, d), metrics(spark), DOMAINS)


def dev(spark: SparkSession, d: str) -> DataFrame:
    """The index by two schemes, kept like the panel."""
    return _keep(spark, ("dev", d), lambda: dev_index(wide(spark, d), DOMAINS, SCHEMES))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Labels by a fixed rule, so that what follows from labels can be compared."""
    rows = features(spark, d).select("entity", "year").distinct()
    return rows.withColumn("cluster_id", (F.col("entity").cast("long") * F.col("entity").cast("long") + F.floor(F.col("year") / 3)) % 3)


def edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey")
    near = n.withColumn("o", F.explode(F.array(*[F.col("n_nationkey") + k for k in (-2, -1, 1, 2)])))
    name = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return near.join(n.select(F.col("n_nationkey").alias("o")), "o", "left_semi").select(name("n_nationkey").alias("src"), name("o").alias("dst"))


def canonical(spark: SparkSession, d: str, edition: int | None = None) -> DataFrame:
    """Raw long rows with the 14 canonical columns: values of orders by priority, status, nation and year in 3 editions (or one)."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.groupBy("o_orderpriority", "o_orderstatus", "n_nationkey", "n_name", F.year("o_orderdate").cast("long").alias("year"), (F.col("o_orderkey") % 3).alias("k")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    rows = rows.where(F.col("k") == edition) if edition is not None else rows
    k, key, mod = F.col("k").cast("string"), F.col("n_nationkey").cast("string"), lambda m: F.col("n_nationkey") % m
    units = F.when(F.col("o_orderpriority") == "1-URGENT", "Percent of total").when(F.col("o_orderpriority") == "2-HIGH", "thousand units").when(F.col("o_orderpriority") == "3-MEDIUM", " ND ").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "per 1000 people")
    return rows.select(
        F.col("o_orderpriority").alias("section"), F.concat(F.lit("I"), F.substring("o_orderpriority", 1, 1)).alias("indicator_code"), F.concat(F.lit("Value of orders "), "o_orderpriority").alias("indicator_name"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("subsection"), F.concat("n_name", F.when(mod(4) == 1, " with parts").when(mod(4) == 2, " without parts").otherwise("")).alias("object_name"),
        F.when(mod(8) == 7, "district").when(mod(8) == 6, "country").when(mod(8) == 5, "other").otherwise("region").alias("object_level"), F.lpad(key, 8, "0").alias("object_oktmo"), F.lpad(key, 11, "0").alias("object_okato"),
        "year", F.when(F.col("n") % 13 == 0, -99999999.0).otherwise(F.round("total", 2)).alias("indicator_value"), units.alias("indicator_unit"), F.lit(None).cast("string").alias("comment"),
        F.when(F.col("k") == 2, "no edition").otherwise(F.concat(F.lit("edition "), (2018 + F.col("k")).cast("string"), F.lit(", rev 2016"))).alias("source"), F.when(F.col("k") != 1, F.concat(F.lit("2020-01-0"), k)).alias("version_date"),
    )


def districts(spark: SparkSession, d: str) -> DataFrame:
    """Districts of the first twenty nations."""
    n = table(spark, d, "nation").where("n_nationkey < 20")
    return n.select(F.lpad(F.col("n_nationkey").cast("string"), 11, "0").alias("entity"), F.concat(F.lit("D"), F.col("n_regionkey").cast("string")).alias("district"))


def series(spark: SparkSession, d: str) -> DataFrame:
    """(entity, metric_id, year, value): mean order value of nations by priority, in quarters."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    quarter = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long")
    rows = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("entity"), F.substring("o_orderpriority", 1, 1).cast("long").alias("metric_id"), quarter.alias("year"))
    return rows.agg(F.avg("o_totalprice").alias("value"))


_METRICS_SQL = ", ".join(f"({i}::BIGINT, '{n}', '{g}', '{t}', {'NULL::BOOLEAN' if h is None else str(h).lower()}, {str(c).lower()}, {v}::DOUBLE)" for i, n, g, t, h, c, v in METRICS)
_SUM = {s: " + ".join(f"{d} * {w[d]}::DOUBLE" for d in DOMAINS) for s, w in SCHEMES.items()}
_SIDE = ", ".join(f"max(CASE WHEN domain = '{d}' THEN s END) AS {d}" for d in DOMAINS)
_ALL = ", ".join(DOMAINS)

#: Every input above as a common table expression of the same name.
CTES = f"""
mdim(metric_id, metric_name, domain, value_type, higher_is_better, is_core, coverage) AS (VALUES {_METRICS_SQL}),
regions AS (SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS entity, n_name AS region_name, r_name AS district, n_nationkey % 12 <> 11 AS included FROM nation JOIN region ON n_regionkey = r_regionkey),
base AS (SELECT c_nationkey, year(o_orderdate)::BIGINT AS year, count(*)::DOUBLE AS m1, sum(o_totalprice) AS m2, avg(o_totalprice) AS m3, avg((o_orderstatus = 'F')::INT) AS m4,
                count(DISTINCT o_custkey)::DOUBLE AS m5, avg((o_orderpriority = '1-URGENT')::INT) AS m6 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
tall AS (SELECT c_nationkey, year, few, unnest([1, 2, 3, 4, 5, 6])::BIGINT AS metric_id, unnest([m1, m2, m3, m4, m5, m6]) AS value FROM
         (SELECT *, 10 * m1 * count(*) OVER (PARTITION BY year) < 9 * sum(m1) OVER (PARTITION BY year) AS few FROM base)),
fact AS (SELECT lpad(c_nationkey::VARCHAR, 2, '0') AS entity, metric_id, year, value, 'orders' AS source FROM tall WHERE NOT (few AND metric_id IN (3, 4, 6))),
harm AS (SELECT f.entity, f.metric_id, f.year, CASE WHEN value_type = 'absolute' THEN CASE WHEN p.value > 0 THEN f.value / p.value END ELSE f.value END AS value_harmonized
         FROM fact f LEFT JOIN mdim USING (metric_id) LEFT JOIN fact p ON p.entity = f.entity AND p.year = f.year AND p.metric_id = {POPULATION}),
grid AS (SELECT r.entity, m.metric_id, y.year, h.value_harmonized FROM (SELECT DISTINCT entity FROM regions WHERE included) r, (SELECT metric_id FROM mdim WHERE is_core) m,
         (SELECT unnest(range({YEARS[0]}, {YEARS[1] + 1}))::BIGINT AS year) y LEFT JOIN harm h ON h.entity = r.entity AND h.metric_id = m.metric_id AND h.year = y.year),
pos AS (SELECT *, row_number() OVER (PARTITION BY entity, metric_id ORDER BY year) AS i FROM grid),
nb AS (SELECT *, last_value(value_harmonized IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value_harmonized IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0,
              first_value(value_harmonized IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value_harmonized IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1
       FROM pos WINDOW b AS (PARTITION BY entity, metric_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity, metric_id ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
interp AS (SELECT entity, metric_id, year, value_harmonized, CASE WHEN value_harmonized IS NOT NULL THEN value_harmonized WHEN i1 - i0 - 1 <= 2 THEN v0 + (v1 - v0) * ((i - i0)::DOUBLE / (i1 - i0)) END AS filled FROM nb),
f1 AS (SELECT entity, metric_id, year, value_harmonized, coalesce(filled, (SELECT median(filled) FROM interp x WHERE x.metric_id = interp.metric_id AND x.year = interp.year)) AS filled FROM interp),
imputed AS (SELECT entity, metric_id, year, coalesce(filled, (SELECT median(filled) FROM f1 x WHERE x.metric_id = f1.metric_id)) AS value_harmonized, value_harmonized IS NULL AS is_imputed FROM f1),
feat AS (SELECT entity, metric_id, year, value_harmonized, CASE WHEN hi = lo OR coalesce(sd, 0) = 0 THEN 0 ELSE (value_harmonized - m) / sd END AS z_value, is_imputed
         FROM imputed JOIN (SELECT metric_id, year, avg(value_harmonized) AS m, stddev_samp(value_harmonized) AS sd, min(value_harmonized) AS lo, max(value_harmonized) AS hi FROM imputed GROUP BY 1, 2) USING (metric_id, year)),
doms AS (SELECT entity, year, domain, avg(z_value * CASE WHEN higher_is_better THEN 1 ELSE -1 END) AS s FROM feat JOIN mdim USING (metric_id) GROUP BY 1, 2, 3),
wide AS (SELECT entity, year, {_SIDE} FROM doms GROUP BY 1, 2),
sums AS ({" UNION ALL ".join(f"SELECT entity, year, '{s}' AS scheme, {e} AS t, {_ALL} FROM wide" for s, e in _SUM.items())}),
dev AS (SELECT entity, year, scheme, CASE WHEN hi = lo THEN 50 ELSE 100 * (t - lo) / (hi - lo) END AS total_score, {_ALL} FROM sums JOIN (SELECT scheme, min(t) AS lo, max(t) AS hi FROM sums GROUP BY 1) USING (scheme)),
clusters AS (SELECT DISTINCT entity, year, (entity::BIGINT * entity::BIGINT + year // 3) % 3 AS cluster_id FROM feat),
edges AS (SELECT lpad(a.n_nationkey::VARCHAR, 2, '0') AS src, lpad(b.n_nationkey::VARCHAR, 2, '0') AS dst FROM nation a JOIN nation b ON abs(a.n_nationkey - b.n_nationkey) IN (1, 2)),
canon0 AS (SELECT o_orderpriority AS p, o_orderstatus AS s, n_nationkey AS nk, n_name, year(o_orderdate)::BIGINT AS year, o_orderkey % 3 AS k, sum(o_totalprice) AS total, count(*) AS n
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
canon AS (SELECT p AS section, 'I' || substr(p, 1, 1) AS indicator_code, 'Value of orders ' || p AS indicator_name, CASE WHEN s <> 'O' THEN s END AS subsection,
                 n_name || CASE nk % 4 WHEN 1 THEN ' with parts' WHEN 2 THEN ' without parts' ELSE '' END AS object_name,
                 CASE nk % 8 WHEN 7 THEN 'district' WHEN 6 THEN 'country' WHEN 5 THEN 'other' ELSE 'region' END AS object_level, lpad(nk::VARCHAR, 8, '0') AS object_oktmo, lpad(nk::VARCHAR, 11, '0') AS object_okato,
                 year, CASE WHEN n % 13 = 0 THEN -99999999 ELSE round(total, 2) END AS indicator_value,
                 CASE p WHEN '1-URGENT' THEN 'Percent of total' WHEN '2-HIGH' THEN 'thousand units' WHEN '3-MEDIUM' THEN ' ND ' WHEN '4-NOT SPECIFIED' THEN 'per 1000 people' END AS indicator_unit, NULL::VARCHAR AS comment,
                 CASE WHEN k = 2 THEN 'no edition' ELSE 'edition ' || (2018 + k)::VARCHAR || ', rev 2016' END AS source, CASE WHEN k <> 1 THEN '2020-01-0' || k::VARCHAR END AS version_date FROM canon0),
mdim0 AS (SELECT row_number() OVER (ORDER BY indicator_code, subsection NULLS FIRST) AS metric_id, indicator_code, subsection, f.n AS metric_name, f.u AS unit, f.s AS section FROM
          (SELECT indicator_code, subsection, min(struct_pack(n := indicator_name, u := indicator_unit, s := section)) AS f FROM canon GROUP BY 1, 2)),
latest AS (SELECT * EXCLUDE (r, ed) FROM (SELECT *, row_number() OVER (PARTITION BY object_okato, indicator_code, subsection, year ORDER BY ed DESC, coalesce(version_date, '') DESC, source DESC, indicator_value DESC NULLS LAST) AS r FROM
           (SELECT *, coalesce(list_max(list_transform(regexp_extract_all(source, '(20[0-9][0-9])', 1), lambda x: x::INT)), 0) AS ed FROM canon)) WHERE r = 1),
rdim AS (SELECT object_okato AS entity, f.n AS region_name, f.o AS oktmo, CASE WHEN f.n LIKE '%without%' THEN 'without' WHEN f.n LIKE '%with parts%' THEN 'with' ELSE 'none' END AS variant FROM
         (SELECT object_okato, min(struct_pack(n := object_name, o := object_oktmo)) AS f FROM canon GROUP BY 1)),
series AS (SELECT lpad(c_nationkey::VARCHAR, 2, '0') AS entity, substr(o_orderpriority, 1, 1)::BIGINT AS metric_id, (year(o_orderdate) * 4 + quarter(o_orderdate))::BIGINT AS year, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
rk AS (SELECT entity, year, scheme, total_score, row_number() OVER (PARTITION BY scheme, year ORDER BY total_score DESC, entity) AS rank FROM dev WHERE total_score IS NOT NULL),
corank AS (SELECT year, metric_id, entity, rank() OVER (PARTITION BY year, metric_id ORDER BY value_harmonized) + (count(*) OVER (PARTITION BY year, metric_id, value_harmonized) - 1) / 2.0 AS v FROM feat),
cor AS (SELECT a.year, a.metric_id AS metric_a, b.metric_id AS metric_b, CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) END AS r, count(*) AS n
        FROM corank a JOIN corank b ON a.year = b.year AND a.entity = b.entity AND a.metric_id < b.metric_id GROUP BY 1, 2, 3 HAVING r IS NOT NULL AND n >= 5),
prof AS (SELECT year, cluster_id, metric_id, avg(z_value) AS mean_z FROM feat JOIN clusters USING (entity, year) GROUP BY 1, 2, 3),
dist AS (SELECT entity, year, cluster_id, sqrt(sum((z_value - mean_z) ** 2)) AS distance FROM feat JOIN clusters USING (entity, year) JOIN prof USING (year, cluster_id, metric_id) GROUP BY 1, 2, 3),
crank AS (SELECT cluster_id, avg(total_score) AS mean_score, row_number() OVER (ORDER BY avg(total_score), cluster_id) - 1 AS rank FROM clusters JOIN dev USING (entity, year) WHERE scheme = 'equal' GROUP BY 1),
trans AS (SELECT t.*, a.rank AS from_rank, b.rank AS to_rank, b.rank - a.rank AS rank_delta FROM
          (SELECT entity, lag(year) OVER w AS year_from, year AS year_to, lag(cluster_id) OVER w AS from_cluster, cluster_id AS to_cluster FROM clusters WINDOW w AS (PARTITION BY entity ORDER BY year)) t
          JOIN crank a ON a.cluster_id = from_cluster JOIN crank b ON b.cluster_id = to_cluster WHERE year_from IS NOT NULL),
traj AS (SELECT entity, min_by(rank, year) AS initial_rank, max_by(rank, year) AS final_rank, sum(changed)::BIGINT AS n_changes FROM
         (SELECT entity, year, cluster_id, coalesce((cluster_id <> lag(cluster_id) OVER (PARTITION BY entity ORDER BY year))::INT, 0) AS changed FROM clusters) JOIN crank USING (cluster_id) GROUP BY 1),
kinds AS (SELECT entity, CASE WHEN n_changes = 0 AND final_rank >= k - 1 THEN 'stable_high' WHEN n_changes = 0 AND final_rank = 0 THEN 'stable_low' WHEN n_changes = 0 THEN 'stable_mid' WHEN final_rank - initial_rank >= 2 AND n_changes <= 2 THEN 'leapfrogger'
          WHEN final_rank - initial_rank >= 2 THEN 'converger' WHEN final_rank - initial_rank <= -2 THEN 'diverger' WHEN n_changes >= 3 THEN 'volatile' ELSE 'drifting' END AS trajectory FROM traj, (SELECT count(*) AS k FROM crank)),
b0 AS (SELECT entity, metric_id, year, value, avg(value) OVER (PARTITION BY entity, metric_id) AS m, count(*) OVER (PARTITION BY entity, metric_id) AS n FROM series),
b1 AS (SELECT *, value - m AS x, row_number() OVER w AS i, lead(year) OVER w AS nxt FROM b0 WHERE n >= 8 WINDOW w AS (PARTITION BY entity, metric_id ORDER BY year)),
b2 AS (SELECT *, sum(x) OVER u AS s1, sum(x * x) OVER u AS s2, sum(x) OVER p AS t1, sum(x * x) OVER p AS t2, sum((i - 1) * x) OVER p AS sxy0 FROM b1
       WINDOW u AS (PARTITION BY entity, metric_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY entity, metric_id)),
b3 AS (SELECT *, greatest(t2 - t1 * t1 / n - (sxy0 - t1 * (n - 1) / 2) ** 2 / ((n * n - 1) * n / 12.0), 0) AS line, round(greatest(t2 - s1 * s1 / i - (t1 - s1) ** 2 / (n - i), 0), 8) AS step, abs((t1 - s1) / (n - i) - s1 / i) AS score FROM b2 WHERE i >= 2 AND i <= n - 2),
breaks AS (SELECT entity, metric_id, nxt AS year, score FROM (SELECT *, row_number() OVER (PARTITION BY entity, metric_id ORDER BY step, i) AS r FROM b3) WHERE r = 1 AND CASE WHEN line <= 1e-12 THEN step < 1e-12 ELSE step / line <= 0.85 END),
lagged AS (SELECT scheme, year, entity, any_value(y) AS y, avg(ny) AS ny, count(*) AS n_neighbors FROM (SELECT a.scheme, a.year, a.entity, a.total_score AS y, b.total_score AS ny FROM dev a JOIN edges ON src = a.entity JOIN dev b ON b.entity = dst AND b.scheme = a.scheme AND b.year = a.year) GROUP BY 1, 2, 3),
devs AS (SELECT scheme, year, entity, y - m AS d, ny - m AS lag, n_neighbors, n FROM lagged JOIN (SELECT scheme, year, avg(y) AS m, count(*) AS n FROM lagged GROUP BY 1, 2) USING (scheme, year)),
dq AS (SELECT metric_id, year, count(*) AS cells, count(raw) AS raw_cells, count(*) FILTER (is_imputed) AS imputed_cells FROM feat LEFT JOIN (SELECT DISTINCT entity, metric_id, year, 1 AS raw FROM fact WHERE value IS NOT NULL) USING (entity, metric_id, year) GROUP BY 1, 2),
catalog AS (SELECT metric_id, metric_name, domain, is_core, coverage, CASE WHEN is_core THEN 'core' WHEN coverage >= 0.8 AND domain <> 'other' THEN 'extended' ELSE 'sparse' END AS tier, first_year, last_year, coalesce(n_years, 0) AS n_years, coalesce(n_entities, 0) AS n_entities
            FROM mdim LEFT JOIN (SELECT metric_id, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS n_years, count(DISTINCT entity) AS n_entities FROM fact WHERE value IS NOT NULL GROUP BY 1) USING (metric_id))
"""
