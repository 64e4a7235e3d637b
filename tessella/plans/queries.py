"""The registered panel queries, each with the same result in DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import contracts
from tessella.functions.lineage import shared_folder
from tessella.functions.stats import rounded
from tessella.operators import anomalies, etl, features, index, quality, ranks, spatial, typology
from tessella.plans import demo, serve
from tessella.plans.demo import DOMAINS, EXPERT, POPULATION, SCHEMES, YEARS
from tessella.sources import tables, versions
from tessella.streaming.intake import read_intake, stream_intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_DOM = ", ".join(DOMAINS)
_NAMES = ", ".join(f"'{x}'" for x in DOMAINS)
_MEAN = "(" + " + ".join(DOMAINS) + ") / 4"
LEVELS = ("region", "district", "country")


def _add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: rounded(make(spark, d))
    if sql:
        SQL[name] = sql


def oracle_sql() -> dict[str, str]:
    """Complete statements; doubles are rounded as in the queries, by an outer SELECT."""
    return {name: _rounded(sql) for name, sql in SQL.items()}


def _rounded(sql: str) -> str:
    return f"WITH {demo.CTES} SELECT {_outer(sql)}"


def _outer(sql: str) -> str:
    """``columns | body``: the columns as name or name:d for a double that is rounded."""
    columns, body = sql.split("|", 1)
    parts = [c.strip() for c in columns.split(",")]
    return ", ".join(f"round({c[:-2]}::DOUBLE, 4) + 0.0 AS {c[:-2]}" if c.endswith(":d") else f"{c[:-2]}::BIGINT AS {c[:-2]}" if c.endswith(":i") else c for c in parts) + f" FROM ({body})"


# sources and ETL
_CANON = "section, indicator_code, indicator_name, subsection, object_name, object_level, object_oktmo, object_okato, year"
_add("a1_read_canonical", lambda s, d: contracts.enforce(demo.canonical(s, d), contracts.CANONICAL), f"{_CANON}, indicator_value:d, indicator_unit, comment, source, version_date | SELECT * FROM canon")
_add("a2_null_sentinels", lambda s, d: tables.null_sentinels(demo.canonical(s, d)).groupBy("section").agg(F.count("*").alias("n"), F.count("indicator_value").alias("known"), F.sum("indicator_value").alias("total")),
     "section, n:i, known:i, total:d | SELECT section, count(*) AS n, count(nullif(indicator_value, -99999999)) AS known, sum(nullif(indicator_value, -99999999)) AS total FROM canon GROUP BY 1")
_add("a2_sentinel_hits", lambda s, d: tables.sentinel_hits(demo.canonical(s, d)), "hits:i | SELECT count(*) AS hits FROM canon WHERE indicator_value IN (-99999999, -77777777)")
_add("a3_read_sources", lambda s, d: tables.read_sources([demo.canonical(s, d).where("year < 1998"), demo.canonical(s, d).where("year >= 1998")]).groupBy("year").agg(F.count("*").alias("n")), "year:i, n:i | SELECT year, count(*) AS n FROM canon GROUP BY 1")


def _folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/store-{uuid.uuid4().hex}"


def _stored(s: SparkSession, d: str) -> DataFrame:
    """The fact as it is read back from a store, with the number of the store's tables."""
    folder = _folder(s)
    tables.write_table(demo.regions(s, d), folder, "regions")
    for _ in range(2):
        tables.write_table(demo.fact(s, d), folder, "fact")
    return tables.read_table(s, folder, "fact").withColumn("n_tables", F.lit(len(tables.list_tables(s, folder))).cast("long"))


def _taken_in(s: SparkSession, d: str) -> DataFrame:
    """Rows by year after three files: the newest edition first, then an older one of the same keys, then one without."""
    folder = _folder(s)
    for part in (1, 0, 2, None):
        if part is not None:
            demo.canonical(s, d, part).write.mode("append").parquet(f"{folder}/in")
        stream_intake(s, f"{folder}/in", f"{folder}/state", f"{folder}/out")
    return read_intake(s, f"{folder}/out").groupBy("year").agg(F.count("*").alias("n"), F.sum("indicator_value").alias("total"))


def _published(s: SparkSession, d: str) -> DataFrame:
    """What readers see after two versions that pass the gate, and one each with old years, few entities, a table missing."""
    folder, fact, regions, gate = _folder(s), demo.fact(s, d), demo.regions(s, d), versions.Gate(("regions", "fact"), (10, 40))
    tried = [(fact.where("year < 2000"), regions), (fact, regions), (fact.where("year < 1996"), regions), (fact, regions.where("entity < '05'")), (fact, None)]
    faults = [versions.publish(s, {"fact": f} | ({"regions": r} if r is not None else {}), folder, f"v{k}", gate) for k, (f, r) in enumerate(tried)]
    seen = versions.read_published(s, folder, "fact").groupBy("year").agg(F.count("*").alias("n"))
    return seen.select("year", "n", F.lit(versions.published_version(s, folder)).alias("version"), F.lit(sum(not f for f in faults)).cast("long").alias("accepted"))


_add("a4_stored_table", _stored, "entity, metric_id:i, year:i, value:d, source, n_tables:i | SELECT *, 2 AS n_tables FROM fact")
def _checked(s: SparkSession, d: str) -> DataFrame:
    """A raw file, a file of another kind, and a folder without a file."""
    folder = _folder(s)
    demo.canonical(s, d).write.parquet(f"{folder}/good")
    paths = {"good": f"{folder}/good", "other": f"{d}/orders.parquet", "none": f"{folder}/none"}
    return reduce(DataFrame.unionByName, [tables.check_incoming(s, path).withColumn("file", F.lit(name)) for name, path in paths.items()])


_MISSING = ",".join(contracts.CANONICAL)
_add("a6_check_incoming", _checked, f"file, ok, missing, rows:i | SELECT 'good' AS file, true AS ok, '' AS missing, count(*) AS rows FROM canon UNION ALL SELECT 'other', false, '{_MISSING}', count(*) FROM orders UNION ALL SELECT 'none', false, '{_MISSING}', 0")
_add("a7_stream_intake", _taken_in, "year:i, n:i, total:d | SELECT year, count(*) AS n, sum(indicator_value) AS total FROM latest GROUP BY 1")
_add("a8_publish_snapshot", _published, "year:i, n:i, version, accepted:i | SELECT year, count(*) AS n, 'v1' AS version, 2 AS accepted FROM fact GROUP BY 1")


def _vertices(s: SparkSession, d: str) -> DataFrame:
    """Vertices of a map file with a feature for each nation, as written and read back."""
    shape = '{"properties": {"entity": "%02d"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[%d.5, 0.25], [%d.5, 0.25], [%d.5, 1.0000004]]], [[[-%d, 7e1]]]]}}'
    each = demo.table(s, d, "nation").select(F.format_string(shape, *[F.col("n_nationkey") + k for k in (0, 0, 1, 1, 0)]).alias("f"))
    path = f"{_folder(s)}/map"
    each.agg(F.concat(F.lit('{"features": ['), F.array_join(F.collect_list("f"), ", "), F.lit("]}"))).write.text(path)
    return tables.read_geojson_vertices(s, path)


_add("a5_geojson_vertices", _vertices,
     "entity, x:d, y:d | SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS entity, unnest([n_nationkey + 0.5, n_nationkey + 1.5, n_nationkey + 1.5, -n_nationkey]) AS x, unnest([0.25, 0.25, 1.0, 70.0]) AS y FROM nation")
_SNAPSHOTS = {"same": "true", "old": "year < 1998", "few": "entity < '05'", "none": "false"}


def _validated(s: SparkSession, d: str) -> DataFrame:
    fact = demo.fact(s, d)
    each = [tables.validate_snapshot(fact.where(rule), fact.where("year < 2000"), 10, 40).withColumn("snapshot", F.lit(name)) for name, rule in _SNAPSHOTS.items()]
    return reduce(DataFrame.unionByName, each)


_add("a8_validate_snapshot", _validated, "snapshot, rows:i, entities:i, last_year:i, published_year:i, ok | SELECT *, coalesce(rows > 0 AND entities BETWEEN 10 AND 40 AND last_year >= published_year, false) AS ok FROM ("
     + " UNION ALL ".join(f"SELECT '{name}' AS snapshot, count(*) AS rows, count(DISTINCT entity) AS entities, max(year) AS last_year, (SELECT max(year) FROM fact WHERE year < 2000) AS published_year FROM fact WHERE {rule}" for name, rule in _SNAPSHOTS.items()) + ")")
_add("b1_metric_dim", lambda s, d: etl.build_metric_dim(demo.canonical(s, d)), "metric_id:i, indicator_code, subsection, metric_name, unit, section | SELECT * FROM mdim0")


def _with_ids(s: SparkSession, d: str) -> DataFrame:
    raw = demo.canonical(s, d)
    return etl.attach_metric_id(raw, etl.build_metric_dim(raw))


_add("b2_attach_metric_id", lambda s, d: _with_ids(s, d).groupBy("metric_id", "subsection").agg(F.count("*").alias("n")),
     "metric_id:i, subsection, n:i | SELECT metric_id, c.subsection, count(*) AS n FROM canon c LEFT JOIN mdim0 m ON c.indicator_code = m.indicator_code AND c.subsection IS NOT DISTINCT FROM m.subsection GROUP BY 1, 2")
_add("b3_level_counts", lambda s, d: etl.level_counts(demo.canonical(s, d), LEVELS), "object_level, rows:i, known | SELECT object_level, count(*) AS rows, object_level IN ('region', 'district', 'country') AS known FROM canon GROUP BY 1")
_add("b4_drop_variants", lambda s, d: etl.drop_variants(demo.canonical(s, d), "without").groupBy("object_name").agg(F.count("*").alias("n")), "object_name, n:i | SELECT object_name, count(*) AS n FROM canon WHERE object_name NOT LIKE '%without%' GROUP BY 1")
_add("b5_edition_year", lambda s, d: demo.canonical(s, d).select("source", etl.edition_year("source").alias("edition")).groupBy("source", "edition").agg(F.count("*").alias("n")),
     "source, edition:i, n:i | SELECT source, coalesce(list_max(list_transform(regexp_extract_all(source, '(20[0-9][0-9])', 1), lambda x: x::INT)), 0) AS edition, count(*) AS n FROM canon GROUP BY 1, 2")
_KEYS = ["object_okato", "indicator_code", "subsection", "year"]
_add("b6_dedup_latest", lambda s, d: etl.dedup_latest(demo.canonical(s, d), _KEYS).select(*_KEYS, "indicator_value", "source"), "object_okato, indicator_code, subsection, year:i, indicator_value:d, source | SELECT * FROM latest")
_add("b6_dedup_counts", lambda s, d: etl.dedup_counts(demo.canonical(s, d), _KEYS), "kept:i, removed:i | SELECT (SELECT count(*) FROM latest) AS kept, (SELECT count(*) FROM canon) - (SELECT count(*) FROM latest) AS removed")
_add("b6_lineitem_editions", lambda s, d: etl.dedup_latest(demo.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("edition "), F.year("l_shipdate").cast("string")).alias("source"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("version_date"), F.col("l_extendedprice").alias("value")), ["l_orderkey", "l_linenumber"], "value"),
     "l_orderkey:i, l_linenumber:i, source, version_date, value:d | SELECT * FROM (SELECT l_orderkey, l_linenumber, 'edition ' || year(l_shipdate)::VARCHAR AS source, strftime(l_shipdate, '%Y-%m-%d') AS version_date, l_extendedprice AS value, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN year(l_shipdate) >= 2000 THEN year(l_shipdate) ELSE 0 END DESC, strftime(l_shipdate, '%Y-%m-%d') DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1")
_add("b7_variant_kind", lambda s, d: demo.canonical(s, d).select("object_name", etl.variant_kind("object_name", "without", "with parts").alias("variant")).distinct(),
     "object_name, variant | SELECT DISTINCT object_name, CASE WHEN object_name LIKE '%without%' THEN 'without' WHEN object_name LIKE '%with parts%' THEN 'with' ELSE 'none' END AS variant FROM canon")
_add("b8_region_dim", lambda s, d: etl.build_region_dim(demo.canonical(s, d), demo.districts(s, d), "without", "with parts", "without"),
     "entity, region_name, oktmo, variant, district, is_variant, included | SELECT rdim.*, 'D' || n_regionkey::VARCHAR AS district, variant <> 'none' AS is_variant, variant IN ('none', 'without') AS included FROM rdim LEFT JOIN nation ON lpad(n_nationkey::VARCHAR, 11, '0') = entity AND n_nationkey < 20")
_LATEST = ["object_okato", "metric_id", "year"]
_add("b9_build_fact", lambda s, d: etl.build_fact(etl.dedup_latest(_with_ids(s, d), _LATEST)), "entity, metric_id:i, year:i, value:d, source | SELECT object_okato AS entity, metric_id, year, indicator_value AS value, source FROM latest l JOIN mdim0 m ON l.indicator_code = m.indicator_code AND l.subsection IS NOT DISTINCT FROM m.subsection")
_add("b10_fact_faults", lambda s, d: contracts.fact_faults(etl.build_fact(_with_ids(s, d).withColumn("object_okato", F.when(F.col("object_level") != "other", F.col("object_okato")))), 1996, 2025),
     "rows:i, null_keys:i, bad_years:i, duplicate_keys:i | SELECT (SELECT count(*) FROM canon) AS rows, (SELECT count(*) FROM canon WHERE object_level = 'other') AS null_keys, (SELECT count(*) FROM canon WHERE year < 1996) AS bad_years, (SELECT count(*) FROM (SELECT 1 FROM canon GROUP BY CASE WHEN object_level <> 'other' THEN object_okato END, indicator_code, subsection, year HAVING count(*) > 1)) AS duplicate_keys")
_add("b11_quality_report", lambda s, d: etl.quality_report(demo.fact(s, d), demo.regions(s, d)),
     "rows:i, metrics:i, entities:i, first_year:i, last_year:i, included:i | SELECT count(*) AS rows, count(DISTINCT metric_id) AS metrics, count(DISTINCT entity) AS entities, min(year) AS first_year, max(year) AS last_year, (SELECT count(*) FROM regions WHERE included) AS included FROM fact")
_add("b12_run_etl", lambda s, d: etl.run_etl(demo.canonical(s, d), demo.districts(s, d), "region", "with parts", "without", "with parts")["fact"],
     "entity, metric_id:i, year:i, value:d, source | SELECT object_okato AS entity, metric_id, year, indicator_value AS value, source FROM latest l JOIN mdim0 m ON l.indicator_code = m.indicator_code AND l.subsection IS NOT DISTINCT FROM m.subsection WHERE object_level = 'region' AND object_name NOT LIKE '%with parts%'")


def _map_features(s: SparkSession, d: str) -> DataFrame:
    n = demo.table(s, d, "nation")
    return n.select(F.concat(F.lit("The Republic of "), F.initcap("n_name"), F.lit(" (map)")).alias("name"), F.when(F.col("n_nationkey") % 5 == 0, F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code")).where("n_nationkey <> 7")


def _overrides(s: SparkSession, d: str) -> DataFrame:
    return demo.table(s, d, "nation").where("n_nationkey = 3").select(F.concat(F.lit("The Republic of "), F.initcap("n_name"), F.lit(" (map)")).alias("name"), F.lit("04").alias("entity"))


_CROSS = """SELECT 'The Republic of ' || array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' (map)' AS name, CASE WHEN n_nationkey % 5 = 0 THEN lpad(n_nationkey::VARCHAR, 2, '0') END AS code,
CASE WHEN n_nationkey = 3 THEN '04' ELSE lpad(n_nationkey::VARCHAR, 2, '0') END AS entity, CASE WHEN n_nationkey % 5 = 0 THEN 'code' WHEN n_nationkey = 3 THEN 'override' ELSE 'name' END AS how FROM nation WHERE n_nationkey <> 7"""
_add("b13_crosswalk_names", lambda s, d: etl.crosswalk_names(_map_features(s, d), demo.regions(s, d), _overrides(s, d)), f"name, code, entity, how | {_CROSS}")
_add("b13_uncovered", lambda s, d: etl.uncovered(demo.regions(s, d), etl.crosswalk_names(_map_features(s, d), demo.regions(s, d), _overrides(s, d))), f"entity, region_name | SELECT entity, region_name FROM regions WHERE entity NOT IN (SELECT entity FROM ({_CROSS}))")

# features
_add("c1_value_type", lambda s, d: demo.canonical(s, d).select("indicator_unit", features.classify_value_type("indicator_unit").alias("value_type")).distinct(),
     "indicator_unit, value_type | SELECT DISTINCT indicator_unit, CASE WHEN indicator_unit IS NULL OR trim(indicator_unit) = 'ND' THEN 'absolute' WHEN lower(indicator_unit) LIKE '%per 1000%' THEN 'rate' WHEN lower(indicator_unit) LIKE '%percent%' THEN 'share' ELSE 'absolute' END AS value_type FROM canon")
_COVER = f"SELECT metric_id, count(DISTINCT (entity, year)) AS cells, count(DISTINCT (entity, year)) / (SELECT count(*) * {YEARS[1] - YEARS[0] + 1} FROM regions WHERE included)::DOUBLE AS coverage FROM fact JOIN regions USING (entity) WHERE included AND value IS NOT NULL GROUP BY 1"
_add("c2_coverage", lambda s, d: features.compute_coverage(demo.fact(s, d), demo.regions(s, d), YEARS), f"metric_id:i, cells:i, coverage:d | {_COVER}")


def _enriched(s: SparkSession, d: str) -> DataFrame:
    dim = etl.build_metric_dim(demo.canonical(s, d))
    sections = dim.select("section", F.concat(F.lit("dom "), F.substring("section", 3, 20)).alias("domain")).where("section < '4'").distinct()
    return features.enrich_metric_dim(dim, demo.metrics(s).where("metric_id <= 3"), sections, features.compute_coverage(demo.fact(s, d), demo.regions(s, d), YEARS))


_add("c3_enrich_metric_dim", _enriched,
     f"metric_id:i, metric_name, domain, value_type, higher_is_better, is_core, coverage:d | SELECT a.metric_id, a.metric_name, coalesce(m.domain, CASE WHEN a.section < '4' THEN 'dom ' || substr(a.section, 3, 20) END, 'other') AS domain, coalesce(m.value_type, CASE WHEN unit IS NULL OR trim(unit) = 'ND' THEN 'absolute' WHEN lower(unit) LIKE '%per 1000%' THEN 'rate' WHEN lower(unit) LIKE '%percent%' THEN 'share' ELSE 'absolute' END) AS value_type, m.higher_is_better, m.domain IS NOT NULL AS is_core, coalesce(c.coverage, 0) AS coverage FROM mdim0 a LEFT JOIN (SELECT * FROM mdim WHERE metric_id <= 3) m USING (metric_id) LEFT JOIN ({_COVER}) c USING (metric_id)")
_add("c4_harmonize", lambda s, d: features.harmonize(demo.fact(s, d), demo.metrics(s), POPULATION), "entity, metric_id:i, year:i, value_harmonized:d | SELECT * FROM harm")
_add("c5_core_below_coverage", lambda s, d: features.core_below_coverage(_enriched(s, d), 0.95), f"metric_id:i, metric_name, coverage:d | SELECT metric_id, a.metric_name, coalesce(coverage, 0) AS coverage FROM mdim0 a LEFT JOIN ({_COVER}) USING (metric_id) WHERE metric_id <= 3 AND coalesce(coverage, 0) < 0.95")
_add("c6_core_fact", lambda s, d: features.core_fact(features.harmonize(demo.fact(s, d), demo.metrics(s), POPULATION), demo.metrics(s).where("metric_id < 5"), (1996, 1999)), "entity, metric_id:i, year:i, value_harmonized:d | SELECT * FROM harm WHERE metric_id < 5 AND year BETWEEN 1996 AND 1999")


def _grid(s: SparkSession, d: str) -> DataFrame:
    m = demo.metrics(s)
    return features.build_long_grid(features.core_fact(features.harmonize(demo.fact(s, d), m, POPULATION), m, YEARS), demo.regions(s, d), m, YEARS)


_add("c7_long_grid", _grid, "entity, metric_id:i, year:i, value_harmonized:d | SELECT * FROM grid")
_add("c8_interpolate_gaps", lambda s, d: features.interpolate_gaps(_grid(s, d), 2), "entity, metric_id:i, year:i, value_harmonized:d, filled:d | SELECT * FROM interp")
_add("c9_impute", lambda s, d: features.impute_features(_grid(s, d), 2), "entity, metric_id:i, year:i, value_harmonized:d, is_imputed | SELECT * FROM imputed")
_add("c9_imputation_gate", lambda s, d: features.imputation_gate(features.impute_features(_grid(s, d), 2), 0.15),
     "cells:i, imputed:i, still_null:i, ok | SELECT count(*) AS cells, count(*) FILTER (is_imputed) AS imputed, count(*) FILTER (value_harmonized IS NULL) AS still_null, count(*) FILTER (is_imputed) <= 0.15 * count(*) AND count(*) FILTER (value_harmonized IS NULL) = 0 AS ok FROM imputed")
_add("c10_zscore", lambda s, d: features.add_zscore(features.impute_features(_grid(s, d), 2)), "entity, metric_id:i, year:i, value_harmonized:d, z_value:d, is_imputed | SELECT * FROM feat")
_add("c11_features_wide", demo.features, "entity, metric_id:i, year:i, value_harmonized:d, z_value:d, is_imputed | SELECT * FROM feat")
_add("c12_profile_matrix", lambda s, d: features.profile_matrix(demo.features(s, d), [1, 2, 3, 4, 5, 6]), "entity, year:i, m1:d, m2:d, m3:d, m4:d, m5:d, m6:d | SELECT entity, year, " + ", ".join(f"max(z_value) FILTER (metric_id = {k}) AS m{k}" for k in range(1, 7)) + " FROM feat GROUP BY 1, 2")

# index
_DEV = "entity, year:i, scheme, total_score:d, " + ", ".join(f"{x}:d" for x in DOMAINS)
_add("d1_domain_scores", demo.wide, f"entity, year:i, {', '.join(f'{x}:d' for x in DOMAINS)} | SELECT * FROM wide")
# the first component by power iteration
_PRODUCTS = [" + ".join(f"c{i}{j} * v{j}" for j in range(4)) for i in range(4)]
_PCA = f"""WITH RECURSIVE cv AS (SELECT {", ".join(f"covar_samp({a}, {b}) AS c{i}{j}" for i, a in enumerate(DOMAINS) for j, b in enumerate(DOMAINS))} FROM wide WHERE {" AND ".join(f"{x} IS NOT NULL" for x in DOMAINS)}),
it AS (SELECT 0 AS step, 1.0::DOUBLE AS v0, 0.9::DOUBLE AS v1, 0.8::DOUBLE AS v2, 0.7::DOUBLE AS v3 UNION ALL SELECT step + 1, p0 / size, p1 / size, p2 / size, p3 / size FROM
(SELECT step, p0, p1, p2, p3, sqrt(p0 * p0 + p1 * p1 + p2 * p2 + p3 * p3) AS size FROM (SELECT step, {", ".join(f"{p} AS p{i}" for i, p in enumerate(_PRODUCTS))} FROM it, cv WHERE step < 3000)))
SELECT {", ".join(f"v{i} / (v0 + v1 + v2 + v3) AS w{i}" for i in range(4))} FROM it WHERE step = 3000"""
_add("d2_pca_weights", lambda s, d: s.createDataFrame(list(index.scheme_weights(demo.wide(s, d), DOMAINS, "pca").items()), "domain string, weight double"),
     f"domain, weight:d | SELECT unnest([{_NAMES}]) AS domain, unnest([w0, w1, w2, w3]) AS weight FROM ({_PCA})")


def _dev_pca(s: SparkSession, d: str) -> DataFrame:
    """The index by equal weights and by the first component's."""
    wide = demo.wide(s, d)
    return index.dev_index(wide, DOMAINS, {"equal": SCHEMES["equal"], "pca": index.scheme_weights(wide, DOMAINS, "pca")})


_DEV_PCA = f"""(WITH w AS ({_PCA}), t AS (SELECT entity, year, {_DOM}, unnest(['equal', 'pca']) AS scheme, unnest([{_MEAN}, {" + ".join(f"{x} * w{i}" for i, x in enumerate(DOMAINS))}]) AS t FROM wide, w)
SELECT entity, year, scheme, CASE WHEN hi = lo THEN 50 ELSE 100 * (t - lo) / (hi - lo) END AS total_score, {_DOM} FROM t JOIN (SELECT scheme, min(t) AS lo, max(t) AS hi FROM t GROUP BY 1) USING (scheme))"""
_add("d3_to_100", lambda s, d: index.to_100(demo.wide(s, d), "economy").select("entity", "year", "economy"), "entity, year:i, economy:d | SELECT entity, year, CASE WHEN (SELECT max(economy) FROM wide) = (SELECT min(economy) FROM wide) THEN 50 ELSE 100 * (economy - (SELECT min(economy) FROM wide)) / ((SELECT max(economy) FROM wide) - (SELECT min(economy) FROM wide)) END AS economy FROM wide")
_add("d4_dev_index", demo.dev, f"{_DEV} | SELECT * FROM dev")
_add("d4_dev_index_pca", _dev_pca, f"{_DEV} | SELECT * FROM {_DEV_PCA}")
_add("d5_index_ranking", lambda s, d: index.index_ranking(demo.dev(s, d), 1998, "equal"), f"{_DEV}, position:i | SELECT dev.*, rank AS position FROM dev JOIN rk USING (entity, year, scheme) WHERE year = 1998 AND scheme = 'equal'")
_OWN = {"economy": 3.0, "income": -1.0, "demography": 1.0, "labor": 0.0}
_CUSTOM = """SELECT entity, custom_score, rank, base_rank, base_rank - rank AS delta FROM (SELECT entity, custom_score, row_number() OVER (ORDER BY custom_score DESC, entity) AS rank, row_number() OVER (ORDER BY total_score DESC, entity) AS base_rank FROM
(SELECT entity, total_score, round(CASE WHEN max(t) OVER () = min(t) OVER () THEN 50 ELSE 100 * (t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ()) END, 2) AS custom_score FROM (SELECT entity, total_score, coalesce(economy, 0) * 0.75 + coalesce(demography, 0) * 0.25 AS t FROM dev WHERE year = 1998 AND scheme = 'equal')))"""
_add("d6_custom_index", lambda s, d: index.custom_index(demo.dev(s, d), 1998, _OWN), f"entity, custom_score:d, rank:i, base_rank:i, delta:i | {_CUSTOM}")
_add("d7_custom_movers", lambda s, d: index.custom_movers(index.custom_index(demo.dev(s, d), 1998, _OWN)), f"riser, gain:i, faller, loss:i | SELECT (SELECT entity FROM c ORDER BY delta DESC, entity LIMIT 1) AS riser, (SELECT max(delta) FROM c) AS gain, (SELECT entity FROM c ORDER BY delta, entity LIMIT 1) AS faller, (SELECT min(delta) FROM c) AS loss FROM (SELECT 1) WHERE true".replace("FROM c", f"FROM ({_CUSTOM})"))
_YEAR = f"(SELECT entity, {_DOM}, {_MEAN} AS score FROM dev WHERE year = 1998 AND scheme = 'equal')"
_RANK = f"1 + (SELECT count(*) FROM {_YEAR} o WHERE o.entity <> t.entity AND (o.score > new OR (o.score = new AND o.entity < t.entity)))"
_add("d8_scenario", lambda s, d: index.scenario(demo.dev(s, d), 1998, "04", {"economy": 90.0, "labor": 120.0}, DOMAINS),
     f"entity, baseline:i, scenario:i, delta:i | SELECT entity, b AS baseline, s AS scenario, b - s AS delta FROM (SELECT entity, (SELECT {_RANK} FROM (SELECT t0.entity, t0.score AS new) t) AS b, (SELECT {_RANK} FROM (SELECT t0.entity, ((SELECT quantile_cont(economy, 0.9) FROM {_YEAR}) + t0.income + t0.demography + (SELECT max(labor) FROM {_YEAR})) / 4 AS new) t) AS s FROM {_YEAR} t0 WHERE entity = '04')")
_add("d9_domain_percentiles", lambda s, d: index.domain_percentiles(demo.dev(s, d), 1998, DOMAINS),
     f"entity, domain, percentile:d | SELECT entity, domain, round(100 * cume_dist() OVER (PARTITION BY domain ORDER BY v), 1) AS percentile FROM (SELECT entity, unnest([{_NAMES}]) AS domain, unnest([{_DOM}]) AS v FROM {_YEAR})")
_add("d10_scenario_sensitivity", lambda s, d: index.scenario_sensitivity(demo.dev(s, d), 1998, "04", DOMAINS),
     "domain, gain:i | " + " UNION ALL ".join(f"SELECT '{x}' AS domain, (SELECT {_RANK} FROM (SELECT t0.entity, t0.score AS new) t) - (SELECT {_RANK} FROM (SELECT t0.entity, t0.score + ((SELECT max({x}) FROM {_YEAR}) - t0.{x}) / 4 AS new) t) AS gain FROM {_YEAR} t0 WHERE entity = '04'" for x in DOMAINS))
_PART = {x: f"CASE scheme WHEN 'equal' THEN 0.25 ELSE {EXPERT[x]} END::DOUBLE * ({x} - l_{x})" for x in DOMAINS}
_add("d11_decompose_index", lambda s, d: index.decompose_index(demo.dev(s, d), DOMAINS, SCHEMES),
     "entity, year:i, scheme, domain, contribution:d, delta_total:d | SELECT entity, year, scheme, unnest([" + ", ".join(f"'{x}'" for x in DOMAINS) + "]) AS domain, unnest([" + ", ".join(f"CASE WHEN abs(den) < 1e-9 THEN 0 ELSE delta_total * p_{x} / den END" for x in DOMAINS) + "]) AS contribution, delta_total FROM (SELECT *, "
     + " + ".join(f"p_{x}" for x in DOMAINS) + " AS den FROM (SELECT entity, year, scheme, total_score - l_t AS delta_total, " + ", ".join(f"{e} AS p_{x}" for x, e in _PART.items()) + " FROM (SELECT *, lag(year) OVER w AS l_year, lag(total_score) OVER w AS l_t, " + ", ".join(f"lag({x}) OVER w AS l_{x}" for x in DOMAINS) + " FROM dev WINDOW w AS (PARTITION BY entity, scheme ORDER BY year)) WHERE year - l_year = 1))")
_add("d12_region_dashboard", lambda s, d: index.region_dashboard(demo.dev(s, d), DOMAINS, 1999, "equal"),
     "entity, domain, score:d, previous:d, delta:d, rank:i, of:i, total_delta:d | SELECT n.entity, unnest([" + ", ".join(f"'{x}'" for x in DOMAINS) + "]) AS domain, unnest([" + ", ".join(f"n.{x}" for x in DOMAINS) + "]) AS score, unnest([" + ", ".join(f"o.{x}" for x in DOMAINS) + "]) AS previous, unnest([" + ", ".join(f"n.{x} - o.{x}" for x in DOMAINS) + "]) AS delta, rk.rank, (SELECT count(*) FROM dev WHERE year = 1999 AND scheme = 'equal') AS of, n.total_score - o.total_score AS total_delta FROM dev n JOIN rk ON rk.entity = n.entity AND rk.year = n.year AND rk.scheme = n.scheme LEFT JOIN dev o ON o.entity = n.entity AND o.scheme = n.scheme AND o.year = n.year - 1 WHERE n.year = 1999 AND n.scheme = 'equal'")

# ranks, dispersion, correlations
_add("e1_rank_stability", lambda s, d: ranks.rank_stability(demo.dev(s, d), 3),
     "entity, scheme, n_years:i, mean_rank:d, std_rank:d, best_rank:i, worst_rank:i, rank_range:i, mean_abs_change:d | SELECT entity, scheme, count(*) AS n_years, avg(rank) AS mean_rank, stddev_samp(rank) AS std_rank, min(rank) AS best_rank, max(rank) AS worst_rank, max(rank) - min(rank) AS rank_range, avg(step) AS mean_abs_change FROM (SELECT *, abs(rank - lag(rank) OVER (PARTITION BY scheme, entity ORDER BY year)) AS step FROM rk) GROUP BY 1, 2 HAVING count(*) >= 3")
_add("e2_rank_robustness", lambda s, d: ranks.rank_robustness(demo.dev(s, d)),
     "entity, year:i, n_schemes:i, best_rank:i, worst_rank:i, rank_range:i, mean_rank:d, score_min:d, score_max:d | SELECT entity, year, count(*) AS n_schemes, min(rank) AS best_rank, max(rank) AS worst_rank, max(rank) - min(rank) AS rank_range, avg(rank) AS mean_rank, min(total_score) AS score_min, max(total_score) AS score_max FROM rk GROUP BY 1, 2")
_AGREE = """SELECT year, scheme_a, scheme_b, round(corr(ra, rb), 4) AS spearman, count(*) AS n FROM (SELECT a.year, a.scheme AS scheme_a, b.scheme AS scheme_b, rank() OVER (PARTITION BY a.year ORDER BY a.total_score) + (count(*) OVER (PARTITION BY a.year, a.total_score) - 1) / 2.0 AS ra,
rank() OVER (PARTITION BY a.year ORDER BY b.total_score) + (count(*) OVER (PARTITION BY a.year, b.total_score) - 1) / 2.0 AS rb FROM dev a JOIN dev b USING (entity, year) WHERE a.scheme < b.scheme) GROUP BY 1, 2, 3 HAVING count(*) >= 3"""
_add("e3_scheme_agreement", lambda s, d: ranks.scheme_agreement(demo.dev(s, d)), f"year:i, scheme_a, scheme_b, spearman:d, n:i | {_AGREE}")
_add("e4_scheme_sensitivity", lambda s, d: ranks.scheme_sensitivity(ranks.scheme_agreement(demo.dev(s, d))), f"scheme_a, scheme_b, mean_spearman:d, min_spearman:d | SELECT scheme_a, scheme_b, avg(spearman) AS mean_spearman, min(spearman) AS min_spearman FROM ({_AGREE}) GROUP BY 1, 2")
_PCA_AGREE = _AGREE.replace("FROM dev a JOIN dev b", "FROM pd a JOIN pd b")
_add("e1_rank_stability_pca", lambda s, d: ranks.rank_stability(_dev_pca(s, d).where("scheme = 'pca'"), 3).select("entity", "mean_rank", "rank_range"),
     f"entity, mean_rank:d, rank_range:i | SELECT entity, avg(rank) AS mean_rank, max(rank) - min(rank) AS rank_range FROM (SELECT entity, row_number() OVER (PARTITION BY year ORDER BY total_score DESC, entity) AS rank FROM {_DEV_PCA} WHERE scheme = 'pca') GROUP BY 1 HAVING count(*) >= 3")
_add("e4_pca_sensitivity", lambda s, d: ranks.scheme_sensitivity(ranks.scheme_agreement(_dev_pca(s, d))), f"scheme_a, scheme_b, mean_spearman:d, min_spearman:d | WITH pd AS {_DEV_PCA} SELECT scheme_a, scheme_b, avg(spearman) AS mean_spearman, min(spearman) AS min_spearman FROM ({_PCA_AGREE}) GROUP BY 1, 2")
_add("f1_dispersion", lambda s, d: ranks.dispersion(demo.features(s, d), demo.metrics(s), 5),
     "metric_id:i, year:i, n:i, mean:d, median:d, std:d, p10:d, p90:d, iqr:d, range:d, cv:d, p90_p10:d | SELECT *, CASE WHEN scale AND mean > 0 THEN std / mean END AS cv, CASE WHEN scale AND p10 > 0 THEN p90 / p10 END AS p90_p10 FROM (SELECT metric_id, year, any_value(value_type) IN ('absolute', 'per_capita', 'share') AS scale, count(*) AS n, avg(value_harmonized) AS mean, median(value_harmonized) AS median, stddev_samp(value_harmonized) AS std, quantile_cont(value_harmonized, 0.1) AS p10, quantile_cont(value_harmonized, 0.9) AS p90, quantile_cont(value_harmonized, 0.75) - quantile_cont(value_harmonized, 0.25) AS iqr, max(value_harmonized) - min(value_harmonized) AS range FROM feat JOIN mdim USING (metric_id) GROUP BY 1, 2 HAVING count(*) >= 5)")
_add("f2_index_dispersion", lambda s, d: ranks.index_dispersion(demo.dev(s, d)),
     "year:i, scheme, n:i, mean:d, std:d, p10:d, p90:d, cv:d, p90_p10:d, gini:d | SELECT year, scheme, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.9) AS p90, CASE WHEN avg(x) > 0 THEN stddev_pop(x) / avg(x) END AS cv, CASE WHEN quantile_cont(x, 0.1) > 0 THEN quantile_cont(x, 0.9) / quantile_cont(x, 0.1) END AS p90_p10, CASE WHEN sum(x) > 0 THEN (2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)) END AS gini FROM (SELECT year, scheme, total_score AS x, row_number() OVER (PARTITION BY year, scheme ORDER BY total_score, entity) AS i FROM dev) GROUP BY 1, 2 HAVING count(*) >= 5")
_add("f3_beta_convergence", lambda s, d: ranks.beta_convergence(demo.dev(s, d)),
     "scheme, first_year:i, last_year:i, n:i, beta:d, intercept:d, r:d, r2:d | SELECT scheme, any_value(first_year) AS first_year, any_value(last_year) AS last_year, count(*) AS n, regr_slope(y, x) AS beta, regr_intercept(y, x) AS intercept, corr(x, y) AS r, corr(x, y) ** 2 AS r2 FROM (SELECT a.scheme, first_year, last_year, a.total_score AS x, b.total_score - a.total_score AS y FROM dev a JOIN dev b USING (entity, scheme) JOIN (SELECT scheme, min(year) AS first_year, max(year) AS last_year FROM dev GROUP BY 1) USING (scheme) WHERE a.year = first_year AND b.year = last_year) GROUP BY 1")
_add("g1_metric_correlations", lambda s, d: ranks.metric_correlations(demo.features(s, d), "spearman", 5), "year:i, metric_a:i, metric_b:i, r:d, n:i | SELECT * FROM cor")
_add("g2_top_correlations", lambda s, d: ranks.top_correlations(ranks.metric_correlations(demo.features(s, d), "spearman", 5), demo.metrics(s), None, 3, 3),
     "year:i, metric_a:i, metric_b:i, r:d, n:i, name_a, name_b | SELECT cor.*, a.metric_name AS name_a, b.metric_name AS name_b FROM cor JOIN mdim a ON a.metric_id = metric_a JOIN mdim b ON b.metric_id = metric_b WHERE year = (SELECT max(year) FROM cor) AND 3 IN (metric_a, metric_b) ORDER BY round(abs(r), 8) DESC, metric_a, metric_b LIMIT 3")

# space
_add("h1_adjacency", lambda s, d: spatial.build_adjacency(demo.table(s, d, "events").select(F.col("user_id").alias("entity"), F.concat_ws("|", "event_type", F.date_format("ts", "yyyy-MM-dd HH")).alias("vertex"))),
     "src:i, dst:i | SELECT unnest([src, dst]) AS src, unnest([dst, src]) AS dst FROM (SELECT a.e AS src, b.e AS dst FROM v a JOIN v b ON a.x = b.x AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 2)".replace("FROM v a JOIN v b", "FROM (SELECT DISTINCT user_id AS e, event_type || '|' || strftime(ts, '%Y-%m-%d %H') AS x FROM events) a JOIN (SELECT DISTINCT user_id AS e, event_type || '|' || strftime(ts, '%Y-%m-%d %H') AS x FROM events) b"))
_add("h2_moran_global", lambda s, d: spatial.moran_global(demo.dev(s, d), demo.edges(s, d)), "scheme, year:i, n:i, moran_i:d, expected:d | SELECT scheme, year, count(*) AS n, sum(d * lag) / sum(d * d) AS moran_i, -1.0 / (count(*) - 1) AS expected FROM devs GROUP BY 1, 2 HAVING count(*) >= 3")
#: Places of the entities in each permutation, and the scores that they so get.
_MOVED = """WITH dealt AS (SELECT scheme, year, entity, d, p FROM devs, (SELECT unnest(range(1, 1000)) AS p) WHERE n >= {least}),
placed AS (SELECT *, row_number() OVER (PARTITION BY scheme, year, p ORDER BY md5('42|' || p::VARCHAR || '|' || entity), entity) AS place FROM dealt)"""
_H3 = f"""{_MOVED.format(least=3)}, named AS (SELECT scheme, year, d AS x, row_number() OVER (PARTITION BY scheme, year ORDER BY entity) AS place FROM devs WHERE n >= 3),
moved AS (SELECT scheme, year, p, entity, x FROM placed JOIN named USING (scheme, year, place)),
means AS (SELECT a.scheme, a.year, a.p, a.entity, any_value(a.x) AS x, avg(b.x) AS nx FROM moved a JOIN edges ON src = a.entity JOIN moved b ON b.scheme = a.scheme AND b.year = a.year AND b.p = a.p AND b.entity = dst GROUP BY 1, 2, 3, 4),
sims AS (SELECT scheme, year, p, round(sum(x * nx) / sum(x * x), 9) AS sim FROM means GROUP BY 1, 2, 3),
own AS (SELECT scheme, year, round(sum(d * lag) / sum(d * d), 9) AS moran_i FROM devs WHERE n >= 3 GROUP BY 1, 2)
SELECT scheme, year, moran_i, (moran_i - avg(sim)) / stddev_pop(sim) AS z_score, (least(count(*) FILTER (sim >= moran_i), 999 - count(*) FILTER (sim >= moran_i)) + 1) / 1000.0 AS p_value FROM sims JOIN own USING (scheme, year) GROUP BY 1, 2, 3"""
_add("h3_moran_significance", lambda s, d: spatial.moran_significance(demo.dev(s, d), demo.edges(s, d)), f"scheme, year:i, moran_i:d, z_score:d, p_value:d | {_H3}")
_add("h4_moran_local_parts", lambda s, d: spatial.moran_local_parts(demo.dev(s, d), demo.edges(s, d)),
     "scheme, year:i, entity, local_i:d, n_neighbors:i, quadrant | SELECT scheme, year, entity, d * lag / m2 AS local_i, coalesce(n_neighbors, 0) AS n_neighbors, CASE WHEN d IS NULL THEN 'ns' WHEN d >= 0 AND lag >= 0 THEN 'HH' WHEN d < 0 AND lag >= 0 THEN 'LH' WHEN d < 0 THEN 'LL' ELSE 'HL' END AS quadrant FROM dev LEFT JOIN devs USING (scheme, year, entity) LEFT JOIN (SELECT scheme, year, avg(d * d) AS m2 FROM devs GROUP BY 1, 2) USING (scheme, year)")
# the others drawn for an entity: those placed up to its number of neighbours, one more if it is among them itself
_H4 = f"""{_MOVED.format(least=1)}, drawn AS (SELECT i.scheme, i.year, i.entity, i.p, round(avg(o.d) * i.d, 9) AS sim, round(i.d * any_value(v.lag), 9) AS own
FROM placed i JOIN devs v USING (scheme, year, entity) JOIN placed o ON o.scheme = i.scheme AND o.year = i.year AND o.p = i.p AND o.entity <> i.entity AND o.place <= v.n_neighbors + (i.place <= v.n_neighbors)::INT WHERE v.n > v.n_neighbors GROUP BY i.scheme, i.year, i.entity, i.p, i.d),
ps AS (SELECT scheme, year, entity, least(1.0, 2 * (least(count(*) FILTER (sim >= own), 999 - count(*) FILTER (sim >= own)) + 1) / 1000.0) AS p_value FROM drawn GROUP BY 1, 2, 3)
SELECT scheme, year, entity, d * lag / m2 AS local_i, coalesce(n_neighbors, 0) AS n_neighbors, CASE WHEN p_value IS NULL OR p_value >= 0.05 THEN 'ns' WHEN d >= 0 AND lag >= 0 THEN 'HH' WHEN d < 0 AND lag >= 0 THEN 'LH' WHEN d < 0 THEN 'LL' ELSE 'HL' END AS quadrant, p_value
FROM dev LEFT JOIN devs USING (scheme, year, entity) LEFT JOIN (SELECT scheme, year, avg(d * d) AS m2 FROM devs GROUP BY 1, 2) USING (scheme, year) LEFT JOIN ps USING (scheme, year, entity) WHERE total_score IS NOT NULL"""
_add("h4_moran_local", lambda s, d: spatial.moran_local(demo.dev(s, d), demo.edges(s, d)), f"scheme, year:i, entity, local_i:d, n_neighbors:i, quadrant, p_value:d | {_H4}")

# typology
_add("i1_cluster_by_period", lambda s, d: typology.cluster_by_period(demo.features(s, d), 3))
_add("i2_choose_k", lambda s, d: typology.choose_k(demo.features(s, d), range(3, 9)))
_add("i3_cluster_quality", lambda s, d: typology.cluster_quality(demo.features(s, d), demo.clusters(s, d)),
     """year:i, silhouette:d, davies_bouldin:d, calinski_harabasz:d | WITH p AS (SELECT a.year, a.entity AS e, b.entity AS f, sum((a.z_value - b.z_value) ** 2) AS sq FROM feat a JOIN feat b USING (year, metric_id) WHERE a.entity <> b.entity GROUP BY 1, 2, 3),
q AS (SELECT p.year, e, x.cluster_id AS own, y.cluster_id AS c, avg(sq) AS m FROM p JOIN clusters x ON x.entity = e AND x.year = p.year JOIN clusters y ON y.entity = f AND y.year = p.year GROUP BY 1, 2, 3, 4),
ab AS (SELECT year, e, max(m) FILTER (c = own) AS a, min(m) FILTER (c <> own) AS b FROM q GROUP BY 1, 2), sil AS (SELECT year, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY 1),
sp AS (SELECT year, cluster_id, avg(distance) AS s, sum(distance ** 2) AS w, count(*) AS n FROM dist GROUP BY 1, 2),
dd AS (SELECT a.year, a.cluster_id AS i, b.cluster_id AS j, sqrt(sum((a.mean_z - b.mean_z) ** 2)) AS t FROM prof a JOIN prof b USING (year, metric_id) WHERE a.cluster_id <> b.cluster_id GROUP BY 1, 2, 3),
db AS (SELECT year, avg(m) AS davies_bouldin FROM (SELECT dd.year, i, max((x.s + y.s) / t) AS m FROM dd JOIN sp x ON x.year = dd.year AND x.cluster_id = i JOIN sp y ON y.year = dd.year AND y.cluster_id = j GROUP BY 1, 2) GROUP BY 1),
tt AS (SELECT year, sum(t) AS t FROM (SELECT year, metric_id, var_pop(z_value) * count(*) AS t FROM feat GROUP BY 1, 2) GROUP BY 1), ww AS (SELECT year, sum(w) AS w, sum(n) AS n, count(*) AS k FROM sp GROUP BY 1)
SELECT year, silhouette, davies_bouldin, (t - w) / (k - 1) / (w / (n - k)) AS calinski_harabasz FROM sil JOIN db USING (year) JOIN tt USING (year) JOIN ww USING (year)""")
_add("i3_euclidean_quality", lambda s, d: typology.cluster_quality(demo.features(s, d), demo.clusters(s, d), squared=False),
     """year:i, silhouette:d, davies_bouldin:d, calinski_harabasz:d | WITH p AS (SELECT a.year, a.entity AS e, b.entity AS f, sqrt(sum((a.z_value - b.z_value) ** 2)) AS sq FROM feat a JOIN feat b USING (year, metric_id) WHERE a.entity <> b.entity GROUP BY 1, 2, 3),
q AS (SELECT p.year, e, x.cluster_id AS own, y.cluster_id AS c, avg(sq) AS m FROM p JOIN clusters x ON x.entity = e AND x.year = p.year JOIN clusters y ON y.entity = f AND y.year = p.year GROUP BY 1, 2, 3, 4),
ab AS (SELECT year, e, max(m) FILTER (c = own) AS a, min(m) FILTER (c <> own) AS b FROM q GROUP BY 1, 2), sil AS (SELECT year, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY 1),
sp AS (SELECT year, cluster_id, avg(distance) AS s, sum(distance ** 2) AS w, count(*) AS n FROM dist GROUP BY 1, 2),
dd AS (SELECT a.year, a.cluster_id AS i, b.cluster_id AS j, sqrt(sum((a.mean_z - b.mean_z) ** 2)) AS t FROM prof a JOIN prof b USING (year, metric_id) WHERE a.cluster_id <> b.cluster_id GROUP BY 1, 2, 3),
db AS (SELECT year, avg(m) AS davies_bouldin FROM (SELECT dd.year, i, max((x.s + y.s) / t) AS m FROM dd JOIN sp x ON x.year = dd.year AND x.cluster_id = i JOIN sp y ON y.year = dd.year AND y.cluster_id = j GROUP BY 1, 2) GROUP BY 1),
tt AS (SELECT year, sum(t) AS t FROM (SELECT year, metric_id, var_pop(z_value) * count(*) AS t FROM feat GROUP BY 1, 2) GROUP BY 1), ww AS (SELECT year, sum(w) AS w, sum(n) AS n, count(*) AS k FROM sp GROUP BY 1)
SELECT year, silhouette, davies_bouldin, (t - w) / (k - 1) / (w / (n - k)) AS calinski_harabasz FROM sil JOIN db USING (year) JOIN tt USING (year) JOIN ww USING (year)""")
_add("i4_align_labels", lambda s, d: typology.align_labels(demo.clusters(s, d), 3))
_add("i5_label_stability", lambda s, d: typology.label_stability(demo.clusters(s, d)), "year:i, stability:d | SELECT a.year, avg((a.cluster_id = b.cluster_id)::INT) AS stability FROM clusters a LEFT JOIN clusters b ON b.entity = a.entity AND b.year = a.year - 1 GROUP BY 1")
_add("i6_centroid_distances", lambda s, d: typology.centroid_distances(demo.features(s, d), demo.clusters(s, d)), "entity, year:i, cluster_id:i, distance:d | SELECT * FROM dist")
_add("i7_cluster_profile", lambda s, d: typology.cluster_profile(demo.features(s, d), demo.clusters(s, d)), "year:i, cluster_id:i, metric_id:i, mean_z:d | SELECT * FROM prof")
_LABEL = "SELECT year, cluster_id, string_agg(CASE WHEN mean_z >= 0 THEN '↑' ELSE '↓' END || metric_name, ', ' ORDER BY r) AS label FROM (SELECT *, row_number() OVER (PARTITION BY year, cluster_id ORDER BY round(abs(mean_z), 8) DESC, metric_id) AS r FROM prof) JOIN mdim USING (metric_id) WHERE r <= 2 GROUP BY 1, 2"
_add("i8_cluster_labels", lambda s, d: typology.cluster_labels(typology.cluster_profile(demo.features(s, d), demo.clusters(s, d)), demo.metrics(s)), f"year:i, cluster_id:i, label | {_LABEL}")
_add("i9_membership_attribution", lambda s, d: typology.membership_attribution(demo.features(s, d), demo.clusters(s, d)),
     """entity, year:i, metric_id:i, value:d | WITH o AS (SELECT f.entity, f.year, c.cluster_id AS own, p.cluster_id AS c, round(sum((z_value - mean_z) ** 2), 8) AS sq FROM feat f JOIN clusters c USING (entity, year) JOIN prof p ON p.year = f.year AND p.metric_id = f.metric_id AND p.cluster_id <> c.cluster_id GROUP BY 1, 2, 3, 4),
n AS (SELECT entity, year, own, arg_min(c, (sq, c)) AS near FROM o GROUP BY 1, 2, 3),
t AS (SELECT f.entity AS e, f.year, f.metric_id, q.own, q.near, (z_value - b.mean_z) ** 2 - (z_value - a.mean_z) ** 2 AS v FROM (SELECT DISTINCT year, own, near FROM n) q JOIN feat f USING (year) JOIN prof a ON a.year = q.year AND a.cluster_id = own AND a.metric_id = f.metric_id JOIN prof b ON b.year = q.year AND b.cluster_id = near AND b.metric_id = f.metric_id)
SELECT n.entity, n.year, t.metric_id, t.v - m.v AS value FROM n JOIN t ON t.e = n.entity AND t.year = n.year AND t.own = n.own AND t.near = n.near JOIN (SELECT year, metric_id, own, near, avg(v) AS v FROM t GROUP BY 1, 2, 3, 4) m ON m.year = t.year AND m.metric_id = t.metric_id AND m.own = t.own AND m.near = t.near""")
_add("d12_dashboard_types", lambda s, d: index.dashboard_types(demo.clusters(s, d), typology.membership_attribution(demo.features(s, d), demo.clusters(s, d)), 1999, 3),
     f"entity, cluster_id:i, place:i, metric_id:i, value:d | SELECT entity, cluster_id, place, metric_id, value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(abs(value), 8) DESC, metric_id) AS place FROM ({SQL['i9_membership_attribution'].split('|', 1)[1]}) WHERE year = 1999) JOIN (SELECT entity, cluster_id FROM clusters WHERE year = 1999) USING (entity) WHERE place <= 3")
_add("i10_cluster_rank", lambda s, d: typology.cluster_rank(demo.dev(s, d), demo.clusters(s, d), "equal"), "cluster_id:i, mean_score:d, rank:i | SELECT * FROM crank")
_TRANS = "entity, year_from:i, year_to:i, from_cluster:i, to_cluster:i, from_rank:i, to_rank:i, rank_delta:i"


def _ranked_clusters(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labels = demo.clusters(s, d)
    return labels, typology.cluster_rank(demo.dev(s, d), labels, "equal")


_add("i11_transitions", lambda s, d: typology.build_transitions(*_ranked_clusters(s, d)), f"{_TRANS} | SELECT * FROM trans")
_add("i12_trajectory_descriptors", lambda s, d: typology.trajectory_descriptors(*_ranked_clusters(s, d)), "entity, initial_rank:i, final_rank:i, n_changes:i | SELECT * FROM traj")
_add("i13_run_transitions", lambda s, d: typology.run_transitions(demo.dev(s, d), demo.clusters(s, d), "equal"), f"{_TRANS}, trajectory | SELECT * FROM trans JOIN kinds USING (entity)")
_add("i13_trajectory_distribution", lambda s, d: typology.run_transitions(demo.dev(s, d), demo.clusters(s, d), "equal").groupBy("trajectory").agg(F.countDistinct("entity").alias("n")), "trajectory, n:i | SELECT trajectory, count(*) AS n FROM kinds GROUP BY 1")


def _profiles(s: SparkSession, d: str) -> DataFrame:
    return demo.table(s, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("entity"), F.col("label").cast("long").alias("year"), F.transform("embedding", lambda x: x.cast("double")).alias("profile"))


_TWIN = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY similarity DESC, twin) AS rank FROM (SELECT a.entity, a.year, b.entity AS twin, round(list_cosine_similarity(a.p, b.p), 8) AS similarity FROM pr a JOIN pr b ON a.year = b.year AND a.entity <> b.entity)) WHERE rank <= 5"
_add("i14_twins", lambda s, d: typology.twins(_profiles(s, d)), "entity, year:i, twin, similarity:d, rank:i | WITH pr AS (SELECT lpad(vec_id::VARCHAR, 9, '0') AS entity, label AS year, embedding::DOUBLE[] AS p FROM embeddings) " + _TWIN)
_PANEL_TWINS = "WITH pr AS (SELECT entity, year, list(z_value ORDER BY metric_id) AS p FROM feat GROUP BY 1, 2) " + _TWIN
_add("i15_twins_of", lambda s, d: typology.twins_of(typology.twins(features.profile_vector(demo.features(s, d))), demo.regions(s, d), "04", 1998), f"entity, rank:i, similarity:d, region_name, district | SELECT twin AS entity, rank, similarity, region_name, district FROM ({_PANEL_TWINS}) t JOIN regions r ON r.entity = twin WHERE t.entity = '04' AND t.year = 1998")
_add("i16_region_vs_type", lambda s, d: typology.region_vs_type(demo.features(s, d), demo.clusters(s, d)),
     "entity, year:i, cluster_id:i, metric_id:i, gap:d, typicality:d, cluster_size:i | SELECT entity, year, cluster_id, metric_id, z_value - mean_z AS gap, CASE WHEN n > 1 THEN (r - 1) / (n - 1)::DOUBLE END AS typicality, n AS cluster_size FROM feat JOIN (SELECT entity, year, cluster_id, count(*) OVER (PARTITION BY year, cluster_id) AS n, rank() OVER (PARTITION BY year, cluster_id ORDER BY round(distance, 8)) AS r FROM dist) USING (entity, year) JOIN prof USING (year, cluster_id, metric_id)")


def _classifier(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.ml.functions import array_to_vector

    rows = _profiles(s, d).withColumn("features", array_to_vector("profile")).withColumn("cluster_id", F.col("year") % 3)
    model, card = typology.train_typology_model(rows, 2)
    return rows, typology.predict_cluster(model, rows), card


_add("i17_typology_card", lambda s, d: _classifier(s, d)[2])

# anomalies
_add("j1_spatial_outliers", lambda s, d: anomalies.spatial_outliers(_profiles(s, d)))
_add("j2_structural_breaks", lambda s, d: anomalies.structural_breaks(demo.series(s, d), 0.85), "entity, metric_id:i, year:i, score:d | SELECT * FROM breaks")
_METH = "SELECT metric_id, year, count(DISTINCT entity) / 25.0 AS score FROM breaks JOIN mdim USING (metric_id) WHERE domain IN ('economy', 'income', 'labor') AND year <> 7990 GROUP BY 1, 2 HAVING count(DISTINCT entity) / 25.0 >= 0.08"


def _breaks(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = anomalies.structural_breaks(demo.series(s, d), 0.85)
    return found, anomalies.methodology_candidates(found, demo.metrics(s), 25, ["economy", "income", "labor"], [7990], 0.08)


_add("j3_methodology_candidates", lambda s, d: _breaks(s, d)[1], f"metric_id:i, year:i, score:d | {_METH}")
_add("j4_score_anomalies", lambda s, d: anomalies.score_anomalies(_profiles(s, d), anomalies.train_anomaly_model(_profiles(s, d))))
_add("j5_run_anomalies", lambda s, d: anomalies.run_anomalies(anomalies.spatial_outliers(_profiles(s, d)), *_breaks(s, d)))
_add("j6_predict_profiles", lambda s, d: anomalies.predict_profiles(_profiles(s, d), 64, anomalies.train_anomaly_model(_profiles(s, d)), _classifier(s, d)[1]))

# quality and catalogue
_SHARE = "raw_cells / cells::DOUBLE AS raw_share, imputed_cells / cells::DOUBLE AS imputed_share"
_DQ = "cells:i, raw_cells:i, imputed_cells:i, raw_share:d, imputed_share:d"
_add("k1_data_quality", lambda s, d: quality.data_quality(demo.features(s, d), demo.fact(s, d)), f"metric_id:i, year:i, {_DQ} | SELECT *, {_SHARE} FROM dq")
_add("k2_quality_rollup", lambda s, d: quality.data_quality_rollup(quality.data_quality(demo.features(s, d), demo.fact(s, d)), demo.metrics(s)),
     f"year:i, domain, metric_id:i, {_DQ} | SELECT *, {_SHARE} FROM (SELECT year, domain, metric_id, sum(cells) AS cells, sum(raw_cells) AS raw_cells, sum(imputed_cells) AS imputed_cells FROM dq JOIN mdim USING (metric_id) GROUP BY GROUPING SETS ((year), (domain), (metric_id)))")
_CAT = "metric_id:i, metric_name, domain, is_core, coverage:d, tier, first_year:i, last_year:i, n_years:i, n_entities:i"
_add("k3_metric_catalog", lambda s, d: quality.metric_catalog(demo.metrics(s), demo.fact(s, d), 0.8), f"{_CAT} | SELECT * FROM catalog")
_add("k4_data_profile", lambda s, d: quality.data_profile(demo.regions(s, d), demo.fact(s, d), demo.metrics(s), demo.features(s, d), demo.dev(s, d)),
     "regions:i, included:i, districts:i, facts:i, first_year:i, last_year:i, sources:i, core_metrics:i, value_types:i, coverage_95:i, coverage_90:i, coverage_80:i, coverage_50:i, imputed_share:d, index_rows:i | SELECT (SELECT count(*) FROM regions) AS regions, (SELECT count(*) FROM regions WHERE included) AS included, (SELECT count(DISTINCT district) FROM regions) AS districts, (SELECT count(*) FROM fact) AS facts, (SELECT min(year) FROM fact) AS first_year, (SELECT max(year) FROM fact) AS last_year, 1 AS sources, 6 AS core_metrics, (SELECT count(DISTINCT value_type) FROM mdim) AS value_types, " + ", ".join(f"(SELECT count(*) FROM mdim WHERE coverage >= {c}) AS coverage_{int(100 * c)}" for c in (0.95, 0.9, 0.8, 0.5)) + ", (SELECT avg(is_imputed::INT) FROM feat) AS imputed_share, (SELECT count(*) FROM dev) AS index_rows")

_add("k4_core_by_domain", lambda s, d: quality.core_counts(demo.metrics(s), "domain"), "domain, n:i | SELECT domain, count(*) AS n FROM mdim WHERE is_core GROUP BY 1")
_add("k4_core_value_types", lambda s, d: quality.core_counts(demo.metrics(s), "value_type"), "value_type, n:i | SELECT value_type, count(*) AS n FROM mdim WHERE is_core GROUP BY 1")
_QUALITY_SQL = SQL["i3_euclidean_quality"].split("|", 1)[1]
_add("k4_clustering", lambda s, d: quality.clustering_summary(demo.clusters(s, d), typology.euclidean_silhouette(demo.features(s, d), demo.clusters(s, d)), typology.label_stability(demo.clusters(s, d))),
     f"k:i, years:i, silhouette:d, stability:d | SELECT (SELECT count(DISTINCT cluster_id) FROM clusters) AS k, (SELECT count(DISTINCT year) FROM clusters) AS years, (SELECT avg(silhouette) FROM ({_QUALITY_SQL})) AS silhouette, (SELECT avg(stability) FROM ({SQL['i5_label_stability'].split('|', 1)[1]})) AS stability")

# serving
_add("l1_map_layer", lambda s, d: serve.serve(demo.dev(s, d), {"year": 1998, "scheme": "equal"}).select("entity", "total_score"), "entity, total_score:d | SELECT * FROM dev WHERE year = 1998 AND scheme = 'equal'")
_add("l2_included_entities", lambda s, d: serve.serve(demo.regions(s, d).where("included"), order=["region_name"]), "entity, region_name, district, included | SELECT * FROM regions WHERE included")
_add("l3_search", lambda s, d: serve.search(demo.table(s, d, "part").select("p_partkey", "p_name"), "p_name", "A", ["p_name", "p_partkey"], 20), "p_partkey:i, p_name | SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%' ORDER BY p_name, p_partkey LIMIT 20")
_add("l4_core_metrics", lambda s, d: serve.serve(demo.metrics(s), {"is_core": True, "domain": "economy"}).join(features.compute_coverage(demo.fact(s, d), demo.regions(s, d), YEARS).select("metric_id", "cells"), "metric_id").select("metric_id", "metric_name", "cells"), f"metric_id:i, metric_name, cells:i | SELECT metric_id, metric_name, cells FROM mdim JOIN ({_COVER}) USING (metric_id) WHERE domain = 'economy'")
_add("l5_metric_series", lambda s, d: serve.metric_series(demo.fact(s, d), demo.features(s, d), "04", 2, (1996, 2000)), "year:i, value:d, value_harmonized:d, is_imputed | SELECT year, value, value_harmonized, is_imputed FROM fact LEFT JOIN feat USING (entity, metric_id, year) WHERE entity = '04' AND metric_id = 2 AND year BETWEEN 1996 AND 2000")
_add("l6_cross_section", lambda s, d: serve.cross_section(demo.fact(s, d), demo.regions(s, d), 3, 1999), "entity, region_name, value:d | SELECT entity, region_name, value FROM fact JOIN regions USING (entity) WHERE included AND metric_id = 3 AND year = 1999")
_add("l7_compare_entities", lambda s, d: serve.compare_entities(demo.dev(s, d), demo.clusters(s, d), demo.regions(s, d), ["01", "04", "09"], 1998, "equal"), f"{_DEV}, region_name, cluster_id:i | SELECT * FROM dev JOIN regions USING (entity) LEFT JOIN clusters USING (entity, year) WHERE entity IN ('01', '04', '09') AND year = 1998 AND scheme = 'equal'")
_ANOM = "SELECT 'structural_break' AS kind, entity, metric_id, year, score FROM breaks UNION ALL SELECT 'methodology_change', NULL, metric_id, year, score FROM (" + _METH + ")"


def _anomaly_list(s: SparkSession, d: str, kinds: list[str]) -> DataFrame:
    found = anomalies.run_anomalies(anomalies.spatial_outliers(_profiles(s, d)), *_breaks(s, d))
    return serve.serve(found, {"kind": kinds}, [(demo.regions(s, d), "entity", ["region_name"]), (demo.metrics(s), "metric_id", ["metric_name"])], ["kind", "year", F.desc("score")])


# outliers have no SQL, so all kinds are listed without one, and the others once more with theirs
_add("l8_anomaly_list", lambda s, d: _anomaly_list(s, d, ["spatial_outlier", "structural_break", "methodology_change"]))
_add("l8_break_list", lambda s, d: _anomaly_list(s, d, ["structural_break", "methodology_change"]),
     f"metric_id:i, entity, kind, year:i, score:d, region_name, metric_name | SELECT a.*, region_name, metric_name FROM ({_ANOM}) a LEFT JOIN regions USING (entity) LEFT JOIN mdim USING (metric_id)")


def _list(name: str, of: str, filters: dict, where: str, key: str, add: str) -> None:
    """The rows of another query that the filters leave, with a name joined by ``key``."""
    columns, body = SQL[of].split("|", 1)
    names = {"entity": ("regions", demo.regions), "metric_id": ("mdim", lambda s, d: demo.metrics(s))}
    table, frame = names[key]
    QUERIES[name] = lambda s, d: serve.serve(QUERIES[of](s, d), filters, [(frame(s, d), key, [add])], [key])
    SQL[name] = f"{columns}, {add} | SELECT l.*, {add} FROM ({body}) l LEFT JOIN (SELECT {key}, {add} FROM {table}) n USING ({key}) WHERE {where}"


_list("l9_dispersion_list", "f1_dispersion", {"year": (1996, 1998)}, "year BETWEEN 1996 AND 1998", "metric_id", "metric_name")
_list("l10_trajectory_list", "i13_run_transitions", {"year_to": 1998}, "year_to = 1998", "entity", "region_name")
_list("l10_descriptor_list", "i12_trajectory_descriptors", {}, "true", "entity", "region_name")
_list("l10_stability_list", "e1_rank_stability", {}, "true", "entity", "region_name")
_list("l10_robustness_list", "e2_rank_robustness", {}, "true", "entity", "region_name")
_list("l12_typology_list", "i6_centroid_distances", {"year": 1998}, "year = 1998", "entity", "region_name")
_list("l12_attribution_list", "i9_membership_attribution", {"entity": "04"}, "entity = '04'", "metric_id", "metric_name")
_add("l9_quality_list", lambda s, d: serve.serve(quality.data_quality(demo.features(s, d), demo.fact(s, d)), {"metric_id": [1, 3], "year": (1996, 1998)}, [(demo.metrics(s), "metric_id", ["metric_name"])], ["metric_id", "year"]), f"metric_id:i, year:i, {_DQ}, metric_name | SELECT dq.*, {_SHARE}, metric_name FROM dq JOIN mdim USING (metric_id) WHERE metric_id IN (1, 3) AND year BETWEEN 1996 AND 1998")
_add("l10_transition_list", lambda s, d: serve.serve(typology.build_transitions(*_ranked_clusters(s, d)), {"year_from": 1997}, [(demo.regions(s, d), "entity", ["region_name"])], ["entity"]), f"{_TRANS}, region_name | SELECT * FROM trans JOIN regions USING (entity) WHERE year_from = 1997")
_add("l11_catalog_list", lambda s, d: serve.catalog_list(quality.metric_catalog(demo.metrics(s), demo.fact(s, d), 0.8), None, None, "share", 5), f"{_CAT} | SELECT * FROM catalog WHERE metric_name LIKE '%share%'")
_add("l12_type_profile", lambda s, d: serve.serve(typology.cluster_profile(demo.features(s, d), demo.clusters(s, d)), {"year": 1998, "cluster_id": 1}, [(demo.metrics(s), "metric_id", ["metric_name"])], [F.abs("mean_z").desc()]), "year:i, cluster_id:i, metric_id:i, mean_z:d, metric_name | SELECT * FROM prof JOIN mdim USING (metric_id) WHERE year = 1998 AND cluster_id = 1")
_add("l13_freshness", lambda s, d: serve.freshness(demo.fact(s, d), demo.regions(s, d), demo.dev(s, d)), "last_year:i, included:i, index_year:i | SELECT (SELECT max(year) FROM fact) AS last_year, (SELECT count(*) FROM regions WHERE included) AS included, (SELECT max(year) FROM dev) AS index_year")
_add("l14_agreement_list", lambda s, d: serve.serve(ranks.scheme_agreement(demo.dev(s, d)), {"year": (1996, 1999)}, order=["year"]), f"year:i, scheme_a, scheme_b, spearman:d, n:i | SELECT * FROM ({_AGREE}) WHERE year BETWEEN 1996 AND 1999")

_list("l10_decomposition_list", "d11_decompose_index", {"entity": "04", "year": (1997, 1999)}, "entity = '04' AND year BETWEEN 1997 AND 1999", "entity", "region_name")
_list("l10_local_moran_list", "h4_moran_local", {"scheme": "equal", "year": 1998}, "scheme = 'equal' AND year = 1998", "entity", "region_name")


def _plain(name: str, of: str, filters: dict, where: str, order: list[str]) -> None:
    """The rows of another query that the filters leave, in order."""
    columns, body = SQL[of].split("|", 1)
    QUERIES[name] = lambda s, d: serve.serve(QUERIES[of](s, d), filters, order=order)
    SQL[name] = f"{columns} | SELECT * FROM ({body}) WHERE {where}"


_plain("l14_dispersion_list", "f2_index_dispersion", {"scheme": "equal"}, "scheme = 'equal'", ["year"])
_plain("l14_beta_list", "f3_beta_convergence", {}, "true", ["scheme"])
_plain("l14_moran_list", "h2_moran_global", {"scheme": "expert", "year": 1998}, "scheme = 'expert' AND year = 1998", ["year"])
_add("l3_metrics_by_coverage", lambda s, d: serve.search(demo.metrics(s).withColumn("coverage", F.when(F.col("metric_id") != 2, F.col("coverage"))).select("metric_id", "metric_name", "coverage"), "metric_name", "E", [F.col("coverage").desc_nulls_last(), "metric_id"], 5),
     "metric_id:i, metric_name, coverage:d | SELECT metric_id, metric_name, nullif(coverage, 0.9) AS coverage FROM mdim WHERE lower(metric_name) LIKE '%e%' ORDER BY coverage DESC NULLS LAST, metric_id LIMIT 5")
