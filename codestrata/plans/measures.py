"""Roll-ups and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import formula
from codestrata.operators.quantiles import percentiles
from codestrata.operators.rank import severity_rank
from codestrata.operators.rollup import aggregates, leaves, roll, roll_by_definition, roll_up_paths, weighted_mean
from codestrata.operators.rules import severity
from codestrata.plans import graphs
from codestrata.plans.base import SUBJECTS, rounded, seven, subjects
from codestrata.session import cut
from codestrata.tables import table


def _sales(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the keys of every level above them; dimensions join by key, Catalyst picks how."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", "r_name")
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("customer"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("l_extendedprice").alias("price"))
    )


def agg_strategies_by_level(spark: SparkSession, folder: str) -> DataFrame:
    """The seven aggregates of raw line prices at each level. Customers' percentiles come from their own few values; the
    levels above hold a constant share of the table, so theirs are narrowed down and the rest is added up."""
    sales = _sales(spark, folder)
    lowest = cut(roll(sales, ["region", "nation", "customer"], ["price"]))
    customers = lowest.select(F.lit("customer").alias("level"), F.col("customer").cast("string").alias("name"), *[c for c in lowest.columns if c.startswith("price_")])
    levels = F.array(*[F.struct(F.lit(n).alias("level"), c.alias("name")) for n, c in (("nation", F.col("nation")), ("region", F.col("region")), ("all", F.lit("")))])
    above = lowest.select(F.explode(levels).alias("l"), "price_sum", "price_count", "price_max", "price_min").groupBy("l.level", "l.name").agg(
        F.sum("price_sum").alias("price_sum"), F.sum("price_count").alias("price_count"), F.max("price_max").alias("price_max"), F.min("price_min").alias("price_min")
    )
    above = above.withColumn("price_avg", F.try_divide("price_sum", "price_count"))
    found = percentiles(sales.select(F.explode(levels).alias("l"), "price").select("l.level", "l.name", "price"), ["level", "name"], "price", [0.95, 0.05])
    wide = found.groupBy("level", "name").agg(F.max(F.when(F.col("share") == 0.95, F.col("percentile"))).alias("price_p95"), F.max(F.when(F.col("share") == 0.05, F.col("percentile"))).alias("price_p5"))
    whole = customers.unionByName(above.join(wide, ["level", "name"], "left"))
    # cents over at most 64 lines have 8 digits: rounded to fewer, the last might hang on the order of a sum
    return rounded(whole.withColumn("price_sum", F.round("price_sum", 2)).withColumn("avg", F.round("price_avg", 8).cast("decimal(18,8)")).drop("price_avg"), 4).withColumn("price_avg", F.col("avg").cast("double")).drop("avg")


def rollup_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: levels whose p95 price is high are findings, worst first."""
    rows = agg_strategies_by_level(spark, folder)
    level = severity(F.col("price_p95"), F.lit(88000.0), F.lit(90000.0), "higher")
    found = rows.withColumn("severity", level).where("severity IS NOT NULL")
    return found.select("level", "name", "price_count", "price_p95", "severity").orderBy(severity_rank(F.col("severity")), F.desc("price_p95"), "level", "name")


def region_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of very large groups, found by narrowing instead of by holding a group's values."""
    return rounded(percentiles(_sales(spark, folder).select("region", "price"), ["region"], "price", [0.05, 0.5, 0.95]), 4)


_SALES = """
WITH sales AS (SELECT c_custkey, n_name, r_name, l_extendedprice AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey
               JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
lv AS (SELECT 'customer' AS level, c_custkey::VARCHAR AS name, price FROM sales UNION ALL SELECT 'nation', n_name, price FROM sales
       UNION ALL SELECT 'region', r_name, price FROM sales UNION ALL SELECT 'all', '', price FROM sales),
agg AS (SELECT level, name, """ + seven("price", "price").replace(", 6)", ", 2)").replace("round(avg(price), 9)", "round(avg(price), 8)").replace(", 9)", ", 4)") + " FROM lv GROUP BY ALL)\n"


def callable_to_class(spark: SparkSession, folder: str) -> DataFrame:
    rows = subjects(spark, folder).where("type = 'method'")
    out = rows.groupBy("project", "class_key").agg(*aggregates(F.col("ccn"), "ccn"), F.sum("ccn").alias("wmc"), F.count("*").alias("symbol_method_count"))
    return rounded(out)


def namespace_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Every namespace and ancestor from the raw values of all callables below it."""
    rows = subjects(spark, folder).where("type IN ('method', 'function') AND namespace <> ''")
    return rounded(roll_up_paths(rows, "namespace", ["ccn", "loc"], ["project"]))


def project_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """All callables of a project, and classes per leaf namespace averaged over leaves only."""
    rows = subjects(spark, folder)
    raw = roll(rows.where("type IN ('method', 'function')"), ["project"], ["mi", "ccn"], large=True)
    classes = rows.where("type = 'class' AND namespace <> ''")
    leaf = leaves(classes, "namespace", ["project"])
    per_leaf = classes.join(leaf, ["project", "namespace"], "left_semi").groupBy("project", "namespace").agg(F.count("*").alias("n"))
    avg = per_leaf.groupBy("project").agg(F.avg("n").alias("class_count_avg"), F.count("*").alias("leaf_namespaces"))
    return rounded(raw.join(avg, "project", "left"))


DEFINITIONS = [  # metric, level at which it is collected, level at which it is aggregated, strategy
    ("ccn", "callable", "class", "sum"), ("ccn", "callable", "class", "avg"), ("ccn", "callable", "class", "max"), ("ccn", "callable", "class", "p95"),
    ("mi", "callable", "class", "avg"), ("mi", "callable", "class", "min"), ("mi", "callable", "class", "p5"), ("loc", "callable", "class", "sum"),
]


def definition_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = subjects(spark, folder).where("type = 'method'")
    long = rows.select("project", "class_key", F.lit("callable").alias("level"), F.expr("stack(3, 'ccn', cast(ccn as double), 'mi', mi, 'loc', cast(loc as double)) as (metric, value)"))
    definitions = spark.createDataFrame(DEFINITIONS, "metric string, collected_at string, target_level string, strategy string")
    return rounded(roll_by_definition(long, definitions, ["project", "class_key"], large=True))


def weighted_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Mean maintainability of namespaces, weighted by lines."""
    rows = subjects(spark, folder).where("type = 'method'")
    return rounded(rows.groupBy("project", "namespace").agg(weighted_mean(F.col("mi"), F.col("loc")).alias("mi"), F.sum("loc").alias("loc")))


def _class_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = subjects(spark, folder)
    m = rows.where("type = 'method'").groupBy("project", "class_key").agg(
        F.avg("ccn").alias("ccn__avg"), F.max("ccn").cast("double").alias("ccn__max"), F.avg("mi").alias("mi__avg"), F.min("mi").alias("mi__min"), F.count("*").cast("double").alias("methodCount")
    )
    coupled = graphs.coupling_class(spark, folder).select("project", F.col("class").alias("class_key"), F.col("ce").cast("double").alias("ce"), F.col("ce_packages").cast("double").alias("ce_packages"))
    return formula.compute(m.join(coupled, ["project", "class_key"], "left"), formula.HEALTH_CLASS)


def health_class(spark: SparkSession, folder: str) -> DataFrame:
    """Default scores of classes from what `symbols` measures and the classes they depend on; what isn't measured (cohesion,
    types) has its formula's default."""
    out = _class_scores(spark, folder)
    return rounded(out.select("project", "class_key", *[c for c in out.columns if c.startswith("health__")]), 4)


def health_namespace(spark: SparkSession, folder: str) -> DataFrame:
    rows = subjects(spark, folder).where("type IN ('method', 'function') AND namespace <> ''")
    rolled = roll_up_paths(rows, "namespace", ["ccn", "mi"], ["project"], large=True)
    named = rolled.select("project", "namespace", *[F.col(f"{m}_{s}").cast("double").alias(f"{m}__{s}") for m in ("ccn", "mi") for s in ("sum", "avg", "max", "min", "p95", "p5")], F.col("ccn_count").cast("double").alias("symbolMethodCount"))
    out = formula.compute(named, formula.HEALTH_NAMESPACE)
    return rounded(out.select("project", "namespace", *[c for c in out.columns if c.startswith("health__")]), 4)


CUSTOM = {"computed.size": "log(max(methodCount, 1)) ** 2", "computed.risk": "computed__size * (ccn__max ?? 1) / (mi__min - 40)", "computed.flag": "computed__risk > 10 && methodCount in [1, 2, 3] ? 1 : (computed__risk < 0 ? -1 : 0)"}


def formula_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Formulas that use each other; a division by zero leaves its metric out, and what uses it."""
    out = formula.compute(_class_scores(spark, folder), CUSTOM)
    return rounded(out.select("project", "class_key", *[n.replace(".", "__") for n in CUSTOM]), 4)


_PATHS = ", spread AS (SELECT s.*, unnest(range(1, len(string_split(namespace, chr(92))) + 1)) AS depth FROM sub s WHERE type IN ('method', 'function') AND namespace <> ''), up AS (SELECT project, array_to_string(string_split(namespace, chr(92))[1:depth], chr(92)) AS namespace, ccn, loc, mi FROM spread)\n"
_CLASS_HEALTH = ", cc AS (" + graphs.ORACLE["coupling_class"] + """), m AS (SELECT project, class_key, avg(ccn) AS ca, max(ccn) AS cm, avg(mi) AS ma, min(mi) AS mm, count(*)::DOUBLE AS mc FROM sub WHERE type = 'method' GROUP BY ALL),
h AS (SELECT m.project, class_key, m.ca, cm, ma, mm, mc,
  greatest(0, least(100, 100 - 2 * greatest(coalesce(m.ca, 1) - 4, 0) - 2 * sqrt(greatest(coalesce(cm, 0) - 10, 0)))) AS cx,
  greatest(0, least(100, 50 * sqrt(CASE WHEN mc < 6 THEN 0.5 ELSE 0 END) + 50)) AS coh, greatest(0, least(100, 1500 / (15 + greatest(3 * coalesce(ce_packages, 0) + 0.5 * sqrt(coalesce(ce, 0)) - 5, 0)))) AS cou, 0.0::DOUBLE AS typ,
  greatest(0, least(100, 100 - 1.5 * greatest(85 - coalesce(ma, 75), 0) - 3 * sqrt(greatest(50 - coalesce(mm, 50), 0)))) AS mai FROM m LEFT JOIN cc ON cc.project = m.project AND cc.class = m.class_key)
"""

QUERIES = {
    "rollup_findings": rollup_findings, "agg_strategies_by_level": agg_strategies_by_level, "region_percentiles": region_percentiles, "callable_to_class": callable_to_class, "namespace_rollup": namespace_rollup,
    "project_rollup": project_rollup, "definition_rollup": definition_rollup, "weighted_rollup": weighted_rollup, "health_class": health_class, "health_namespace": health_namespace, "formula_chain": formula_chain,
}
_LONG = ", l AS (SELECT project, class_key, unnest(['ccn', 'mi', 'loc']) AS m, unnest([ccn::DOUBLE, mi, loc::DOUBLE]) AS v FROM sub WHERE type = 'method')\n"
ORACLE = {
    "agg_strategies_by_level": _SALES + "SELECT * FROM agg",
    "rollup_findings": _SALES + "SELECT level, name, price_count, price_p95, CASE WHEN price_p95 >= 90000 THEN 'error' ELSE 'warning' END AS severity FROM agg WHERE price_p95 >= 88000",
    "region_percentiles": _SALES + ", r AS (SELECT r_name AS region, unnest([0.05, 0.5, 0.95]::DOUBLE[]) AS share, unnest(quantile_cont(price, [0.05, 0.5, 0.95])) AS p FROM sales GROUP BY r_name) SELECT region, share, round(p, 4) AS percentile FROM r",
    "callable_to_class": SUBJECTS + f"SELECT project, class_key, {seven('ccn', 'ccn')}, sum(ccn)::BIGINT AS wmc, count(*) AS symbol_method_count FROM sub WHERE type = 'method' GROUP BY ALL",
    "namespace_rollup": SUBJECTS + _PATHS + f"SELECT project, namespace, {seven('ccn', 'ccn')}, {seven('loc', 'loc')} FROM up GROUP BY ALL",
    "project_rollup": SUBJECTS
    + f""", raw AS (SELECT project, {seven('mi', 'mi')}, {seven('ccn', 'ccn')} FROM sub WHERE type IN ('method', 'function') GROUP BY ALL),
c AS (SELECT project, namespace, count(*) AS n FROM sub WHERE type = 'class' AND namespace <> '' GROUP BY ALL),
lf AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.project = c.project AND starts_with(d.namespace, c.namespace || chr(92)))),
a AS (SELECT project, round(avg(n), 9) AS class_count_avg, count(*) AS leaf_namespaces FROM lf GROUP BY ALL)
SELECT raw.*, class_count_avg, leaf_namespaces FROM raw LEFT JOIN a USING (project)""",
    "definition_rollup": SUBJECTS
    + _LONG
    + """, r AS (SELECT project, class_key, m, sum(v) AS s, avg(v) AS a, max(v) AS mx, min(v) AS mn, count(v)::DOUBLE AS c, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.05) AS p5 FROM l WHERE v IS NOT NULL GROUP BY ALL)
SELECT project, class_key, 'class' AS target_level, m || '.' || t.n AS metric, round(t.v, 9) AS value FROM r,
  LATERAL (SELECT unnest(['sum', 'avg', 'count', 'max', 'p95', 'min', 'p5']) AS n, unnest([s, a, c, mx, p95, mn, p5]) AS v) t
WHERE (m, t.n) IN (('ccn', 'sum'), ('ccn', 'avg'), ('ccn', 'count'), ('ccn', 'max'), ('ccn', 'p95'), ('mi', 'avg'), ('mi', 'count'), ('mi', 'min'), ('mi', 'p5'), ('loc', 'sum'))""",
    "weighted_rollup": SUBJECTS
    + """SELECT project, namespace, round(sum(mi * loc) FILTER (WHERE mi IS NOT NULL AND loc IS NOT NULL) / nullif(sum(loc) FILTER (WHERE mi IS NOT NULL AND loc IS NOT NULL), 0), 9) AS mi, sum(loc)::BIGINT AS loc
FROM sub WHERE type = 'method' GROUP BY ALL""",
    "health_class": SUBJECTS
    + _CLASS_HEALTH
    + """SELECT project, class_key, round(cx, 4) AS health__complexity, round(coh, 4) AS health__cohesion, round(cou, 4) AS health__coupling, round(typ, 4) AS health__typing,
round(mai, 4) AS health__maintainability, round(greatest(0, least(100, .35 * cx + .25 * coh + .25 * cou + .15 * typ)), 4) AS health__overall FROM h""",
    "health_namespace": SUBJECTS
    + _PATHS
    + """, r AS (SELECT project, namespace, sum(ccn) AS cs, max(ccn) AS cm, quantile_cont(ccn::DOUBLE, 0.95) AS cp, count(ccn) AS n, avg(mi) AS ma, min(mi) AS mm, quantile_cont(mi, 0.05) AS mp FROM up GROUP BY ALL),
h AS (SELECT *, greatest(0, least(100, 100 - 1.5 * greatest(coalesce(cs, 0) / greatest(n, 1) - 3, 0) - 3 * sqrt(greatest(coalesce(cp, 0) - 5, 0)) - 0.8 * sqrt(greatest(coalesce(cm, 0) - 20, 0)))) AS cx,
  greatest(0, least(100, 50 * sqrt(0.5) + 50)) AS coh, 100.0::DOUBLE AS cou, 100.0::DOUBLE AS typ,
  greatest(0, least(100, 100 - 2 * greatest(82 - coalesce(ma, 75), 0) - 4.5 * sqrt(greatest(55 - coalesce(mp, 55), 0)) - 1.5 * pow(greatest(5 - coalesce(mm, 5), 0), 0.4))) AS mai FROM r)
SELECT project, namespace, round(cx, 4) AS health__complexity, round(coh, 4) AS health__cohesion, round(cou, 4) AS health__coupling, typ AS health__typing, round(mai, 4) AS health__maintainability,
round(greatest(0, least(100, .3 * cx + .2 * coh + .2 * cou + .1 * typ + .2 * mai)), 4) AS health__overall FROM h""",
    "formula_chain": SUBJECTS
    + _CLASS_HEALTH
    + """, f AS (SELECT project, class_key, mc, pow(ln(greatest(mc, 1)), 2) AS sz, pow(ln(greatest(mc, 1)), 2) * coalesce(cm, 1) / nullif(mm - 40, 0) AS rk FROM h)
SELECT project, class_key, round(sz, 4) AS computed__size, round(rk, 4) AS computed__risk,
CASE WHEN rk > 10 AND mc IN (1, 2, 3) THEN 1.0::DOUBLE WHEN rk < 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS computed__flag FROM f""",
}
