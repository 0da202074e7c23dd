"""Dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.matching import BUILTIN, capture, namespace_matches, substitute
from codestrata.operators import graph, rules
from codestrata.plans.base import rounded
from codestrata.plans.hierarchy import NAME_SQL, class_name
from codestrata.session import cut
from codestrata.tables import table

FRAMEWORK = ("Vellum", "Tundra")  # namespaces of libraries that the projects build on
LAYERS = ("Domain", "Infrastructure", "Console", "Http")
ALLOWED = [("Http", "Domain", None), ("Console", "Domain", None), ("Infrastructure", "Domain", "implements"), ("Infrastructure", "Domain", "extends")]


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "edges")


def _classes(spark: SparkSession, folder: str) -> DataFrame:
    """The classes of each project with their namespace: those with edges out, and those with edges in that the project
    declares, in whatever spelling."""
    edges = _edges(spark, folder)
    declared = table(spark, folder, "class_decls").where("fqcn IS NOT NULL").select(F.col("project").alias("dp"), class_name(F.col("fqcn")).alias("key")).distinct()
    users = edges.where("src_class IS NOT NULL").select("project", F.col("src_class").alias("class"), F.col("src_ns").alias("namespace"))
    used = edges.where("dst_class IS NOT NULL").groupBy("project", F.col("dst_class").alias("class")).agg(F.max("dst_ns").alias("namespace"))
    used = used.join(declared, F.col("project").eqNullSafe(F.col("dp")) & (class_name(F.col("class")) == F.col("key")), "left_semi")
    return users.unionByName(used).groupBy("project", "class").agg(F.max("namespace").alias("namespace"))


def coupling_class(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(graph.class_coupling(graph.without_builtins(_edges(spark, folder)), FRAMEWORK))


def coupling_namespace(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(graph.namespace_coupling(_edges(spark, folder)))


def coupling_boundary(spark: SparkSession, folder: str) -> DataFrame:
    return graph.boundary_coupling(_edges(spark, folder))


def main_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """Abstractness, instability and distance of namespaces. The tables name no kinds of classes, so a class that others
    implement is an interface here, one that others extend is abstract, and a used one is a trait."""
    kind = F.when(F.max(F.col("dep_type") == "implements"), "interface").when(F.max(F.col("dep_type") == "extends"), "abstract").otherwise("class")
    used = _edges(spark, folder).where("dst_class IS NOT NULL AND dst_ns IS NOT NULL").groupBy("project", F.col("dst_ns").alias("namespace"), "dst_class").agg(kind.alias("kind"))
    a, i = graph.abstractness(used), graph.namespace_coupling(_edges(spark, folder)).select("project", "namespace", "instability")
    out = a.join(i, ["project", "namespace"])
    return rounded(out.withColumn("distance", graph.distance(F.col("abstractness"), F.col("instability"))))


def noc(spark: SparkSession, folder: str) -> DataFrame:
    return graph.children(_edges(spark, folder), _classes(spark, folder))


def dit(spark: SparkSession, folder: str) -> DataFrame:
    return graph.inheritance_depth(_edges(spark, folder), _classes(spark, folder))


def class_rank(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(graph.class_rank(_edges(spark, folder), _classes(spark, folder)))


def class_rank_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The ranks after 12 rounds, the tolerance being out of reach."""
    return rounded(graph.class_rank(_edges(spark, folder), _classes(spark, folder), tolerance=0.0, rounds=12))


def rank_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Classes whose rank is high for the size of their project."""
    return rules.rank_findings(graph.class_rank(_edges(spark, folder), _classes(spark, folder), tolerance=0.0, rounds=12)).select("project", "class", "severity")


def cycle_members(spark: SparkSession, folder: str) -> DataFrame:
    """Each strongly connected class with the first class of its component, and how many there are."""
    members = cut(graph.strongly_connected(_cycle_graph(spark, folder)))
    return members.join(members.groupBy("component").agg(F.count("*").alias("size")), "component")


def _cycle_graph(spark: SparkSession, folder: str) -> DataFrame:
    return graph.distinct_edges(_edges(spark, folder)).select(F.concat_ws("::", "project", "src_class").alias("src"), F.concat_ws("::", "project", "dst_class").alias("dst"))


def circular_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """Strongly connected classes, with the shortest cycle through the first."""
    edges = _cycle_graph(spark, folder)
    found = graph.shortest_cycles(edges, graph.strongly_connected(edges))
    return found.select("component", "size", F.array_join("members", " ").alias("members"), F.array_join("cycle", " ").alias("cycle"), F.when(F.col("size") <= 2, "error").otherwise("warning").alias("severity"))


def connected_namespaces(spark: SparkSession, folder: str) -> DataFrame:
    """Classes that any chain of dependencies connects, per project."""
    edges = _cycle_graph(spark, folder)
    return graph.connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def _layered(spark: SparkSession, folder: str) -> DataFrame:
    ns = F.col("namespace")
    layers = [(n, graph.layer_criteria([namespace_matches(ns, [f"*\\{n}", f"*\\{n}\\*"])], exclude=[[F.col("class").endswith("Factory")]])) for n in LAYERS]
    return graph.assign_layers(_classes(spark, folder), layers)


def layer_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """How many classes are in each layer, how many are in several, and how many in none."""
    rows = _layered(spark, folder)
    return rows.groupBy("project", F.coalesce("layer", F.lit("(none)")).alias("layer")).agg(F.count("*").alias("classes"), F.count_if(F.size("matches") > 1).alias("shadowed"))


def layer_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return graph.layer_diagnostics(_layered(spark, folder), LAYERS)


def class_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """Every class with each class and interface above it, by extends and implements."""
    up = _edges(spark, folder).where("dep_type IN ('extends', 'implements') AND src_class <> dst_class")
    pairs = up.select(F.concat_ws("::", "project", "src_class").alias("src"), F.concat_ws("::", "project", "dst_class").alias("dst"))
    return graph.reachable(pairs)


def layer_violations(spark: SparkSession, folder: str) -> DataFrame:
    allowed = spark.createDataFrame(ALLOWED, "src_layer string, dst_layer string, dep_type string")
    found = graph.layer_violations(_edges(spark, folder), _layered(spark, folder), allowed)
    return found.groupBy("project", "src_class", "dst_class", "dep_type", "src_layer", "dst_layer").agg(F.count("*").alias("edges"))


def layer_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Concrete layers from a template: one for each pair of captured names that occurs."""
    bound = _classes(spark, folder).select(capture(F.col("namespace"), "{app}\\{part}\\**").alias("b")).where("b IS NOT NULL")
    return bound.select(substitute("{part} of {app}", F.col("b")).alias("layer")).groupBy("layer").agg(F.count("*").alias("classes"))


def layer_inspection(spark: SparkSession, folder: str) -> DataFrame:
    """The classes that the Infrastructure layer matches, by the layer that they get."""
    ns = F.col("namespace")
    layers = [(n, graph.layer_criteria([namespace_matches(ns, [f"*\\{n}", f"*\\{n}\\*"])])) for n in LAYERS]
    rows = graph.inspect_layer(_classes(spark, folder), layers, "Infrastructure")
    return rows.groupBy("project", "layer", "taken").agg(F.count("*").alias("classes"))


def part_export(spark: SparkSession, folder: str) -> DataFrame:
    """The exported edges of the parts named Domain."""
    return graph.edge_export(graph.in_namespaces(_edges(spark, folder), ["*\\Domain\\*"]))


def edge_export(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edge_export(_edges(spark, folder))


_CL = f"""dk AS (SELECT DISTINCT project, {NAME_SQL.format("fqcn")} AS k FROM class_decls WHERE fqcn IS NOT NULL),
us AS (SELECT project, dst_class AS class, max(dst_ns) AS ns FROM edges WHERE dst_class IS NOT NULL GROUP BY ALL),
cl AS (SELECT project, class, max(ns) AS ns FROM (SELECT project, src_class AS class, src_ns AS ns FROM edges WHERE src_class IS NOT NULL
  UNION ALL SELECT us.* FROM us JOIN dk ON dk.project = us.project AND dk.k = {NAME_SQL.format("us.class")}) GROUP BY ALL)"""
_BUILT = "regexp_matches({0}, '" + BUILTIN.replace("'", "''") + "')"
RANK_SQL = f"""WITH RECURSIVE {_CL}, pr AS (SELECT DISTINCT e.project, src_class AS s, dst_class AS d FROM edges e JOIN cl a ON a.project = e.project AND a.class = src_class JOIN cl b ON b.project = e.project AND b.class = dst_class WHERE src_class <> dst_class),
dg AS (SELECT project, s, count(*) AS deg FROM pr GROUP BY ALL), n AS (SELECT project, count(*) AS n FROM cl GROUP BY ALL),
r0 AS (SELECT cl.project, cl.class, 1.0::DOUBLE / n AS rank, n, coalesce(deg, 0) AS deg FROM cl JOIN n USING (project) LEFT JOIN dg ON dg.project = cl.project AND dg.s = cl.class)
""" + "".join(
    f""", g{i} AS (SELECT pr.project, pr.d, sum(rank / deg) AS got FROM pr JOIN r{i} ON r{i}.project = pr.project AND r{i}.class = pr.s GROUP BY ALL), w{i} AS (SELECT project, sum(rank) FILTER (WHERE deg = 0) AS loose FROM r{i} GROUP BY ALL),
r{i + 1} AS (SELECT r.project, r.class, 0.15 / n + 0.85 * (coalesce(got, 0) + coalesce(loose, 0) / n) AS rank, n, deg FROM r{i} r LEFT JOIN g{i} g ON g.project = r.project AND g.d = r.class LEFT JOIN w{i} w ON w.project = r.project)"""
    for i in range(12)
)
_PAIRS = "WITH RECURSIVE pr AS (SELECT DISTINCT project, src_class AS s, dst_class AS d FROM edges WHERE src_class <> dst_class{where})\n"
_NS = """WITH e AS (SELECT project, coalesce(src_ns, '') AS s, coalesce(dst_ns, '') AS d, src_class, dst_class FROM edges WHERE src_class IS NOT NULL AND dst_class IS NOT NULL AND coalesce(src_ns, '') <> coalesce(dst_ns, '')),
b AS (SELECT project, s AS namespace, d AS o, dst_class AS c, true AS outward FROM e UNION SELECT project, d, s, src_class, false FROM e),
n AS (SELECT project, namespace, count(DISTINCT c) FILTER (WHERE outward) AS ce, count(DISTINCT c) FILTER (WHERE NOT outward) AS ca, count(DISTINCT o) AS cbo FROM b GROUP BY ALL),
ni AS (SELECT *, coalesce(ce / nullif(ca + ce, 0), 0.0)::DOUBLE AS inst FROM n)
"""
_LAYERED = f"WITH {_CL}" + """,
lm AS (SELECT *, list_filter(['Domain', 'Infrastructure', 'Console', 'Http'], lambda x: coalesce((ends_with(ns, chr(92) || x) OR contains(ns, chr(92) || x || chr(92))) AND NOT ends_with(class, 'Factory'), false)) AS m FROM cl),
ly AS (SELECT project, class, m[1] AS layer, len(m) AS n FROM lm)
"""
QUERIES = {f.__name__: f for f in (coupling_class, coupling_namespace, coupling_boundary, main_sequence, noc, dit, class_rank, class_rank_rounds, rank_findings, cycle_members, circular_dependencies, connected_namespaces, layer_assignment, layer_diagnostics, class_ancestors, layer_violations, layer_templates, layer_inspection, part_export, edge_export)}
ORACLE = {
    "coupling_class": _PAIRS.format(where=f" AND (NOT {_BUILT.format('dst_class')} OR dep_type = 'extends')")
    + """, o AS (SELECT project, s AS class, d AS other, 1 AS o, 0 AS i FROM pr UNION ALL SELECT project, d, s, 0, 1 FROM pr), u AS (SELECT project, class, other, max(o) AS o, max(i) AS i FROM o GROUP BY ALL)
SELECT project, class, sum(o)::BIGINT AS ce, sum(i)::BIGINT AS ca, count(*) AS cbo,
count(DISTINCT CASE WHEN o = 1 AND split_part(other, chr(92), 1) <> split_part(class, chr(92), 1) THEN split_part(other, chr(92), 1) END) AS ce_packages, count(*) FILTER (WHERE o = 1 AND regexp_matches(other, '^(Vellum|Tundra)\\\\')) AS ce_framework, count(*) FILTER (WHERE NOT regexp_matches(other, '^(Vellum|Tundra)\\\\')) AS cbo_app, round(coalesce(sum(o) / nullif(sum(o) + sum(i), 0), 0.0), 9) AS instability FROM u GROUP BY ALL""",
    "coupling_namespace": _NS + "SELECT project, namespace, ce, ca, cbo, round(inst, 9) AS instability FROM ni",
    "coupling_boundary": """WITH e AS (SELECT project, src_class, dst_class, coalesce(src_ns, '') AS s, coalesce(dst_ns, '') AS d FROM edges WHERE src_class IS NOT NULL AND dst_class IS NOT NULL),
p AS (SELECT *, CASE WHEN s = '' THEN [] ELSE list_transform(range(1, len(string_split(s, chr(92))) + 1), lambda i: array_to_string(string_split(s, chr(92))[1:i], chr(92))) END AS a,
  CASE WHEN d = '' THEN [] ELSE list_transform(range(1, len(string_split(d, chr(92))) + 1), lambda i: array_to_string(string_split(d, chr(92))[1:i], chr(92))) END AS b FROM e),
x AS (SELECT project, unnest(list_filter(a, lambda v: NOT list_contains(b, v))) AS namespace, dst_class AS o, true AS outward FROM p UNION SELECT project, unnest(list_filter(b, lambda v: NOT list_contains(a, v))), src_class, false FROM p)
SELECT project, namespace, count(*) FILTER (WHERE outward) AS ce, count(*) FILTER (WHERE NOT outward) AS ca FROM x GROUP BY ALL""",
    "main_sequence": _NS
    + """, k AS (SELECT project, dst_ns AS namespace, dst_class, bool_or(dep_type = 'implements') AS im, bool_or(dep_type = 'extends') AS ex FROM edges WHERE dst_class IS NOT NULL AND dst_ns IS NOT NULL GROUP BY ALL),
ab AS (SELECT project, namespace, count(*) FILTER (WHERE im OR ex) / count(*) AS a FROM k GROUP BY ALL)
SELECT project, namespace, round(a, 9) AS abstractness, round(inst, 9) AS instability, round(abs(a + inst - 1), 9) AS distance FROM ab JOIN ni USING (project, namespace)""",
    "noc": f"""WITH {_CL}, k AS (SELECT project, dst_class AS class, count(DISTINCT src_class) AS n FROM edges WHERE dep_type = 'extends' AND src_class <> dst_class GROUP BY ALL)
SELECT project, class, coalesce(n, 0) AS noc FROM cl LEFT JOIN k USING (project, class)""",
    "dit": f"""WITH RECURSIVE {_CL}, p0 AS (SELECT project, src_class AS c, min(dst_class) AS e FROM edges WHERE dep_type = 'extends' AND src_class IS NOT NULL AND dst_class IS NOT NULL GROUP BY ALL),
p AS (SELECT project, c, CASE WHEN {_BUILT.format('e')} THEN chr(1) || e ELSE e END AS e FROM p0),
reach AS (SELECT project, c, e AS x FROM p UNION SELECT r.project, r.c, p.e FROM reach r JOIN p ON p.project = r.project AND p.c = r.x),
least AS (SELECT a.project, a.c, min(b.x) AS f FROM reach a JOIN reach b ON b.project = a.project AND b.c = a.c WHERE a.c = a.x GROUP BY ALL),
q AS (SELECT p.project, p.c, CASE WHEN least.f = p.e THEN chr(2) || p.e ELSE p.e END AS e FROM p LEFT JOIN least ON least.project = p.project AND least.c = p.c),
t AS (SELECT project, c, 1 AS dit FROM q WHERE (project, e) NOT IN (SELECT (project, c) FROM q) UNION ALL SELECT q.project, q.c, t.dit + 1 FROM t JOIN q ON q.project = t.project AND q.e = t.c)
SELECT cl.project, cl.class, coalesce(t.dit, 0)::BIGINT AS dit FROM cl LEFT JOIN t ON t.project = cl.project AND t.c = cl.class""",
    "class_rank_rounds": RANK_SQL + "SELECT project, class, round(rank, 9) AS rank FROM r12",
    "rank_findings": RANK_SQL + "SELECT project, class, CASE WHEN rank >= 0.05 / sqrt(n / 100.0) THEN 'error' ELSE 'warning' END AS severity FROM r12 WHERE rank >= 0.02 / sqrt(n / 100.0)",
    "cycle_members": _PAIRS.format(where="") + """, cc AS (SELECT project || '::' || s AS a, project || '::' || d AS b FROM pr), rc AS (SELECT a, b FROM cc UNION SELECT rc.a, cc.b FROM rc JOIN cc ON cc.a = rc.b),
m AS (SELECT x.a AS node, min(x.b) AS component FROM rc x JOIN rc y ON y.a = x.b AND y.b = x.a GROUP BY ALL) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM m""",
    "layer_assignment": _LAYERED + "SELECT project, coalesce(layer, '(none)') AS layer, count(*) AS classes, count(*) FILTER (WHERE n > 1) AS shadowed FROM ly GROUP BY ALL",
    "layer_diagnostics": _LAYERED.replace("m[1] AS layer, len(m) AS n", "m[1] AS layer, m")
    + """, d AS (SELECT unnest(['Domain', 'Infrastructure', 'Console', 'Http']) AS layer, unnest([0, 1, 2, 3]) AS ordinal), c AS (SELECT ordinal, d.layer, (SELECT count(*) FROM ly WHERE ly.layer = d.layer) AS classes, (SELECT count(*) FROM ly WHERE list_contains(m, d.layer)) AS matched FROM d)
SELECT *, CASE WHEN matched = 0 THEN 'empty' WHEN classes = 0 THEN 'shadowed' ELSE 'used' END AS status FROM c""",
    "class_ancestors": """WITH RECURSIVE e AS (SELECT DISTINCT project || '::' || src_class AS src, project || '::' || dst_class AS dst FROM edges WHERE dep_type IN ('extends', 'implements') AND src_class <> dst_class),
r AS (SELECT * FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r""",
    "layer_violations": _LAYERED
    + """SELECT e.project, src_class, dst_class, dep_type, a.layer AS src_layer, b.layer AS dst_layer, count(*) AS edges FROM edges e JOIN ly a ON a.project = e.project AND a.class = e.src_class JOIN ly b ON b.project = e.project AND b.class = e.dst_class
WHERE a.layer <> b.layer AND NOT ((a.layer = 'Http' AND b.layer = 'Domain') OR (a.layer = 'Console' AND b.layer = 'Domain') OR (a.layer = 'Infrastructure' AND b.layer = 'Domain' AND dep_type IN ('implements', 'extends'))) GROUP BY ALL""",
    "layer_templates": f"WITH {_CL}" + """
SELECT split_part(ns, chr(92), 2) || ' of ' || split_part(ns, chr(92), 1) AS layer, count(*) AS classes FROM cl WHERE len(string_split(ns, chr(92))) >= 3 GROUP BY ALL""",
    "layer_inspection": f"WITH {_CL}" + """,
lm AS (SELECT project, list_filter(['Domain', 'Infrastructure', 'Console', 'Http'], lambda x: coalesce(ends_with(ns, chr(92) || x) OR contains(ns, chr(92) || x || chr(92)), false)) AS m FROM cl)
SELECT project, m[1] AS layer, m[1] = 'Infrastructure' AS taken, count(*) AS classes FROM lm WHERE list_contains(m, 'Infrastructure') GROUP BY ALL""",
    "part_export": """SELECT project, src_class AS "from", dst_class AS "to", list_sort(list_distinct(list(dep_type))) AS types, count(*) AS count FROM edges
WHERE src_class IS NOT NULL AND dst_class IS NOT NULL AND (coalesce(contains(src_ns, chr(92) || 'Domain' || chr(92)), false) OR coalesce(contains(dst_ns, chr(92) || 'Domain' || chr(92)), false)) GROUP BY ALL""",
    "edge_export": 'SELECT project, src_class AS "from", dst_class AS "to", list_sort(list_distinct(list(dep_type))) AS types, count(*) AS count FROM edges WHERE src_class IS NOT NULL AND dst_class IS NOT NULL GROUP BY ALL',
    "connected_namespaces": _PAIRS.format(where="")
    + """, nb AS (SELECT project || '::' || s AS a, project || '::' || d AS b FROM pr UNION SELECT project || '::' || d, project || '::' || s FROM pr),
cc AS (SELECT DISTINCT a AS node, a AS reach FROM nb UNION SELECT cc.node, nb.b FROM cc JOIN nb ON nb.a = cc.reach)
SELECT node, min(reach) AS component FROM cc GROUP BY node""",
}
