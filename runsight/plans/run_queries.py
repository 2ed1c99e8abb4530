"""Queries over logs, health, catalogues and layers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.functions.columns import magnitude
from runsight.operators import catalog as C
from runsight.operators import events as E
from runsight.operators import health as H
from runsight.operators import mesh as M
from runsight.operators import meshcheck as MC
from runsight.plans.registry import query
from runsight.sources import fixtures as fx

@query("monotone_stage", """SELECT event_id, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS stage FROM events""")
def monotone_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.expr("CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END")
    rows = fx.table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("path"), F.lit(0).alias("segment"), F.col("event_id").alias("line_no"))
    return E.monotone_stage(rows, rank).select("event_id", "stage")


@query("dedupe_consecutive", """SELECT event_id, event_type, total FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE k = 1 OR before <> event_type""")
def dedupe_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "events").withColumn("path", F.col("user_id"))
    return E.dedupe_consecutive(rows, "event_type", "event_id").select("event_id", "event_type", "total")


RESIDUALS = "residuals AS (SELECT l_linenumber AS segment, CAST(l_orderkey AS DOUBLE) AS simulation_time, 'U' || lower(substr('XYZ', CAST(l_partkey % 3 AS INT) + 1, 1)) AS field, l_discount AS initial, l_returnflag <> 'R' AS converged FROM lineitem)"
LAST3 = "last3 AS (SELECT *, row_number() OVER (ORDER BY segment DESC, simulation_time DESC) AS back FROM (SELECT DISTINCT segment, simulation_time FROM residuals) ORDER BY segment DESC, simulation_time DESC LIMIT 3), late AS (SELECT residuals.*, back FROM residuals JOIN last3 USING (segment, simulation_time))"


def residual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "lineitem")
    field = F.concat(F.lit("U"), F.lower(F.expr("substr('XYZ', CAST(l_partkey % 3 AS INT) + 1, 1)")))
    return rows.select(F.col("l_linenumber").alias("segment"), F.col("l_orderkey").cast("double").alias("simulation_time"), field.alias("field"), F.col("l_discount").alias("initial"), (F.col("l_returnflag") != "R").alias("converged"))


@query("residual_last_groups", f"WITH {RESIDUALS}, {LAST3} SELECT segment, simulation_time, field, initial, CAST(back AS INT) AS back FROM late")
def residual_last_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.last_groups(residual_rows(spark, sf_dir)).select("segment", "simulation_time", "field", "initial", "back")


TARGETS = [("U", 0.2), ("Ux", 0.01), ("U[yz]", 0.05), ("p", 1.0), ("U(", 1.0)]


@query("target_checks", f"""WITH {RESIDUALS}, {LAST3}, targets AS (SELECT * FROM (VALUES (0, 'U', 'U|Ux|Uy|Uz', 0.2), (1, 'Ux', 'Ux|Uxx|Uxy|Uxz', 0.01), (2, 'U[yz]', 'U[yz]', 0.05), (3, 'p', 'p|px|py|pz', 1.0)) x(pos, pattern, rx, threshold)),
hits AS (SELECT pos, max(initial) AS observed, count(DISTINCT back) AS met FROM targets JOIN late ON regexp_full_match(field, rx) GROUP BY pos)
SELECT pos, pattern, CAST(threshold AS DOUBLE) AS threshold, observed, coalesce(met = 3, false) AS complete, true AS valid, coalesce(met = 3 AND observed <= threshold, false) AS passed FROM targets LEFT JOIN hits USING (pos)
UNION ALL SELECT 4, 'U(', 1.0, NULL, false, false, false""")
def target_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.target_checks(residual_rows(spark, sf_dir), TARGETS)


STEP_ROWS = "steps AS (SELECT 0 AS segment, CAST(o_orderkey AS DOUBLE) AS simulation_time, o_totalprice AS courant_max, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_totalprice / 1e12 END AS continuity_global, o_totalprice / 1e13 AS continuity_local, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_totalprice / 1e11 END AS continuity_cumulative FROM orders)"
UNSOLVED = "bad AS (SELECT DISTINCT CAST(l_orderkey AS DOUBLE) AS simulation_time FROM lineitem WHERE l_returnflag = 'R')"
HEALTH = "health AS (SELECT late.*, courant_max <= 200000 AND continuity_local IS NOT NULL AND continuity_global IS NOT NULL AND continuity_cumulative IS NOT NULL AND bad.simulation_time IS NULL AS healthy FROM (SELECT * FROM steps ORDER BY simulation_time DESC LIMIT 20) late LEFT JOIN bad USING (simulation_time))"
TREND = """seq AS (SELECT row_number() OVER (ORDER BY simulation_time) AS i, count(*) OVER () AS n, abs(continuity_global) AS e FROM health WHERE continuity_global IS NOT NULL),
trend AS (SELECT count(*) AS n, median(e) FILTER (i <= n // 2) AS earlier, median(e) FILTER (i > n // 2) AS later FROM seq)"""


def step_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    price = F.col("o_totalprice")
    steps = fx.table(spark, sf_dir, "orders").select(F.lit(0).alias("segment"), F.col("o_orderkey").cast("double").alias("simulation_time"), price.alias("courant_max"), F.when(F.col("o_custkey") % 5 != 0, price / 1e12).alias("continuity_global"), (price / 1e13).alias("continuity_local"), F.when(F.col("o_custkey") % 11 != 0, price / 1e11).alias("continuity_cumulative"))
    solves = fx.table(spark, sf_dir, "lineitem").select(F.lit(0).alias("segment"), F.col("l_orderkey").cast("double").alias("simulation_time"), (F.col("l_returnflag") != "R").alias("converged"))
    return steps, solves


@query("step_health", f"WITH {STEP_ROWS}, {UNSOLVED}, {HEALTH} SELECT simulation_time, courant_max, healthy FROM health")
def step_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.healthy_steps(*step_rows(spark, sf_dir), 200000.0).select("simulation_time", "courant_max", "healthy")


@query("continuity_trend", f"WITH {STEP_ROWS}, {UNSOLVED}, {HEALTH}, {TREND} SELECT n, round(earlier * 1e12, 4) AS earlier, round(later * 1e12, 4) AS later, coalesce(later > 5 * earlier AND later - earlier > 1e-12, false) AS degraded FROM trend")
def continuity_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = H.continuity_trend(H.healthy_steps(*step_rows(spark, sf_dir), 200000.0).withColumnRenamed("simulation_time", "seq"))
    return trend.withColumns({c: F.round(F.col(c) * 1e12, 4) for c in ("earlier", "later")})


RUN = "CASE WHEN o_orderkey < 2 THEN 99 ELSE o_custkey % 50 END"
RUN_LIMIT = "CASE WHEN run % 10 <> 8 THEN CAST(100000 + run % 5 * 100000 AS DOUBLE) END"


@query("transient_verdict", f"""WITH steps AS (SELECT {RUN} AS run, o_orderkey % 1000 * 1000000000 + o_orderkey AS t, o_totalprice AS c, CASE WHEN o_custkey % 60 > 0 THEN o_totalprice / CASE WHEN o_orderkey % 1000 >= 960 AND o_custkey % 50 % 9 = 4 THEN 1e8 ELSE 1e12 END END AS e FROM orders), runs AS (SELECT DISTINCT run, {RUN_LIMIT} AS lim, CASE WHEN run % 10 = 9 AND run < 90 THEN 'Fatal error' END AS failure FROM steps),
bad AS (SELECT DISTINCT l_orderkey % 1000 * 1000000000 + l_orderkey AS t FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7 AND l_partkey % 9 = 0), late AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY run ORDER BY t DESC) <= 20),
health AS (SELECT late.*, coalesce(c <= lim, false) AND e IS NOT NULL AND bad.t IS NULL AS healthy FROM late JOIN runs USING (run) LEFT JOIN bad USING (t)), of AS (SELECT run, count(*) AS n, 100.0 * count(*) FILTER (healthy) / count(*) AS p, max(c) AS c FROM health GROUP BY run),
seq AS (SELECT run, e, row_number() OVER (PARTITION BY run ORDER BY t) AS i, count(*) OVER (PARTITION BY run) AS m FROM health WHERE e IS NOT NULL), trend AS (SELECT run, median(e) FILTER (i <= m // 2) AS a, median(e) FILTER (i > m // 2) AS b FROM seq GROUP BY run),
all_of AS (SELECT *, coalesce(b > 5 * a AND b - a > 1e-12, false) AS d FROM runs JOIN of USING (run) LEFT JOIN trend USING (run))
SELECT run, n AS n_steps, round(CAST(p AS DOUBLE), 6) AS healthy_percent, c AS courant_max, d AS degraded, CASE WHEN failure IS NOT NULL THEN 'failing' WHEN lim IS NULL THEN 'not_configured' WHEN n < 3 THEN 'insufficient_data' WHEN p < 80 THEN 'failing' WHEN p < 95 OR d THEN 'warning' ELSE 'passing' END AS status FROM all_of""")
def transient_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty runs of the customers' orders, and one of two steps."""
    price = F.col("o_totalprice")
    scale = F.when((F.col("o_orderkey") % 1000 >= 960) & (F.col("o_custkey") % 50 % 9 == 4), 1e8).otherwise(1e12)
    error = F.when(F.col("o_custkey") % 60 > 0, price / scale)

    def time(order: str):
        return F.col(order) % 1000 * 1_000_000_000 + F.col(order)

    steps = fx.table(spark, sf_dir, "orders").select(F.expr(RUN).alias("run"), F.lit(0).alias("segment"), time("o_orderkey").alias("simulation_time"), price.alias("courant_max"), *[error.alias(f"continuity_{c}") for c in ("local", "global", "cumulative")])
    solved = ~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7) & (F.col("l_partkey") % 9 == 0))
    orders = steps.select("run", "segment", "simulation_time")
    solves = fx.table(spark, sf_dir, "lineitem").select(time("l_orderkey").alias("simulation_time"), solved.alias("converged")).join(orders, "simulation_time")
    runs = steps.select("run").distinct().select("run", F.expr(RUN_LIMIT).alias("limit"), F.expr("CASE WHEN run % 10 = 9 AND run < 90 THEN 'Fatal error' END").alias("failure"))
    return H.transient_verdicts(steps, solves, runs).withColumn("healthy_percent", F.round("healthy_percent", 6))


#: Runs by supplier: of one kind all residuals stand in two groups, others have no target, a declared end or a failure.
RUN_KINDS = "l_suppkey % 10 AS kind, CASE WHEN l_suppkey % 10 = 7 THEN 0 ELSE l_linenumber END AS segment, CAST(CASE WHEN l_suppkey % 10 = 7 THEN l_orderkey % 2 ELSE l_orderkey % 7 END AS DOUBLE) AS simulation_time"
RUN_FIELD = "CASE WHEN l_partkey % 2 = 0 THEN 'Ux' ELSE 'Uy' END"
RUN_TARGETS = ((0, "U", 0.1), (1, "U[xy]", 0.08), (2, "U(", 1.0), (4, "p", 1.0), (5, "U", 0.0), (6, "U", 1.0), (7, "U", 1.0), (8, "Ux", 0.1), (8, "Uy", 0.09), (9, "Uy", 0.05))


@query("steady_verdict", f"""WITH r AS (SELECT l_suppkey AS run, {RUN_KINDS}, {RUN_FIELD} AS field, l_discount AS initial FROM lineitem), groups AS (SELECT run, segment, simulation_time, row_number() OVER (PARTITION BY run ORDER BY segment DESC, simulation_time DESC) AS back, count(*) OVER (PARTITION BY run) AS n FROM (SELECT DISTINCT run, segment, simulation_time FROM r)),
late AS (SELECT run, kind, field, back, max(initial) AS most FROM r JOIN groups USING (run, segment, simulation_time) WHERE back <= 3 GROUP BY ALL), targets AS (SELECT * FROM (VALUES {', '.join(f"({k}, {i}, '{p}', {t})" for i, (k, p, t) in enumerate(RUN_TARGETS) if p != 'U(')}) x(kind, pos, pattern, threshold)),
hits AS (SELECT run, pos, max(most) AS observed, count(DISTINCT back) AS met, any_value(threshold) AS threshold FROM late JOIN targets USING (kind) WHERE regexp_full_match(field, CASE pattern WHEN 'U' THEN 'U[xyz]?' ELSE pattern END) GROUP BY run, pos),
met AS (SELECT run, count(*) AS met FROM hits WHERE met = 3 AND observed <= threshold GROUP BY run), runs AS (SELECT run, any_value(kind) AS kind FROM r GROUP BY run), n AS (SELECT run, max(n) AS n FROM groups GROUP BY run), t AS (SELECT kind, count(*) AS targets FROM (SELECT kind FROM targets UNION ALL SELECT 2) GROUP BY kind),
all_of AS (SELECT run, runs.kind, coalesce(targets, 0) AS targets, coalesce(met, 0) AS met, n FROM runs JOIN n USING (run) LEFT JOIN t USING (kind) LEFT JOIN met USING (run))
SELECT run, targets, met, CASE WHEN kind = 6 THEN 'failing' WHEN kind = 5 AND run % 3 > 0 THEN 'passing' WHEN targets = 0 THEN 'not_configured' WHEN n < 3 THEN 'insufficient_data' WHEN met = targets THEN 'passing' ELSE 'failing' END AS status FROM all_of""")
def steady_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS run", *RUN_KINDS.split(", "), f"{RUN_FIELD} AS field", "l_discount AS initial")
    runs = rows.select("run", "kind").distinct()
    targets = spark.createDataFrame([(k, i, p, t) for i, (k, p, t) in enumerate(RUN_TARGETS)], "kind long, pos int, pattern string, threshold double")
    said = runs.select("run", ((F.col("kind") == 5) & (F.col("run") % 3 > 0)).alias("declared"), F.when(F.col("kind") == 6, "Fatal error").alias("failure"))
    return H.steady_verdicts(rows, runs.join(targets, "kind").drop("kind"), said)


# Times that still run: the last group of a log that hasn't ended.
@query("running_excluded", f"WITH {RESIDUALS}, keys AS (SELECT DISTINCT segment, simulation_time FROM residuals), now AS (SELECT * FROM keys ORDER BY segment DESC, simulation_time DESC LIMIT 1), last3 AS (SELECT * FROM keys WHERE (segment, simulation_time) NOT IN (SELECT (segment, simulation_time) FROM now) ORDER BY segment DESC, simulation_time DESC LIMIT 3) SELECT segment, simulation_time, field, initial FROM residuals JOIN last3 USING (segment, simulation_time)")
def running_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = residual_rows(spark, sf_dir)
    now = rows.agg(F.max(F.struct("segment", "simulation_time")).alias("m")).first().m
    current = None if now is None else (F.lit(now.segment), F.lit(now.simulation_time))
    return H.last_groups(rows, current=current, completed=F.lit(False)).select("segment", "simulation_time", "field", "initial")


@query("unhealthy_antijoin", f"WITH {STEP_ROWS}, {UNSOLVED} SELECT simulation_time FROM steps WHERE simulation_time NOT IN (SELECT simulation_time FROM bad)")
def unhealthy_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps without a solve that didn't converge."""
    steps, solves = step_rows(spark, sf_dir)
    return steps.join(solves.where("converged = false"), ["segment", "simulation_time"], "left_anti").select("simulation_time")


@query("health_percent", f"WITH {STEP_ROWS}, {UNSOLVED}, {HEALTH} SELECT count(*) AS n_steps, round(CAST(100.0 * count(*) FILTER (healthy) / count(*) AS DOUBLE), 6) AS healthy_percent FROM health")
def health_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = H.healthy_steps(*step_rows(spark, sf_dir), 200000.0)
    return late.agg(F.count(F.lit(1)).alias("n_steps"), F.round(100.0 * F.count_if("healthy") / F.count(F.lit(1)), 6).alias("healthy_percent"))


@query("progress_eta", """WITH runs AS (SELECT o_orderkey, CAST(o_orderkey % 3 AS DOUBLE) AS a, CAST(o_custkey % 40 AS DOUBLE) AS b, CAST(o_orderkey % 37 AS DOUBLE) AS c, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey % 7 AS DOUBLE) END AS d, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey % 11 AS DOUBLE) END AS e FROM orders),
wall AS (SELECT *, CASE WHEN d > 0 THEN d ELSE e END AS w FROM runs), rated AS (SELECT *, CASE WHEN w > 0 THEN (b - a) / w END AS rate FROM wall)
SELECT o_orderkey, b AS current, CASE WHEN c > a THEN greatest(0, least(1, (b - a) / (c - a))) END AS fraction, rate, CASE WHEN b < c AND rate > 0 THEN (c - b) / rate END AS eta_seconds FROM rated""")
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"start": "o_orderkey % 3", "current": "o_custkey % 40", "end": "o_orderkey % 37", "clock_time": "CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 7 END", "execution_time": "CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 11 END"}
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(e).cast("double").alias(c) for c, e in parts.items()])
    return H.progress(rows).select("o_orderkey", "current", "fraction", "rate", "eta_seconds")


@query("log_score", """SELECT c_custkey, CAST(CASE WHEN c_custkey % 50 = 0 THEN 1000 ELSE 0 END + CASE WHEN c_custkey % 17 = 0 THEN 900 ELSE 0 END + CASE WHEN c_nationkey % 3 = 0 THEN 200 ELSE 0 END + CASE WHEN c_nationkey % 5 = 0 THEN 50 ELSE 0 END + CASE WHEN c_custkey % 4 = 0 THEN 50 ELSE 0 END
 + CASE WHEN c_custkey % 200 <= 120 THEN 25 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE 0 END - CASE WHEN c_mktsegment = 'BUILDING' THEN 300 ELSE 0 END - CASE WHEN c_custkey % 9 = 0 THEN 25 ELSE 0 END AS INT) AS score FROM customer""")
def log_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {
        "explicit": "c_custkey % 50 = 0", "saved": "c_custkey % 17 = 0", "application": "c_nationkey % 3 = 0", "banner": "c_nationkey % 5 = 0", "solver_record": "c_custkey % 4 = 0", "age_seconds": "c_custkey % 200",
        "at_root": "c_custkey % 3 = 0", "workflow": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'utility' ELSE 'solver' END", "size": "c_custkey % 9",
    }
    return C.log_score(fx.table(spark, sf_dir, "customer").select("c_custkey", *[F.expr(e).alias(c) for c, e in parts.items()])).select("c_custkey", "score")


@query("staleness", "SELECT event_type, max(epoch_us(ts)) AS newest, 1706572800 - max(epoch_us(ts)) / 1e6 > 3600 AS stale FROM events GROUP BY event_type")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("newest"))
    return newest.withColumn("stale", C.stale(F.col("newest") * 1000, F.lit(1706572800.0), F.lit(3600.0)))


@query("notice_topk", """WITH once AS (SELECT lang AS c, CASE WHEN doc_id % 9 = 0 THEN 'error' ELSE 'info' END AS severity, CASE WHEN source = 'src0' THEN 'solver_log' ELSE source END AS source, min(doc_id) AS seq FROM documents GROUP BY ALL),
ranked AS (SELECT *, count(*) OVER (PARTITION BY c) AS total, row_number() OVER (PARTITION BY c ORDER BY CASE WHEN severity = 'error' THEN 0 ELSE 1 END, CASE WHEN source = 'solver_log' THEN 1 ELSE 0 END, seq DESC) AS k FROM once)
SELECT c AS "case", seq, severity, source, total FROM ranked WHERE k <= 20""")
def notice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    severity, source = F.when(F.col("doc_id") % 9 == 0, "error").otherwise("info"), F.when(F.col("source") == "src0", "solver_log").otherwise(F.col("source"))
    notices = docs.select(F.col("lang").alias("case"), F.col("doc_id").alias("seq"), severity.alias("severity"), source.alias("source"), F.lit("").alias("message"))
    return C.bounded_notices(notices, 20).drop("message")


@query("output_retention", """WITH l AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS k FROM documents), i AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS k FROM documents WHERE n_chars > 3000)
SELECT lang AS "case", doc_id AS seq FROM l WHERE k <= 10 OR doc_id IN (SELECT doc_id FROM i WHERE k <= 10)""")
def output_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("case"), F.col("doc_id").alias("seq"), "n_chars")
    return C.retained_output(lines, F.col("n_chars") > 3000, 10).select("case", "seq")


@query("signature", "SELECT CAST(page_id % 7 AS BIGINT) AS \"case\", max(page_id) AS newest_ns, CAST(sum(strlen(html)) AS BIGINT) AS bytes, count(*) AS files FROM pages GROUP BY ALL")
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("case"), F.col("page_id").alias("modified_ns"), F.octet_length("html").cast("long").alias("size"))
    return C.signature(pages)


@query("candidate_score", """WITH s AS (SELECT p_partkey, lower(p_type || ' ' || p_brand || ' ' || p_name || ' ') AS text, p_size AS n, p_partkey % 3 = 0 AS constant, p_partkey % 4 = 0 AS stale FROM (SELECT p_partkey, p_size, p_type, CASE p_partkey % 5 WHEN 0 THEN 'wallFlux' WHEN 1 THEN 'fieldAverage' WHEN 2 THEN 'probes' WHEN 3 THEN 'solverInfo flow' ELSE 'x' END AS p_brand, p_name FROM part)),
scored AS (SELECT p_partkey, CASE WHEN regexp_matches(text, 'force|flow|flux|pressure_?difference|power') THEN 80 WHEN regexp_matches(text, 'average|integral|heattransfer|species|phase|interface') THEN 70 WHEN contains(text, 'probe') THEN 60 ELSE 0 END + CASE WHEN n >= 50 THEN 20 WHEN n >= 20 THEN 10 ELSE 0 END
  - CASE WHEN regexp_matches(text, 'solverinfo|executiontime|clocktime|courant|diagnostic') THEN 60 ELSE 0 END - CASE WHEN n >= 20 AND constant THEN 20 ELSE 0 END - CASE WHEN stale THEN 20 ELSE 0 END AS score FROM s)
SELECT p_partkey, CAST(score AS INT) AS score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS confidence, score >= 70 AS recommended FROM scored""")
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'wallFlux' WHEN 1 THEN 'fieldAverage' WHEN 2 THEN 'probes' WHEN 3 THEN 'solverInfo flow' ELSE 'x' END")
    part = fx.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("function_name"), kind.alias("function_type"), F.col("p_name").alias("field"), F.lit(None).cast("string").alias("operation"), F.col("p_size").alias("n"), (F.col("p_partkey") % 3 == 0).alias("constant"), (F.col("p_partkey") % 4 == 0).alias("stale"))
    return C.candidate_score(part).select("p_partkey", "score", "confidence", "recommended")


@query("log_rank", """SELECT c_nationkey AS "case", c_custkey AS path, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 50 = 0 THEN 0 WHEN c_custkey % 17 = 0 THEN 1 ELSE 2 END, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END, CAST(round(c_acctbal * 100) AS BIGINT) DESC, c_custkey) AS INT) AS rank FROM customer""")
def log_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = fx.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("case"), F.col("c_custkey").alias("path"), (F.col("c_custkey") % 50 == 0).alias("explicit"), (F.col("c_custkey") % 17 == 0).alias("saved"), F.when(F.col("c_mktsegment") == "BUILDING", "unknown").otherwise("solver").alias("workflow"), fx.cents("c_acctbal").alias("modified_ns"))
    return C.ranked_logs(logs).select("case", "path", "rank")


REQUESTS = [("BUILDING", 3), ("HOUSE.*", 2), ("MACHINERY", 0), ("(bad", 1), (".*", 4)]


@query("layer_match", """WITH r AS (SELECT c_custkey, c_mktsegment AS patch FROM customer) SELECT c_custkey, patch, CASE WHEN patch IN ('BUILDING', 'MACHINERY') THEN patch WHEN patch LIKE 'HOUSE%' THEN 'HOUSE.*' ELSE '.*' END AS selector,
CAST(CASE WHEN patch = 'BUILDING' THEN 3 WHEN patch = 'MACHINERY' THEN 0 WHEN patch LIKE 'HOUSE%' THEN 2 ELSE 4 END AS INT) AS requested_layers FROM r""")
def layer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("patch"))
    return M.match_layers(rows, REQUESTS)


LAYER_REQUESTS = [("BUILDING", 3), ("HOUSE.*", 2), ("MACHINERY", 0), ("AUTO.*", 1)]
PATCH = "CASE WHEN c_nationkey % 3 = 0 AND c_mktsegment = 'FURNITURE' THEN 'MACHINERY' WHEN c_nationkey % 5 = 4 AND c_mktsegment = 'HOUSEHOLD' THEN 'BUILDING' ELSE c_mktsegment END"
AVERAGE = "CASE WHEN c_nationkey % 6 < 2 AND c_custkey % 50 = 0 THEN c_nationkey % 2 ELSE 3 + c_custkey % 2 END"
#: Log lines of a table of each nation's customers: closed by another line, not closed, or by a row that is cut off.
TABLE_LINE = {0: "patch faces layers overall thickness", 1: "-----  -----"}


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = fx.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.expr(PATCH).alias("patch"), F.expr(AVERAGE).alias("average"))
    row = F.concat(F.lit("  "), "patch", F.lit("   "), F.col("c_custkey").cast("string"), F.lit(" "), F.col("average").cast("string"), F.lit(" 0.5 90 "))
    rows = customers.select(F.col("c_nationkey").alias("path"), (F.col("c_custkey") + 10).alias("line_no"), row.alias("line"))
    k = F.col("n_nationkey") % 4
    end = F.when(k == 0, "Layer mesh : cells:3").when(k == 2, "inlet 4 1").when(k == 3, "")
    frame = F.array(*[F.struct(F.lit(n).cast("long").alias("line_no"), F.lit(x).alias("line")) for n, x in TABLE_LINE.items()], F.struct(F.lit(1 << 60).alias("line_no"), end.alias("line")), F.struct(F.lit((1 << 60) + 1).alias("line_no"), F.when(k == 3, "End").alias("line")))
    frames = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("path"), F.inline(frame)).where("line IS NOT NULL")
    return rows.unionByName(frames)


@query("layer_table", f"SELECT c_nationkey AS path, c_custkey + 10 AS line_no, {PATCH} AS patch, CAST(c_custkey AS INT) AS faces, CAST({AVERAGE} AS DOUBLE) AS average_layers, 0.5 AS thickness, CAST(90 AS DOUBLE) AS percent FROM customer WHERE c_nationkey % 4 IN (0, 3)".replace("0.5 AS", "CAST(0.5 AS DOUBLE) AS"))
def layer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MC.layer_table(table_lines(spark, sf_dir))


@query("layer_coverage", f"""WITH r AS (SELECT c_nationkey AS path, {PATCH} AS patch, {AVERAGE} AS a FROM customer WHERE c_nationkey % 4 IN (0, 3)),
s AS (SELECT path, patch, CASE WHEN patch = 'FURNITURE' THEN 'unknown' WHEN patch = 'MACHINERY' THEN 'not_requested' WHEN a <= 0 THEN 'missing' WHEN a < CASE patch WHEN 'BUILDING' THEN 3 WHEN 'HOUSEHOLD' THEN 2 ELSE 1 END THEN 'partial' ELSE 'met' END AS st FROM r),
c AS (SELECT path, count(*) AS n, count(*) FILTER (st = 'missing') AS missing, count(*) FILTER (st = 'partial') AS partial, count(*) FILTER (st = 'unknown') AS loose, bool_or(patch = 'BUILDING') AS b, bool_or(patch = 'HOUSEHOLD') AS h, bool_or(patch = 'AUTOMOBILE') AS u FROM s GROUP BY path),
j AS (SELECT n_nationkey AS path, coalesce(n, 0) AS n, coalesce(missing, 0) AS missing, coalesce(partial, 0) AS partial, coalesce(loose, 0) AS loose, concat_ws(' ', CASE WHEN NOT coalesce(b, false) THEN 'BUILDING' END, CASE WHEN NOT coalesce(h, false) THEN 'HOUSE.*' END, CASE WHEN NOT coalesce(u, false) THEN 'AUTO.*' END) AS unmatched FROM nation LEFT JOIN c ON path = n_nationkey)
SELECT path, n AS rows, missing, partial, unmatched, CASE WHEN n = 0 AND path % 8 = 1 THEN 'not_configured' WHEN n = 0 THEN 'unavailable' WHEN missing > 0 THEN 'missing' WHEN partial > 0 THEN 'partial' WHEN unmatched <> '' OR loose > 0 THEN 'unknown' ELSE 'met' END AS status FROM j""")
def layer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables found in the lines, against the requests; layers are switched off for some nations."""
    cases = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("path"), (F.col("n_nationkey") % 8 != 1).alias("add_layers"))
    return M.layer_coverage(MC.layer_table(table_lines(spark, sf_dir)), LAYER_REQUESTS, cases).withColumn("unmatched", F.array_join("unmatched", " "))


@query("vector_magnitude", "SELECT vec_id, round(sqrt(CAST(embedding[1] AS DOUBLE) ** 2 + CAST(embedding[2] AS DOUBLE) ** 2 + CAST(embedding[3] AS DOUBLE) ** 2), 9) AS magnitude FROM embeddings")
def vector_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = (F.element_at("embedding", i).cast("double") for i in (1, 2, 3))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.round(magnitude(x, y, z), 9).alias("magnitude"))


COMPONENTS = ["xx", "xy", "xz", "yx", "yy", "yz", "zx", "zy", "zz"]


@query("descriptor_explode", "SELECT vec_id, ['xx', 'xy', 'xz', 'yx', 'yy', 'yz', 'zx', 'zy', 'zz'][k] AS component, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 10) x(k)")
def descriptor_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array(*[F.struct(F.lit(c).alias("component"), F.element_at("embedding", i + 1).cast("double").alias("v")) for i, c in enumerate(COMPONENTS)])
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.inline(named))


@query("props_value", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def props_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
