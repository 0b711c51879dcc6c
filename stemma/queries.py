"""Queries over the driver's tables, one or more for each family of operators, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import names, numbers
from .functions import text as tx
from .operators import graph, ordered, relational, spatial
from .plans import competency, explorer, knowledge, reports, sparql
from .streaming import windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- the competency queries, on views of the driver's tables ----------------------------------------

_CATEGORY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'CR' WHEN '2-HIGH' THEN 'EN' WHEN '3-MEDIUM' THEN 'VU' ELSE 'LC' END"
_SCHEME = "CASE o_orderstatus WHEN 'F' THEN 'DLDVN' WHEN 'O' THEN 'SDVN' ELSE 'IUCN' END"
_LABEL = "CASE event_type WHEN 'view' THEN 'Chl-a (ug/L)' WHEN 'error' THEN 'Photphat (mgP-PO4/L)' WHEN 'purchase' THEN 'Amoni (mgN-NH4/L)' ELSE 'Độ trong (cm)' END"
_FLAG = "CASE WHEN l_quantity >= 49 THEN 'x#InvasiveAlienSpecies' WHEN l_quantity <= 1 THEN 'x#AlienSpecies' ELSE 'x#EconomicValue' END"
_ISSUE = "CASE WHEN l_returnflag = 'R' THEN 'x#returned' WHEN l_discount > 0.08 THEN 'x#discounted' ELSE 'x#open' END"


def views(spark: SparkSession, d: str) -> knowledge.Views:
    """Line items as usages of parts in the customer's region, by suppliers grouped by nation; orders as assessments; events as observations."""
    t = lambda name: table(spark, d, name)
    regions = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_regionkey")
    buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(regions, "c_nationkey").select(F.col("o_orderkey").alias("l_orderkey"), "r_regionkey")
    items = t("lineitem").selectExpr("*", "l_orderkey * 10 + l_linenumber AS u")
    usage = items.join(buyers, "l_orderkey").select(
        "u", F.col("l_partkey").alias("taxon"), F.col("r_regionkey").alias("waterbody"), F.concat(F.lit("source/"), F.col("l_suppkey").cast("string")).alias("source"), (F.col("l_returnflag") == "R").alias("morpho")
    )
    orders = t("orders").selectExpr("o_orderkey AS a", f"{_SCHEME} AS scheme", "CAST(year(o_orderdate) AS STRING) AS version", f"{_CATEGORY} AS category", "concat('source/', o_custkey % 3) AS source")
    assessed = items.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("taxon"))
    events = t("events")
    return knowledge.Views(
        usage=usage,
        taxon_name=t("part").select(F.col("p_partkey").alias("taxon"), F.col("p_name").alias("name")),
        accepted=t("part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("taxon"), F.col("p_type").alias("accepted")),
        waterbody=t("region").select(F.col("r_regionkey").alias("waterbody"), F.col("r_name").alias("label")),
        source_group=t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("source/"), F.col("s_suppkey").cast("string")).alias("source"), F.col("n_name").alias("group")),
        assessment=assessed.join(orders, "a"),
        usage_assessment=items.select("u", F.col("l_orderkey").alias("a")),
        trait=items.selectExpr("u AS subject", f"{_FLAG} AS trait"),
        issue=items.selectExpr("u", f"{_ISSUE} AS issue"),
        abundance=events.selectExpr("event_id AS o", "user_id AS taxon", "user_id AS site", "user_id AS code", "CAST(CAST(ts AS DATE) AS STRING) AS time", "value", "event_type AS `group`"),
        water=events.where("event_type <> 'click'").selectExpr("user_id AS site", "CAST(CAST(ts AS DATE) AS STRING) AS time", f"{_LABEL} AS label", "value"),
    )


_VIEWS = f"""
WITH buyers AS (SELECT o_orderkey, n_regionkey AS waterbody FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
items AS (SELECT *, l_orderkey * 10 + l_linenumber AS u FROM lineitem),
usage AS (SELECT u, l_partkey AS taxon, waterbody, 'source/' || l_suppkey AS source, l_returnflag = 'R' AS morpho FROM items JOIN buyers ON l_orderkey = o_orderkey),
named AS (SELECT p_partkey AS taxon, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END AS name FROM part),
grouped AS (SELECT 'source/' || s_suppkey AS source, n_name AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey),
reconciled AS (SELECT u, r_name AS waterbody, grp, name FROM usage JOIN named USING (taxon) JOIN grouped USING (source) JOIN region ON usage.waterbody = r_regionkey WHERE NOT morpho),
assessment AS (SELECT o_orderkey AS a, {_SCHEME} AS scheme, CAST(year(o_orderdate) AS VARCHAR) AS version, {_CATEGORY} AS category, 'source/' || (o_custkey % 3) AS source FROM orders),
trait AS (SELECT u AS subject, {_FLAG} AS trait FROM items),
issue AS (SELECT u, {_ISSUE} AS issue FROM items),
abundance AS (SELECT event_id AS o, user_id AS taxon, user_id AS site, CAST(CAST(ts AS DATE) AS VARCHAR) AS time, value, event_type AS grp FROM events),
water AS (SELECT user_id AS site, CAST(CAST(ts AS DATE) AS VARCHAR) AS time, {_LABEL} AS label, value FROM events WHERE event_type <> 'click')
"""


@query(_VIEWS + 'SELECT waterbody, grp AS "group", count(DISTINCT u) AS records, count(DISTINCT name) AS distinct_accepted_names FROM reconciled GROUP BY ALL')
def cq1_richness(spark, d):
    return competency.richness(views(spark, d))


@query(
    _VIEWS
    + """, s AS (SELECT DISTINCT grp, waterbody, name FROM reconciled)
SELECT a.grp AS "group", a.waterbody AS wb1, b.waterbody AS wb2, count(*) AS shared, string_agg(name, '; ' ORDER BY name) AS species FROM s a JOIN s b USING (grp, name) WHERE a.waterbody < b.waterbody GROUP BY ALL"""
)
def cq2_shared(spark, d):
    return competency.shared_species(views(spark, d))


@query(
    _VIEWS
    + """SELECT p_name AS name, r_name AS waterbody, string_agg(DISTINCT scheme || '-' || version || ':' || category, ', ' ORDER BY scheme || '-' || version || ':' || category) AS assessments,
  string_agg(DISTINCT replace(x.source, 'source/', ''), ',' ORDER BY replace(x.source, 'source/', '')) AS sources
FROM items JOIN assessment x ON l_orderkey = a JOIN usage USING (u) JOIN part ON taxon = p_partkey JOIN region ON waterbody = r_regionkey WHERE category IN ('CR', 'EN', 'VU') GROUP BY ALL"""
)
def cq3_threatened(spark, d):
    return competency.threatened(views(spark, d))


@query(
    _VIEWS
    + """, f AS (SELECT DISTINCT usage.taxon, split_part(trait, '#', 2) AS flag FROM trait JOIN usage ON u = subject WHERE trait IN ('x#InvasiveAlienSpecies', 'x#AlienSpecies'))
SELECT p_name AS name, flag, string_agg(DISTINCT r_name, ', ' ORDER BY r_name) AS waterbodies,
  string_agg(DISTINCT replace(source, 'source/', ''), ',' ORDER BY replace(source, 'source/', '')) AS recorded_in_sources
FROM f JOIN usage USING (taxon) JOIN part ON taxon = p_partkey JOIN region ON waterbody = r_regionkey GROUP BY ALL"""
)
def cq4_alien_spread(spark, d):
    return competency.alien_spread(views(spark, d))


@query(
    _VIEWS
    + """, seen AS (SELECT p_name AS name, time, site, value AS density FROM abundance JOIN part ON taxon = p_partkey WHERE taxon IN (SELECT l_partkey FROM items WHERE l_quantity > 48))
SELECT name, time, site, density, c.value AS chla, p.value AS po4, n.value AS nh4, t.value AS transparency FROM seen
  LEFT JOIN water c USING (site, time) """.replace("USING (site, time)", "ON c.site = seen.site AND c.time = seen.time AND c.label = 'Chl-a (ug/L)'").replace("name, time, site, density", "seen.name, seen.time, seen.site, density", 1)
    + """LEFT JOIN water p ON p.site = seen.site AND p.time = seen.time AND p.label = 'Photphat (mgP-PO4/L)'
  LEFT JOIN water n ON n.site = seen.site AND n.time = seen.time AND n.label = 'Amoni (mgN-NH4/L)'
  LEFT JOIN water t ON t.site = seen.site AND t.time = seen.time AND t.label = 'Độ trong (cm)'
ORDER BY density DESC, name, time, site, chla NULLS FIRST, po4 NULLS FIRST, nh4 NULLS FIRST, transparency NULLS FIRST LIMIT 15"""
)
def cq5_toxic(spark, d):
    v = views(spark, d)
    heavy = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("subject"), F.lit("x#ToxicCyanobacterium").alias("trait")).distinct()
    v.trait = heavy
    return competency.toxic_densities(v)


@query(_VIEWS + "SELECT replace(source, 'source/', '') AS source, split_part(issue, '#', 2) AS issue_type, count(DISTINCT u) AS n FROM issue JOIN usage USING (u) GROUP BY ALL")
def cq6_curation(spark, d):
    return competency.curation_queue(views(spark, d))


@query(
    _VIEWS
    + """, x AS (SELECT l_partkey AS taxon, CASE WHEN scheme IN ('DLDVN', 'SDVN') THEN 'VN_RedList' ELSE scheme END AS family_scheme, category, replace(source, 'source/', '') || '=' || scheme || '-' || version || ':' || category AS said
  FROM items JOIN assessment ON l_orderkey = a),
k AS (SELECT taxon, family_scheme FROM x GROUP BY ALL HAVING count(DISTINCT category) > 1)
SELECT p_name AS name, family_scheme, string_agg(DISTINCT said, ' | ' ORDER BY said) AS assessments FROM x JOIN k USING (taxon, family_scheme) JOIN part ON taxon = p_partkey GROUP BY ALL"""
)
def cq7_conflicts(spark, d):
    return competency.assessment_conflicts(views(spark, d))


@query(
    _VIEWS
    + """SELECT p_name AS name FROM (SELECT u, taxon FROM usage WHERE NOT morpho AND source = 'source/3') JOIN part ON taxon = p_partkey
WHERE NOT EXISTS (SELECT 1 FROM abundance WHERE abundance.taxon = p_partkey AND grp = 'click')"""
)
def cq8_not_in_matrix(spark, d):
    return competency.not_in_matrix(views(spark, d), "source/3", "click")


# -- joins --------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, user_id, d.day, avg(c.value) AS click FROM (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day FROM events) d
LEFT JOIN (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, value FROM events WHERE event_type = 'click') c USING (user_id, day) GROUP BY event_id, user_id, d.day"""
)
def join_optional(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    clicks = rows.where("event_type = 'click'").groupBy("user_id", "day").agg(F.avg("value").alias("click"))
    return rows.select("event_id", "user_id", "day").join(clicks, ["user_id", "day"], "left")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_not_exists(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(items, "o_orderkey", "left_anti")


@query("SELECT l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN (SELECT l_partkey, l_linestatus FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1) USING (l_partkey, l_linestatus) GROUP BY ALL")
def join_conflicting(spark, d):
    rows = relational.conflicting(table(spark, d, "lineitem"), ["l_partkey", "l_linestatus"], "l_returnflag")
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"))


@query(
    """SELECT o_orderkey, coalesce(b.l_partkey, 0) AS part, coalesce(b.l_suppkey, -1) AS supplier FROM orders LEFT JOIN
(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1) b ON l_orderkey = o_orderkey"""
)
def join_first_match(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.lit(0).cast("long").alias("part"), F.lit(-1).cast("long").alias("supplier"))
    # Line numbers repeat within orders; of rows with one number the first in the table counts, by file and place in it.
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    best = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "l_linenumber", *place)
    return relational.look_up_first(rows, best, "o_orderkey", ["l_linenumber", "file", "at"], ["part", "supplier"])


@query(
    """SELECT p_partkey, (SELECT CASE WHEN min(abs(x - p_size)) <= 4.5 THEN arg_min(name, struct_pack(a := abs(x - p_size), b := ord)) END
  FROM (VALUES (5.0, 'A', 1), (15.0, 'B', 2), (25.0, 'C', 3), (40.0, 'D', 4)) t(x, name, ord)) AS nearest FROM part"""
)
def join_nearest_column(spark, d):
    columns = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(n).alias("name")) for x, n in ((5.0, "A"), (15.0, "B"), (25.0, "C"), (40.0, "D"))))
    return table(spark, d, "part").select("p_partkey", relational.nearest_column(F.col("p_size").cast("double"), columns).alias("nearest"))


_POINTS = "SELECT s_suppkey AS key, s_nationkey AS grp, 13 + (s_suppkey * 37 % 101) * 0.0004 AS lat, 108 + (s_suppkey * 53 % 97) * 0.0004 AS lon FROM supplier"


def _points(spark, d):
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(s.alias("key"), F.col("s_nationkey").alias("grp"), (13 + (s * 37 % 101) * 0.0004).alias("lat"), (108 + (s * 53 % 97) * 0.0004).alias("lon"))


@query(
    f"""WITH p AS ({_POINTS}), x AS (SELECT a.grp AS "group", a.key AS a, b.key AS b,
  2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS m FROM p a JOIN p b ON a.grp = b.grp AND a.key < b.key)
SELECT "group", a, b, round(m, 3) AS metres FROM x WHERE m < 2000"""
)
def join_distance(spark, d):
    return spatial.close_pairs(_points(spark, d), "grp", "key", 2000.0).withColumn("metres", F.round("metres", 3))


@query()
def cluster_first_fit(spark, d):
    """Greedy clusters depend on the order of points; tested against a fold over all points."""
    points = _points(spark, d).withColumnRenamed("key", "_order")
    return spatial.numbered_clusters(spatial.first_fit_clusters(points, "grp", "_order", 2000.0)).select(F.col("_order").alias("key"), "grp", "site_uid")


@query(
    """WITH l AS (SELECT DISTINCT p_size, p_type AS word FROM part), x AS (SELECT p_partkey, p_size, '^' || lower(left(p_type, 3)) || '.*' || lower(right(p_type, 2)) || '$' AS pattern FROM part)
SELECT p_partkey, (SELECT CASE WHEN count(*) = 1 THEN max(word) END FROM l WHERE l.p_size = x.p_size AND regexp_matches(lower(word), pattern)) AS repaired FROM x"""
)
def join_lexicon(spark, d):
    part = table(spark, d, "part")
    damaged = part.select("p_partkey", "p_size", F.concat(F.lit("^"), F.lower(F.substring("p_type", 1, 3)), F.lit(".*"), F.lower(F.right("p_type", F.lit(2))), F.lit("$")).alias("pattern"))
    return relational.repaired_by_lexicon(damaged, part, "p_size", "pattern", "p_type").select("p_partkey", "repaired")


@query(
    """WITH c AS (SELECT c_nationkey, 1 + c_custkey % 12 AS slot, count(*) AS n FROM customer GROUP BY ALL)
SELECT n_nationkey AS c_nationkey, slot::INT AS slot, coalesce(n, 0) AS n FROM nation, (SELECT unnest(generate_series(1, 10)) AS slot) s LEFT JOIN c ON c.c_nationkey = n_nationkey AND c.slot = s.slot""".replace("slot::INT", "s.slot::INT")
)
def join_densified(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    cells = table(spark, d, "customer").groupBy("c_nationkey", (1 + F.col("c_custkey") % 12).cast("int").alias("slot")).agg(F.count("*").alias("v"))
    out = relational.densified(nations, ["c_nationkey"], nations.withColumn("n", F.lit(10)), cells, "slot", "v", 0)
    return out.select("c_nationkey", "slot", F.col("v").alias("n"))


@query("SELECT source, sum(n)::BIGINT AS n FROM (SELECT source, 1 AS n FROM documents UNION ALL SELECT 'alias', 1 FROM documents WHERE source = 'src1') GROUP BY source")
def join_aliased(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id")
    return relational.with_aliases(rows, "source", {"alias": "src1"}).groupBy("source").agg(F.count("*").alias("n"))


# -- aggregations ---------------------------------------------------------------------------------------


@query("PIVOT (SELECT o_orderstatus, o_orderpriority FROM orders) ON o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') USING count(*) GROUP BY o_orderstatus")
def agg_pivot(spark, d):
    values = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", values).count().na.fill(0)


@query("SELECT event_type, k AS key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
def agg_map_keys(spark, d):
    rows = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return relational.key_counts(rows, ["event_type"], "m")


@query(
    """SELECT o_custkey, string_agg(o_orderstatus || '=' || o_orderpriority, ',' ORDER BY o_orderstatus) AS entries
FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) = 1) GROUP BY o_custkey"""
)
def agg_last_value_map(spark, d):
    out = relational.last_values(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "o_orderpriority", "o_orderkey")
    return out.select("o_custkey", F.array_join(F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("entries"))


@query(
    """WITH c AS (SELECT count_if(quality = 1) AS n_pred, count_if(toxic = 1) AS n_gold, count_if(quality = 1 AND toxic = 1) AS tp FROM labels)
SELECT 'labels' AS kind, n_pred::BIGINT AS n_pred, n_gold::BIGINT AS n_gold, tp::BIGINT AS tp, round_even(tp / n_pred, 3) AS P, round_even(tp / n_gold, 3) AS R,
  round_even(2 * (tp / n_pred) * (tp / n_gold) / (tp / n_pred + tp / n_gold), 3) AS F1 FROM c"""
)
def agg_scores(spark, d):
    rows = table(spark, d, "labels").select(F.lit("labels").alias("kind"), (F.col("quality") == 1).alias("p"), (F.col("toxic") == 1).alias("g"))
    return relational.scores(rows, ["kind"], "p", "g")


@query(
    """WITH s AS (SELECT DISTINCT l_returnflag AS k, l_partkey AS x FROM lineitem), n AS (SELECT k, count(*) AS n FROM s GROUP BY k)
SELECT a.k AS a, b.k AS b, count(*) AS shared, round_even(2 * count(*) / (any_value(na.n) + any_value(nb.n)), 3) AS sorensen
FROM s a JOIN s b ON a.x = b.x AND a.k < b.k JOIN n na ON na.k = a.k JOIN n nb ON nb.k = b.k GROUP BY ALL"""
)
def agg_sorensen(spark, d):
    sets = table(spark, d, "lineitem").select(F.lit(1).alias("g"), "l_returnflag", "l_partkey").distinct()
    sizes = sets.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    pairs = relational.shared_pairs(sets.withColumn("l_partkey", F.col("l_partkey").cast("string")), "g", "l_returnflag", "l_partkey")
    out = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return out.select("a", "b", "shared", relational.sorensen(F.col("shared"), F.col("na"), F.col("nb")).alias("sorensen"))


@query(
    """WITH a AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber) AS x, list(CASE WHEN l_quantity > 25 THEN 'R' ELSE 'N' END ORDER BY l_linenumber) AS y FROM lineitem GROUP BY ALL)
SELECT l_orderkey, len(list_filter(list_zip(x, y), lambda p: p[1] = p[2]))::INT AS matched FROM a"""
)
def agg_matched_positions(spark, d):
    guess = F.when(F.col("l_quantity") > 25, "R").otherwise("N")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("x"), guess.alias("y")))).alias("r"))
    return rows.select("l_orderkey", relational.matched_positions(F.col("r.x"), F.col("r.y")).alias("matched"))


@query("SELECT c_mktsegment, count(*) AS n, count(DISTINCT lower(c_name)) AS names, count(DISTINCT c_nationkey) FILTER (c_acctbal > 0) AS in_credit, count(DISTINCT c_nationkey) > 20 AS wide FROM customer GROUP BY ALL")
def agg_counts(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.count_distinct(F.lower("c_name")).alias("names"), F.count_distinct(F.when(F.col("c_acctbal") > 0, F.col("c_nationkey"))).alias("in_credit"), (F.count_distinct("c_nationkey") > 20).alias("wide")
    )


# -- ordered rows -----------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS k, md5(text) AS h FROM conversations)
SELECT conv_id, turn, """
    + ", ".join(
        f"(SELECT CASE WHEN b.k = {i} THEN b.h END FROM r b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND b.k <= {i} ORDER BY b.turn DESC LIMIT 1) AS {n}"
        for i, n in enumerate(("system", "user", "assistant"), 1)
    )
    + " FROM r a"
)
def ordered_hierarchy(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("h"))
    return ordered.hierarchy_fill(rows, ["conv_id"], "turn", "role", "h", ["system", "user", "assistant"]).select("conv_id", "turn", "system", "user", "assistant")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS caption FROM conversations")
def ordered_running_last(spark, d):
    rows = table(spark, d, "conversations").withColumn("said", F.when(F.col("role") == "user", F.md5("text")))
    return ordered.running_last(rows, ["conv_id"], "turn", "said", "caption").select("conv_id", "turn", "caption")


@query(
    """WITH e AS (SELECT user_id, event_id, value > 50 AS f, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)
SELECT user_id, event_id, count_if(f) OVER (PARTITION BY user_id, g ORDER BY event_id)::BIGINT AS run FROM e"""
)
def ordered_run_lengths(spark, d):
    rows = table(spark, d, "events").withColumn("f", F.col("value") > 50)
    return ordered.run_lengths(rows, ["user_id"], "event_id", "f", "run").select("user_id", "event_id", "run")


@query("SELECT conv_id, turn, CASE WHEN lead(turn) OVER w - turn <= 2 THEN lead(role) OVER w END AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def ordered_lookahead(spark, d):
    return ordered.following(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "following", 2).select("conv_id", "turn", "following")


@query(
    """WITH c AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS b FROM conversations GROUP BY conv_id), x AS (SELECT t.* FROM conversations t JOIN c USING (conv_id) WHERE turn > b),
e AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS e FROM x GROUP BY conv_id)
SELECT conv_id, turn FROM x JOIN e USING (conv_id) WHERE e IS NULL OR turn < e"""
)
def ordered_region(spark, d):
    user = F.col("role") == "user"
    return ordered.between_captions(table(spark, d, "conversations"), ["conv_id"], "turn", user, user).select("conv_id", "turn")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders")
def ordered_row_numbers(spark, d):
    return ordered.numbered(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], "n").select("o_orderkey", "n")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem QUALIFY rank <= 8")
def top_per_key(spark, d):
    out = relational.top_per_group(table(spark, d, "lineitem"), ["l_partkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 8)
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15")
def top_overall(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(15)


@query("SELECT text_md5, min(doc_id) AS doc_id FROM (SELECT doc_id, md5(text) AS text_md5 FROM documents) GROUP BY text_md5")
def keep_first_copy(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return relational.keep_first(rows, ["text_md5"], ["doc_id"]).select("text_md5", "doc_id")


# -- sets ---------------------------------------------------------------------------------------------------


@query(
    """SELECT 'both' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'only', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'any', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"""
)
def set_operations(spark, d):
    of = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select("l_partkey")
    a, r = of("A"), of("R")
    n = lambda kind, rows: rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("both", a.intersect(r)).unionByName(n("only", a.subtract(r))).unionByName(n("any", a.union(r).distinct()))


# -- functions ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def fn_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded"))


@query("SELECT doc_id, md5(trim(regexp_replace(translate(strip_accents(text), 'đĐ', 'dD'), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS slug FROM documents")
def fn_slug(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.slug(F.col("text"))).alias("slug"))


@query()
def fn_glyph_repair(spark, d):
    """Every text with some letters swapped for glyphs and repaired; look-around isn't in the other engine, so it is tested on its own."""
    damaged = F.translate("text", "áâ", "|}")
    return table(spark, d, "documents").select("doc_id", F.md5(tx.repair_glyphs(damaged)).alias("repaired"), tx.glyph_repairs(damaged).alias("n"))


@query()
def fn_parse_names(spark, d):
    """Part names parsed as scientific names; tested on names with known parts."""
    return table(spark, d, "part").select("p_partkey", names.parse(F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.substring(F.col("p_name"), F.lit(2), F.length("p_name"))))).alias("n")).select("p_partkey", "n.*").withColumn("notes", F.array_join("notes", ";"))


@query()
def fn_binomials(spark, d):
    """Binomials in each document."""
    return table(spark, d, "documents").select("doc_id", F.array_join(names.binomials(F.col("text")), "; ").alias("binomials"))


@query()
def fn_similarity(spark, d):
    """Ratcliff-Obershelp similarity of part names and types; the other engine has none."""
    return table(spark, d, "part").select("p_partkey", names.similarity(F.col("p_name"), F.col("p_type")).alias("ratio"))


@query("SELECT url, page_id, CASE WHEN instr(url, 'example') > 0 THEN substr(url, instr(url, 'example') + 7) ELSE '' END AS rest, list_last(string_split(url, '/')) AS tail FROM pages")
def fn_iri_parts(spark, d):
    return table(spark, d, "pages").select("url", "page_id", tx.str_after(F.col("url"), "example").alias("rest"), tx.iri_tail(F.col("url")).alias("tail"))


@query(
    """SELECT p_partkey, round_even(p_retailprice / 1000, 3) AS rounded, CASE WHEN p_size % 4 = 0 THEN -1.0 WHEN p_size % 4 = 1 THEN NULL WHEN p_size % 4 = 2 THEN p_size * 1000.0 ELSE p_size + 0.5 END AS cell,
  CASE WHEN p_size % 2 = 0 THEN p_size + 0.25 END AS decimal FROM part"""
)
def fn_numbers(spark, d):
    size = F.col("p_size").cast("string")
    k = F.col("p_size") % 4
    cell = F.when(k == 0, "*").when(k == 1, "0").when(k == 2, F.concat(size, F.lit(".000"))).otherwise(F.concat(size, F.lit(",5")))
    decimal = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(",25"))).otherwise("n/a")
    return table(spark, d, "part").select("p_partkey", numbers.half_even(F.col("p_retailprice") / 1000).alias("rounded"), numbers.cell_value(cell).alias("cell"), numbers.decimal_comma(decimal).alias("decimal"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS campaign, year(o_orderdate)::INT AS year FROM orders")
def fn_campaign(spark, d):
    caption = F.concat(F.lit("Bảng 1: tháng "), F.month("o_orderdate").cast("string"), F.lit(" năm "), F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", numbers.campaign(caption).alias("campaign"), numbers.year(caption).alias("year"))


@query("SELECT s_suppkey, round(8 + s_suppkey % 15 + (s_suppkey % 60) / 60 + 30.5 / 3600, 6) AS lat, round(102 + s_suppkey % 8 + (s_suppkey * 7 % 60) / 60 + 15 / 3600, 6) AS lon FROM supplier")
def fn_position(spark, d):
    s = F.col("s_suppkey")
    line = F.format_string("%d°%d'15   %02d°%d'30,5", 102 + s % 8, s * 7 % 60, 8 + s % 15, s % 60)
    return table(spark, d, "supplier").select("s_suppkey", numbers.position(line).alias("p")).select("s_suppkey", "p.lat", "p.lon")


# -- the graph --------------------------------------------------------------------------------------------------


def _triples(spark, d):
    """Regions, nations and suppliers as triples."""
    v = knowledge.Vocabulary()
    nation, supplier, region = (table(spark, d, n) for n in ("nation", "supplier", "region"))
    n, s, r = v.resource("nation", F.col("n_nationkey")), v.resource("supplier", F.col("s_suppkey")), v.resource("region", F.col("r_regionkey"))
    return graph.as_set(
        graph.iri(region, r, graph.RDF_TYPE, F.lit(v.term("Region"))),
        graph.literal(region, r, knowledge.RDFS + "label", F.col("r_name"), lang="en"),
        graph.iri(nation, n, graph.RDF_TYPE, F.lit(v.term("Nation"))),
        graph.iri(nation, n, v.term("in"), v.resource("region", F.col("n_regionkey"))),
        graph.iri(supplier, s, graph.RDF_TYPE, F.lit(v.term("Supplier"))),
        graph.iri(supplier, s, v.term("in"), v.resource("nation", F.col("s_nationkey"))),
        graph.literal(supplier, s, v.term("balance"), F.col("s_acctbal"), knowledge.XSD + "decimal"),
    )


@query("SELECT 'Region' AS class, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Supplier', count(*) FROM supplier")
def graph_class_counts(spark, d):
    return graph.class_counts(_triples(spark, d)).select(tx.iri_fragment(F.col("class")).alias("class"), "n")


@query("SELECT r_name AS region, count(*)::VARCHAR AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 1000 GROUP BY r_name")
def graph_sparql(spark, d):
    text = f"""PREFIX k: <{knowledge.BASE}ontology#> PREFIX rdfs: <{knowledge.RDFS}>
    SELECT ?region (COUNT(DISTINCT ?s) AS ?suppliers) WHERE {{ ?s a k:Supplier ; k:in/k:in/rdfs:label ?region ; k:balance ?b . FILTER(?b > 1000) }} GROUP BY ?region ORDER BY ?region"""
    out = sparql.run_query(text, _triples(spark, d))
    return out.select("region", F.col("suppliers").cast("string").alias("suppliers"))


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    a, b = F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return li.select(a.alias("src"), b.alias("dst"), F.lit("has").alias("rel"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
h(id, hop) AS (SELECT 'p1', 0 UNION SELECT u.b, hop + 1 FROM h JOIN u ON u.a = h.id WHERE hop < 2) SELECT id, min(hop)::INT AS hop FROM h GROUP BY id"""
)
def graph_neighbourhood(spark, d):
    start = spark.range(1).select(F.lit("p1").alias("id"))
    return graph.neighbourhood(_edges(spark, d), start, 2)


@query(
    """WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem), x AS (SELECT a AS id, 'out' AS direction, b AS other FROM e UNION ALL SELECT b, 'in', a FROM e),
r AS (SELECT *, count(*) OVER (PARTITION BY id, direction) AS n, row_number() OVER (PARTITION BY id, direction ORDER BY other) AS k FROM x)
SELECT id, 'has' AS rel, direction, max(n) AS n, string_agg(other, ',' ORDER BY other) AS links FROM r WHERE k <= 40 GROUP BY id, direction"""
)
def graph_link_lists(spark, d):
    return graph.link_lists(_edges(spark, d)).withColumn("links", F.array_join("links", ","))


@query("SELECT 'triples' AS name, (SELECT count(*) FROM region) * 2 + (SELECT count(*) FROM nation) * 2 + (SELECT count(*) FROM supplier) * 3 AS n")
def graph_stats(spark, d):
    return explorer.stats(_triples(spark, d))


# -- reports --------------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT DISTINCT source, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS method, lang AS name FROM documents), g AS (SELECT DISTINCT source, lang AS name FROM documents WHERE n_chars > 2000),
m AS (SELECT DISTINCT source, method FROM p), r AS (SELECT coalesce(x.source, p.source) AS source, coalesce(x.method, p.method) AS method, p.name IS NOT NULL AS p, x.name IS NOT NULL AS g
  FROM (SELECT m.source, method, name FROM m JOIN g USING (source)) x FULL JOIN p USING (source, method, name)),
c AS (SELECT source, method, count_if(p)::BIGINT AS n_pred, count_if(g)::BIGINT AS n_gold, count_if(p AND g) AS tp FROM r GROUP BY ALL),
s AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS a, CASE WHEN n_gold > 0 THEN tp / n_gold ELSE 0 END AS b FROM c)
SELECT source, method, n_pred, n_gold, round_even(a, 3) AS P, round_even(b, 3) AS R, CASE WHEN a + b > 0 THEN round_even(2 * a * b / (a + b), 3) ELSE 0 END AS F1 FROM s"""
)
def report_scores(spark, d):
    docs = table(spark, d, "documents")
    predicted = docs.select("source", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("method"), F.col("lang").alias("name"))
    return reports.name_scores(predicted, docs.where("n_chars > 2000").select("source", F.col("lang").alias("name")))


@query(
    """WITH x AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'FUZZY' WHEN 2 THEN 'HIGHERRANK' ELSE 'NONE' END AS m, CASE WHEN p_size % 3 = 0 THEN 'GENUS' WHEN p_size % 3 = 1 THEN 'SPECIES' END AS r,
  CASE WHEN p_size % 5 = 0 THEN 'SYNONYM' ELSE 'ACCEPTED' END AS s, p_size > 25 AS open FROM part)
SELECT p_partkey, CASE WHEN m = 'NONE' THEN 'none' WHEN open AND r <> 'GENUS' THEN 'higherrank' WHEN NOT open AND m = 'HIGHERRANK' THEN 'higherrank' WHEN s = 'SYNONYM' THEN 'synonym' WHEN m = 'FUZZY' THEN 'fuzzy' ELSE 'exact' END AS match FROM x"""
)
def fn_match_class(spark, d):
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "EXACT").when(size % 4 == 1, "FUZZY").when(size % 4 == 2, "HIGHERRANK").otherwise("NONE")
    rank = F.when(size % 3 == 0, "GENUS").when(size % 3 == 1, "SPECIES")
    answer = F.struct(kind.alias("matchType"), rank.alias("rank"), F.when(size % 5 == 0, "SYNONYM").otherwise("ACCEPTED").alias("status"))
    return table(spark, d, "part").select("p_partkey", names.match_class(answer, size > 25).alias("match"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'glyph_unrepaired' WHEN p_size % 5 = 1 THEN 'rejected_fuzzy' WHEN p_size >= 40 AND lower(left(p_type, 5)) = lower(left(p_brand, 5)) THEN 'spelling_variant' ELSE 'classification' END AS kind,
  CASE WHEN p_size % 5 = 0 THEN '^' || lower(p_brand[1:5]) || '[a-z]{1,4}' || 'x$' END AS pattern FROM part"""
)
def fn_conflict_kind(spark, d):
    size = F.col("p_size")
    damaged = F.when(size % 5 == 0, F.concat(F.substring("p_brand", 1, 5), F.lit(" x"))).otherwise(F.replace("p_type", F.lit(" "), F.lit("")))
    kind = names.conflict_kind(damaged, F.col("p_brand"), size / 50, F.when(size % 5 == 1, "fuzzy_rejected").otherwise("exact"))
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), F.when(size % 5 == 0, names.gap_pattern(damaged)).alias("pattern"))


_B = knowledge.BASE


@query(
    f"""SELECT '<{_B}resource/nation/' || n_nationkey || '> <{_B}ontology#in> <{_B}resource/region/' || n_regionkey || '> .' AS value FROM nation
UNION ALL SELECT '<{_B}resource/region/' || r_regionkey || '> <{knowledge.RDFS}label> "' || r_name || '"@en .' FROM region
UNION ALL SELECT '<{_B}resource/supplier/' || s_suppkey || '> <{_B}ontology#in> <{_B}resource/nation/' || s_nationkey || '> .' FROM supplier
UNION ALL SELECT '<{_B}resource/supplier/' || s_suppkey || '> <{_B}ontology#balance> "' || s_acctbal::VARCHAR || '"^^<{knowledge.XSD}decimal> .' FROM supplier
UNION ALL SELECT '<{_B}resource/region/' || r_regionkey || '> <{graph.RDF_TYPE}> <{_B}ontology#Region> .' FROM region
UNION ALL SELECT '<{_B}resource/nation/' || n_nationkey || '> <{graph.RDF_TYPE}> <{_B}ontology#Nation> .' FROM nation
UNION ALL SELECT '<{_B}resource/supplier/' || s_suppkey || '> <{graph.RDF_TYPE}> <{_B}ontology#Supplier> .' FROM supplier"""
)
def graph_ntriples(spark, d):
    return graph.ntriples(_triples(spark, d))


@query(
    """WITH e AS (SELECT p_type AS grp, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE 'y' END AS place, p_name AS canonical, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS accepted FROM part),
s AS (SELECT DISTINCT grp, place, 'canonical' AS names, canonical AS name FROM e UNION SELECT DISTINCT grp, place, 'accepted', accepted FROM e),
h AS (SELECT grp, names, name, bool_or(place = 'x') AS a, bool_or(place = 'y') AS b FROM s GROUP BY ALL),
g AS (SELECT grp, string_agg(name, ';' ORDER BY name) AS gained FROM h k WHERE names = 'accepted' AND a AND b AND name NOT IN (SELECT name FROM h p WHERE p.grp = k.grp AND names = 'canonical' AND a AND b) GROUP BY grp)
SELECT grp AS "group", 'x' AS a, 'y' AS b, names, count_if(a)::BIGINT AS n_a, count_if(b)::BIGINT AS n_b, count_if(a AND b)::BIGINT AS shared, round_even(2 * count_if(a AND b) / (count_if(a) + count_if(b)), 3) AS sorensen,
  CASE WHEN names = 'accepted' THEN coalesce(any_value(gained), '') END AS gained_by_reconciliation FROM h LEFT JOIN g USING (grp) GROUP BY grp, names"""
)
def report_overlap(spark, d):
    part = table(spark, d, "part")
    rows = part.select(
        F.col("p_type").alias("group"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise("y").alias("waterbody"), F.col("p_name").alias("canonical"), F.lit(False).alias("is_morphospecies"), F.lit(False).alias("is_higher_taxon"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("gbif_accepted"), F.col("p_name").alias("gbif_name"), F.lit("exact").alias("gbif_match"),
    )
    pairs = part.select(F.col("p_type").alias("group")).distinct().select("group", F.lit("x").alias("a"), F.lit("y").alias("b"))
    return reports.overlap(rows, pairs).withColumn("gained_by_reconciliation", F.array_join("gained_by_reconciliation", ";"))


# -- events, in batch as the stream would see them ---------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_by_day(spark, d):
    return windows.by_window(table(spark, d, "events"), "1 day").select(F.col("start").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, count(*) AS n, count(DISTINCT g) AS sessions FROM s GROUP BY user_id"""
)
def events_sessions(spark, d):
    runs = windows.sessions(table(spark, d, "events"), "6 hours")
    return runs.groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("sessions"))
