"""Queries of the relational core: nested records, joins, aggregates, survivors, text, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import dedup, nested, reports
from ..schemas import EMOTIONS, VOCABULARY, vocabulary_violations
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL counterpart."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NORM = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_STRIP = _NORM.format("stakeholder")
_POS = """p AS (SELECT report_key, unnest(positions) AS p, unnest(range(len(positions))) AS pos_no FROM reports WHERE positions IS NOT NULL)"""


@query(f"""WITH {_POS} SELECT report_key, CAST(pos_no AS INTEGER) AS pos_no, p.stakeholder AS stakeholder, p.position AS position, p.support.type AS support_type, p.country.code AS country_code,
CAST(len(p.targets) AS INTEGER) AS n_targets FROM p WHERE len(p.targets) > 0""")
def explode_flatten(spark: SparkSession, d: str) -> DataFrame:
    p = nested.with_members(nested.explode_positions(table(spark, d, "reports", "report_key", "positions"), ["report_key"]), "targets")
    return p.select("report_key", "pos_no", "stakeholder", "position", "support_type", "country_code", F.size("targets").alias("n_targets"))


@query(f"""WITH {_POS}, t AS (SELECT report_key, pos_no, unnest(p.targets) AS t, unnest(range(len(p.targets))) AS target_no FROM p WHERE p.targets IS NOT NULL)
SELECT report_key, CAST(pos_no AS INTEGER) AS pos_no, CAST(target_no AS INTEGER) AS target_no, t.predicate AS predicate, t.target AS target, t.stance_type AS stance_type FROM t""")
def explode_targets(spark: SparkSession, d: str) -> DataFrame:
    p = nested.explode_positions(table(spark, d, "reports", "report_key", "positions"), ["report_key"])
    return nested.explode_targets(p, ["report_key", "pos_no"])


@query("""WITH t AS (SELECT position_id, unnest(targets) AS t, unnest(range(len(targets))) AS n FROM positions WHERE targets IS NOT NULL)
SELECT position_id, string_agg(coalesce(t.predicate, '') || '>' || coalesce(t.target, ''), '|' ORDER BY n) AS targets, count(*) AS n FROM t GROUP BY position_id""")
def regroup_records(spark: SparkSession, d: str) -> DataFrame:
    t = nested.explode_targets(table(spark, d, "positions", "position_id", "targets"), ["position_id"])
    g = nested.regroup(t, ["position_id"], "target_no", ["predicate", "target", "stance_type"])
    one = F.transform("targets", lambda x: F.concat(F.coalesce(x["predicate"], F.lit("")), F.lit(">"), F.coalesce(x["target"], F.lit(""))))
    return g.select("position_id", F.array_join(one, "|").alias("targets"), F.size("targets").cast("bigint").alias("n"))


@query("""SELECT normalized_anchor_text, row_id, target_item_id, target_page_views FROM df_max_views WHERE normalized_anchor_text IS NOT NULL AND normalized_anchor_text <> ''
QUALIFY row_number() OVER (PARTITION BY normalized_anchor_text ORDER BY target_page_views DESC NULLS LAST, row_id) = 1""")
def keep_first_max(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "df_max_views", "normalized_anchor_text", "row_id", "target_item_id", "target_page_views")
    return dedup.best_per_key(a.where("normalized_anchor_text is not null and normalized_anchor_text <> ''"), ["normalized_anchor_text"], "target_page_views", "row_id")


@query(f"""SELECT position_id, {_STRIP} AS stakeholder, position FROM positions QUALIFY row_number() OVER (PARTITION BY position, {_STRIP} ORDER BY position_id) = 1""")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "positions", "position_id", "stakeholder", "position").withColumn("stakeholder", X.normalize_text("stakeholder"))
    return dedup.keep_first(p, ["position", "stakeholder"], ["position_id"])


@query("""WITH c AS (SELECT country_name, stance, count(*) AS n, min(position_id) AS first FROM positions WHERE stance IS NOT NULL GROUP BY ALL)
SELECT country_name, stance, n, CAST(row_number() OVER (PARTITION BY country_name ORDER BY n DESC, first) AS INTEGER) AS rank FROM c QUALIFY rank <= 2""")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return dedup.most_common(table(spark, d, "positions", "country_name", "stance", "position_id"), ["country_name"], "stance", "position_id", 2)


_HEAT = """h AS (SELECT nullif(upper(trim(country_code)), 'NONE') AS country_code, position, stakeholder, position_id FROM positions),
c AS (SELECT country_code, position, count(*) AS n, min(position_id) AS f FROM h WHERE country_code IS NOT NULL AND position IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY n DESC, f) AS rank FROM c QUALIFY rank <= 5),
b AS (SELECT country_code, string_agg(position || ' (' || n || ')', '<br>' ORDER BY rank) AS top_positions FROM r GROUP BY 1),
t AS (SELECT country_code, count(position) AS positions, count(DISTINCT stakeholder) AS stakeholders FROM h WHERE country_code IS NOT NULL GROUP BY 1)"""


@query(f"WITH {_HEAT} SELECT country_code, positions, stakeholders, top_positions FROM t LEFT JOIN b USING (country_code)")
def country_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return reports.country_heatmap(table(spark, d, "positions", "country_code", "position", "stakeholder", "position_id"), "position_id")


@query(f"WITH {_HEAT} SELECT min(positions) AS min_positions, max(positions) AS max_positions FROM t")
def colour_range(spark: SparkSession, d: str) -> DataFrame:
    return reports.colour_range(country_heatmap(spark, d))


@query("SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1")
def min_max_ts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_type", "ts").groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count(k.item_id) AS linked, CAST(round(100.0 * count(k.item_id) / count(*), 2) AS DOUBLE) AS percent
FROM df_max_views a LEFT JOIN kb_items k ON a.target_item_id = k.item_id""")
def hit_rate(spark: SparkSession, d: str) -> DataFrame:
    a, k = table(spark, d, "df_max_views", "target_item_id"), table(spark, d, "kb_items", "item_id")
    j = a.join(k, a.target_item_id == k.item_id, "left")
    return j.agg(F.count("*").alias("n"), F.count("item_id").alias("linked"), X.percent(F.count("item_id"), F.count("*")).alias("percent"))


@query("SELECT item_id, main_label FROM kb_items k WHERE NOT EXISTS (SELECT 1 FROM df_max_views a WHERE a.target_item_id = k.item_id)")
def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_items", "item_id", "main_label").join(table(spark, d, "df_max_views", "target_item_id").withColumnRenamed("target_item_id", "item_id"), "item_id", "left_anti")


@query("SELECT count(*) AS n FROM positions p WHERE EXISTS (SELECT 1 FROM reports r WHERE r.report_key = p.report_key AND r.is_about_event)")
def semi_matched(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reports", "report_key", "is_about_event").where("is_about_event")
    return table(spark, d, "positions", "report_key").join(r.select("report_key"), "report_key", "left_semi").agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT unnest(labels) AS l, item_id, main_label FROM kb_items), u AS (SELECT l, min(nullif(main_label, '')) AS c FROM m GROUP BY 1)
SELECT p.position_id, coalesce(u.c, {_STRIP}) AS stakeholder FROM positions p LEFT JOIN u ON u.l = {_STRIP}""")
def replacement_join(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.clustering import replace_by_canonical

    m = table(spark, d, "kb_items", "labels", "main_label").select(F.explode("labels").alias("item"), F.nullif("main_label", F.lit("")).alias("c")).groupBy("item").agg(F.min("c").alias("canonical"))
    p = table(spark, d, "positions", "position_id", "stakeholder").withColumn("stakeholder", X.normalize_text("stakeholder"))
    return replace_by_canonical(p, "stakeholder", m)


@query("SELECT report_key, title, political_issue FROM reports WHERE is_about_event")
def cond_filter_flag(spark: SparkSession, d: str) -> DataFrame:
    return nested.relevant(table(spark, d, "reports", "report_key", "title", "political_issue", "is_about_event")).drop("is_about_event")


@query("SELECT is_about_event, count(*) AS n, count(DISTINCT political_issue) AS issues FROM reports GROUP BY 1")
def count_by_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reports", "is_about_event", "political_issue").groupBy("is_about_event").agg(F.count("*").alias("n"), F.count_distinct("political_issue").alias("issues"))


@query("SELECT position_id, stakeholder FROM positions WHERE (contains(lower(stakeholder), 'council') AND contains(lower(stakeholder), 'energy')) OR contains(lower(stakeholder), 'zelen') OR contains(lower(stakeholder), 'selen')")
def substring_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "positions", "position_id", "stakeholder")
    return p.where(X.contains_all("stakeholder", "Council", "energy") | X.contains_any("stakeholder", "zelen", "selen"))


@query(f"SELECT {_STRIP} AS name, count(*) AS n, count(DISTINCT report_key) AS reports FROM positions WHERE stakeholder IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def having_groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "positions", "stakeholder", "report_key").where("stakeholder is not null")
    return p.groupBy(X.normalize_text("stakeholder").alias("name")).agg(F.count("*").alias("n"), F.count_distinct("report_key").alias("reports")).where("n >= 2")


@query("""SELECT id, title, coalesce(author, 'Journalist') || ' of ' || source AS author, coalesce(summary, '') AS summary, "@timestamp" AS "timestamp" FROM articles""")
def author_label(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles", "id", "title", "author", "source", "summary", "@timestamp")
    return a.select("id", "title", X.author_label("author", "source").alias("author"), F.coalesce("summary", F.lit("")).alias("summary"), F.col("`@timestamp`").alias("timestamp"))


@query("""SELECT id, 'title: ####' || coalesce(title, '') || '####' || chr(10) || 'summary: ####' || coalesce(summary, '') || '####' AS prompt FROM articles""")
def prompt_template(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "id", "title", "summary").select("id", X.user_prompt("####", title="title", summary="summary").alias("prompt"))


@query("""SELECT item_id, lower(main_label || ' (' || coalesce(description, '') || ')' || CASE WHEN len(en_aliases) > 0 THEN ' | Aliases: ' || array_to_string(en_aliases, ', ') ELSE '' END) AS augmented,
concat_ws(' ', lower(main_label), description) AS described FROM kb_items""")
def augmented_text(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "kb_items", "item_id", "main_label", "description", "en_aliases")
    return k.select("item_id", X.augmented_entity("main_label", "description", "en_aliases").alias("augmented"), X.kb_description_text("main_label", "description").alias("described"))


@query("""WITH c AS (SELECT item_id, list_concat(coalesce(labels, []), [concat_ws(' ', lower(main_label), description)], coalesce(aliases, [])) AS t FROM kb_items)
SELECT item_id, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS text FROM c""")
def union_corpus(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "kb_items", "item_id", "labels", "main_label", "description", "aliases")
    empty = F.array().cast("array<string>")
    return k.select("item_id", F.posexplode(F.concat(F.coalesce("labels", empty), F.array(X.kb_description_text("main_label", "description")), F.coalesce("aliases", empty))).alias("pos", "text"))


@query(f"SELECT position_id, CASE WHEN {_STRIP} = '' THEN '<PAD>' ELSE {_STRIP} END AS name FROM positions")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "positions", "position_id", "stakeholder").select("position_id", X.pad_empty(X.normalize_text("stakeholder")).alias("name"))


@query("SELECT DISTINCT target_item_id AS item_id FROM df_max_views WHERE target_item_id IS NOT NULL EXCEPT SELECT item_id FROM kb_items")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Items that anchors point to and the reference list lacks."""
    a = table(spark, d, "df_max_views", "target_item_id").where("target_item_id is not null").withColumnRenamed("target_item_id", "item_id")
    return a.subtract(table(spark, d, "kb_items", "item_id"))


@query("SELECT DISTINCT country_name FROM positions WHERE country_name IS NOT NULL AND country_name IN (SELECT main_label FROM kb_items)")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "positions", "country_name").where("country_name is not null").intersect(table(spark, d, "kb_items", "main_label").withColumnRenamed("main_label", "country_name"))


@query(f"SELECT {_STRIP} AS name, min(position_id) AS first_ord, count(*) AS cnt FROM positions WHERE stakeholder IS NOT NULL GROUP BY 1")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "positions", "position_id", "stakeholder").where("stakeholder is not null")
    return p.groupBy(X.normalize_text("stakeholder").alias("name")).agg(F.min("position_id").alias("first_ord"), F.count("*").alias("cnt"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY md5('1010:' || doc_id), doc_id LIMIT 50")
def sample_hash(spark: SparkSession, d: str) -> DataFrame:
    return dedup.hash_sample(table(spark, d, "documents", "doc_id", "n_chars"), "doc_id", 50, 1010)


@query("""SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum FROM events GROUP BY 1""".replace("sum(CAST", "CAST(sum(CAST").replace("AS BIGINT)) AS", "AS BIGINT)) AS BIGINT) AS"))
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_type", "props")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k bigint")["k"]).alias("k_sum"))


@query("""SELECT field, value, count(*) AS n FROM (SELECT 'stance' AS field, stance AS value FROM positions WHERE stance NOT IN ('Pro','Con','Neutral')
UNION ALL SELECT 'sentiment', sentiment FROM positions WHERE sentiment NOT IN ('Positive','Negative','Neutral')
UNION ALL SELECT 'context', context FROM positions WHERE context NOT IN ('Geographic','Social','Political','Economic','Not provided')
UNION ALL SELECT 'emotion', emotion FROM positions WHERE emotion NOT IN ('Anger','Fear','Joy','Sadness','Disgust','Surprise')) GROUP BY ALL""")
def vocabulary_check(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary_violations(table(spark, d, "positions", "stance", "sentiment", "context", "emotion"), VOCABULARY | {"emotion": EMOTIONS})


@query(r"""WITH s AS (SELECT id, trim("@timestamp") AS s FROM articles), e AS (SELECT id, s, regexp_full_match(s, '[0-9]{9,14}') AS d, TRY_CAST(s AS BIGINT) AS n FROM s)
SELECT id, CASE WHEN d THEN 'epoch' WHEN s IS NULL THEN 'none' ELSE 'text' END AS notation, count(*) AS n, CAST(sum(CASE WHEN d THEN CASE WHEN n >= 100000000000 THEN n // 1000 ELSE n END WHEN s IS NULL THEN 0 ELSE coalesce(epoch(coalesce(TRY_CAST(s AS TIMESTAMP), try_strptime(s, ['%d.%m.%Y %H:%M', '%d.%m.%Y']))), 0) END) AS BIGINT) AS epoch FROM e GROUP BY ALL""")
def timestamp_notations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles", "id", "@timestamp").select("id", F.trim("`@timestamp`").alias("s"), X.any_timestamp("`@timestamp`").alias("t"))
    digits = F.col("s").rlike(r"^[0-9]{9,14}$")
    kind = F.when(digits, "epoch").when(F.col("s").isNull(), "none").otherwise("text")
    return a.groupBy("id", kind.alias("notation")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.unix_timestamp("t"), F.lit(0))).alias("epoch"))


@query(f"""WITH d AS (SELECT position, {_STRIP} AS s FROM positions WHERE len(targets) > 0 AND stakeholder IS NOT NULL AND trim(stakeholder) <> '' AND position IS NOT NULL),
m AS (SELECT unnest(labels) AS l, main_label FROM kb_items), u AS (SELECT l, min(nullif(main_label, '')) AS c FROM m GROUP BY 1)
SELECT coalesce(u.c, d.s) AS stakeholder, count(DISTINCT d.position) AS positions FROM d LEFT JOIN u ON u.l = d.s GROUP BY 1""")
def stakeholder_positions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct positions of each canonical stakeholder that survive cleaning."""
    from ..operators.clustering import replace_by_canonical

    p = nested.with_members(table(spark, d, "positions", "position_id", "stakeholder", "position", "targets"), "targets").where("stakeholder is not null and trim(stakeholder) <> '' and position is not null")
    p = p.select(X.normalize_text("stakeholder").alias("stakeholder"), "position")
    m = table(spark, d, "kb_items", "labels", "main_label").select(F.explode("labels").alias("item"), F.nullif("main_label", F.lit("")).alias("c")).groupBy("item").agg(F.min("c").alias("canonical"))
    return replace_by_canonical(p, "stakeholder", m).groupBy("stakeholder").agg(F.count_distinct("position").alias("positions"))


_COUNTRY = r"lower(substring(n_name, 1, 3) || substring(n_name, 5))"


@query(f"""WITH q AS (SELECT n_nationkey AS id, {_COUNTRY} AS typed FROM nation)
SELECT q.id, q.typed, n.n_name AS country, CAST(levenshtein(q.typed, lower(n.n_name)) AS INTEGER) AS distance FROM q, nation n WHERE levenshtein(q.typed, lower(n.n_name)) <= 3
QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY levenshtein(q.typed, lower(n.n_name)), n.n_name) = 1""")
def fuzzy_country(spark: SparkSession, d: str) -> DataFrame:
    """Typed country names -> the nearest entry of the fixed list of 25 nations."""
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    q = n.select(F.col("n_nationkey").alias("id"), F.lower(F.concat(F.substring("n_name", 1, 3), F.substring("n_name", 5, 100))).alias("typed"))
    j = q.join(F.broadcast(n), F.levenshtein("typed", F.lower("n_name")) <= 3).select("id", "typed", F.col("n_name").alias("country"), F.levenshtein("typed", F.lower("n_name")).alias("distance"))
    return dedup.keep_first(j, ["id"], ["distance", "country"]).select("id", "typed", "country", "distance")


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT r_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def region_segments(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders", "o_custkey", "o_totalprice"), table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    n, r = table(spark, d, "nation", "n_nationkey", "n_regionkey"), table(spark, d, "region")
    # orders shrink to one row a customer before the join
    per = o.groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("t"))
    j = per.join(c, per.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "c_mktsegment").agg(F.sum("k").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("""SELECT o_orderkey, o_orderpriority, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 ORDER BY qty DESC, o_orderkey LIMIT 100""")
def largest_orders(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return o.join(li, o.o_orderkey == li.l_orderkey).select("o_orderkey", "o_orderpriority", "qty").orderBy(F.desc("qty"), "o_orderkey").limit(100)


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import windowed_counts as counts

    w = counts(table(spark, d, "events", "ts", "event_type"), "ts", "event_type")
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
