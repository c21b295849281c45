"""Round trips through the sources and sinks: what is written is what is read."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..schemas import ANCHOR, ARTICLE, REPORT, with_missing
from ..session import checkpoint_root, observed
from ..sources import io
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


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT report_key, pos.n AS pos_no, pos.p.stakeholder AS stakeholder, pos.p.country.code AS country_code, CAST(coalesce(len(pos.p.targets), -1) AS INTEGER) AS targets
FROM (SELECT id AS report_key, unnest(list_zip(positions, range(len(positions)))) AS z FROM reports WHERE positions IS NOT NULL), LATERAL (SELECT {'p': z[1], 'n': CAST(z[2] AS INTEGER)} AS pos)""")
def records_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as JSON into a stamped folder and read back with their schema."""
    r = with_missing(table(spark, d, "reports", *[f.name for f in REPORT.fields if f.name != "timestamp"]).withColumn("timestamp", F.lit(None).cast("string")), REPORT)
    path = io.write_records(r, _folder(spark, "records"), "model", "x", datetime(2024, 5, 6, 7, 8, 9))
    back = io.read_records(spark, path, lines=True).where("_corrupt_record is null").select("id", F.posexplode("positions").alias("pos_no", "p"))
    return back.select(F.col("id").alias("report_key"), "pos_no", "p.stakeholder", "p.country.code", F.coalesce(F.size("p.targets"), F.lit(-1)).alias("targets")).withColumnRenamed("code", "country_code")


@query("SELECT id, title, source, \"@timestamp\" AS \"timestamp\" FROM articles")
def articles_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Articles as JSON records with an awkward column name."""
    path = io.write_records(table(spark, d, "articles", *ARTICLE.fieldNames()), _folder(spark, "articles"))
    return io.read_records(spark, path, ARTICLE, lines=True).select("id", "title", "source", F.col("`@timestamp`").alias("timestamp"))


@query("SELECT nullif(normalized_anchor_text, '') AS anchor, target_item_id, target_page_id, target_page_views FROM df_max_views")
def anchors_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Anchors as CSV with a header; empty texts come back as null."""
    path = _folder(spark, "anchors")
    table(spark, d, "df_max_views", *ANCHOR.fieldNames()).write.option("header", True).option("escape", '"').csv(path)
    back = io.read_anchors(spark, path)
    return back.select(F.nullif("normalized_anchor_text", F.lit("")).alias("anchor"), "target_item_id", "target_page_id", "target_page_views")


@query("""SELECT 'jina' AS model, row_id, CAST(len(jina_embeddings) AS INTEGER) AS dim, round(list_sum(CAST(jina_embeddings AS DOUBLE[])), 4) AS total FROM df_max_views WHERE jina_embeddings IS NOT NULL AND len(jina_embeddings) > 0""")
def embeddings_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of two models in one folder a model; only the one asked for is read."""
    v = table(spark, d, "df_max_views", "row_id", "jina_embeddings", "sentence_transformer_embeddings")
    long = v.select(F.lit("jina").alias("model"), "row_id", F.col("jina_embeddings").alias("embedding")).unionByName(v.select(F.lit("st").alias("model"), "row_id", F.col("sentence_transformer_embeddings").alias("embedding")))
    path = _folder(spark, "embeddings")
    io.write_embeddings(long, path)
    back = io.read_embeddings(spark, path, ["jina"]).where("size(embedding) > 0")
    return back.select(F.col("model").cast("string").alias("model"), "row_id", F.size("embedding").alias("dim"), F.round(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT CAST(row_number() OVER (ORDER BY cluster_id) - 1 AS INTEGER) AS cluster_no, n, first FROM (SELECT cluster_id, count(*) AS n, min(name) AS first FROM gold_clusters GROUP BY 1)")
def gold_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Gold clusters as one array of arrays in a text file."""
    g = table(spark, d, "gold_clusters").groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("x"))
    text = g.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("cluster_id", F.transform("x", lambda y: y["name"]).alias("names")))), lambda y: y["names"])).alias("value"))  # a fixed hand-made set
    path = _folder(spark, "gold")
    text.coalesce(1).write.text(path)
    return io.read_gold(spark, path).groupBy(F.col("cluster_id").alias("cluster_no")).agg(F.count("*").alias("n"), F.min("name").alias("first"))


@query("SELECT target_item_id, count(*) AS n FROM df_max_views WHERE target_item_id IS NOT NULL GROUP BY 1")
def cached_side_table(spark: SparkSession, d: str) -> DataFrame:
    """A side table built once; the second call reads what the first wrote."""
    path = _folder(spark, "side")
    build = lambda: table(spark, d, "df_max_views", "target_item_id").where("target_item_id is not null").groupBy("target_item_id").agg(F.count("*").alias("n"))
    io.build_or_load(spark, path, build)

    def never() -> DataFrame:
        raise RuntimeError("built twice")

    return io.build_or_load(spark, path, never)


@query("SELECT k AS setting, k * 10 AS result FROM range(6) t(k)")
def resumed_grid(spark: SparkSession, d: str) -> DataFrame:
    """A grid worked off in two runs; the second does only what the first left."""
    path = _folder(spark, "grid")
    grid = spark.range(6).select(F.col("id").alias("setting"))
    io.append_results(grid.where("setting < 4").withColumn("result", F.col("setting") * 10), path)
    io.append_results(io.pending(grid, spark.read.parquet(path), ["setting"]).withColumn("result", F.col("setting") * 10), path)
    return spark.read.parquet(path)


@query("SELECT 1 AS files, true AS has_content")
def listed_files(spark: SparkSession, d: str) -> DataFrame:
    """Listing without content."""
    return io.list_files(spark, f"{d}/gold_clusters.parquet").agg(F.lit(1).alias("files"), (F.max("length") > 0).alias("has_content"))


@query("""WITH r AS (SELECT DISTINCT item_id, main_label, description FROM kb_items) SELECT item_id, main_label, lower(description) AS description, lower(main_label) AS first_label, 2 AS n_aliases FROM r""")
def kb_records(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge-base records from their JSON: kept languages only, lower-cased labels."""
    k = table(spark, d, "kb_items", "item_id", "main_label", "description").distinct()
    one = lambda lang, v: F.struct(F.lit(lang).alias("language"), v.alias("value"))
    entity = F.struct(
        F.create_map(F.lit("en"), one("en", F.col("main_label")), F.lit("ja"), one("ja", F.lit("x"))).alias("labels"), F.create_map(F.lit("en"), one("en", F.col("description"))).alias("descriptions"),
        F.create_map(F.lit("en"), F.array(one("en", F.lit("A")), one("en", F.lit("B")))).alias("aliases"))
    raw = k.select("item_id", F.to_json(F.struct(F.create_map(F.concat(F.lit("Q"), F.col("item_id").cast("string")), entity).alias("entities"))).alias("payload"))
    p = io.parse_kb(raw, "item_id", "payload")
    return p.select("item_id", "main_label", "description", F.element_at("labels", 1).alias("first_label"), F.size("en_aliases").alias("n_aliases"))


@query("SELECT item_id, main_label FROM (SELECT DISTINCT item_id, CASE WHEN item_id % 10 = 3 THEN NULL ELSE 'item ' || item_id END AS main_label FROM kb_items)")
def kb_fetched(spark: SparkSession, d: str) -> DataFrame:
    """Reference items by a lookup handed in; some keys fail alone."""

    def fetch(keys: list) -> list:
        if any(k % 10 == 3 for k in keys):
            raise OSError("no answer")
        return ['{"entities": {"Q%d": {"labels": {"en": {"language": "en", "value": "item %d"}}}}}' % (k, k) for k in keys]

    got = io.fetch_records(table(spark, d, "kb_items", "item_id"), "item_id", fetch)
    return io.parse_kb(got, "item_id", "payload").select("item_id", "main_label")


@query("SELECT item_id, m.model, CAST(m.dim AS INTEGER) AS dim, 1 AS n FROM kb_items, (SELECT 'a' AS model, 16 AS dim UNION ALL SELECT 'b', 24) m")
def embeddings_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Texts embedded in parts; a second run embeds only what is missing, so nothing is there twice."""
    from ..operators.vectors import hashed_embedding

    path = _folder(spark, "resumed")
    k = table(spark, d, "kb_items", "item_id", "main_label")
    models = {"a": hashed_embedding(16), "b": hashed_embedding(24, 4)}
    io.embed_resumed(k.where("item_id % 2 = 0"), "item_id", "main_label", models, path, 2)
    all_ = io.embed_resumed(k, "item_id", "main_label", models, path)
    return all_.groupBy("item_id", "model").agg(F.max(F.size("embedding")).alias("dim"), F.count("*").cast("int").alias("n"))


@query("""WITH t AS (SELECT doc_id, string_split(lower(text), ' ')[1:8] AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_resize(w, 8, '<pad>'), ' ') AS tokens, CAST(len(w) AS INTEGER) AS real FROM t""")
def padded_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The first tokens of texts brought to one length, with the number of real ones."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    c = t.select("doc_id", *X.collate("w", 8))
    return c.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("real"))


@query("""SELECT n.n_nationkey AS id, v.form, CASE WHEN v.form = 3 THEN NULL ELSE c.code END AS code FROM nation n, (SELECT unnest([0, 1, 2, 3]) AS form) v LEFT JOIN (VALUES ('ALGERIA','DZA'),('ARGENTINA','ARG'),('BRAZIL','BRA'),('CANADA','CAN'),('EGYPT','EGY'),('ETHIOPIA','ETH'),('FRANCE','FRA'),('GERMANY','DEU'),('INDIA','IND'),
('INDONESIA','IDN'),('IRAN','IRN'),('IRAQ','IRQ'),('JAPAN','JPN'),('JORDAN','JOR'),('KENYA','KEN'),('MOROCCO','MAR'),('MOZAMBIQUE','MOZ'),('PERU','PER'),('CHINA','CHN'),('ROMANIA','ROU'),('SAUDI ARABIA','SAU'),('VIETNAM','VNM'),('RUSSIA','RUS'),('UNITED KINGDOM','GBR'),('UNITED STATES','USA')) c(name, code) ON c.name = n.n_name""")
def country_codes(spark: SparkSession, d: str) -> DataFrame:
    """Typed countries -> three-letter codes: by name, by code, with a letter twice, and a word that is none."""
    n = table(spark, d, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    typed = F.array(F.concat(F.lit(" "), F.lower("name")), X.country_code(F.col("name")), F.concat(F.substring("name", 1, 3), F.substring("name", 3, 40)), F.concat(F.lit("the people of "), "name"))
    return n.select("id", F.posexplode(typed).alias("form", "typed")).select("id", "form", X.country_code("typed").alias("code"))


@query("SELECT n_nationkey AS id, n_name AS key, 2020 + n_nationkey % 3 AS start_year, 3 AS end_month FROM nation")
def event_periods(spark: SparkSession, d: str) -> DataFrame:
    """Configured events with their search period split into dates."""
    rows = table(spark, d, "nation", "n_nationkey", "n_name").orderBy("n_nationkey").collect()  # a fixed list of 25
    cfg = {"link_along_events": {r["n_name"]: {"name": str(r["n_nationkey"]), "search_period": f"01.02.{2020 + r['n_nationkey'] % 3}-05.03.2024"} for r in rows}}
    e = io.search_period(io.events_table(spark, cfg))
    return e.select(F.col("name").cast("int").alias("id"), "key", F.year("period_start").alias("start_year"), F.month("period_end").alias("end_month"))


@query("""SELECT item_id, 'Q' || item_id AS q, 'query: ' || coalesce(description, '') AS instructed, trim(replace(replace('```json ' || main_label || '```', '```json', ''), '```', '')) AS bare FROM kb_items""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers, model prefixes and replies without their fences."""
    k = table(spark, d, "kb_items", "item_id", "main_label", "description")
    return k.select("item_id", X.q_id("item_id").alias("q"), X.instruct(F.coalesce("description", F.lit("")), "query: ").alias("instructed"), X.strip_fences(F.concat(F.lit("```json "), F.col("main_label"), F.lit("```"))).alias("bare"))


@query("SELECT count(*) AS n, count(stakeholder) AS named, max(position_id) AS last_id, count(*) AS written FROM positions")
def observed_write(spark: SparkSession, d: str) -> DataFrame:
    """A run's summary gathered while its result is written."""
    path = _folder(spark, "observed")
    df, seen = observed(table(spark, d, "positions", "position_id", "stakeholder"), "run", n=F.count(F.lit(1)), named=F.count("stakeholder"), last_id=F.max("position_id"))
    df.write.parquet(path)
    m = seen.get
    return spark.read.parquet(path).agg(F.lit(m["n"]).alias("n"), F.lit(m["named"]).alias("named"), F.lit(m["last_id"]).alias("last_id"), F.count(F.lit(1)).alias("written"))


@query("""SELECT position_id, stance, stakeholder FROM positions WHERE stance IN ('Pro', 'Con', 'Neutral') AND stakeholder IS NOT NULL""")
def strict_records(spark: SparkSession, d: str) -> DataFrame:
    """Records kept only if they fit a JSON Schema: its types, required fields and closed vocabularies."""
    from ..schemas import conforms, from_json_schema

    schema = {"type": "object", "required": ["stakeholder", "stance"], "properties": {"position_id": {"type": "integer"}, "stakeholder": {"type": "string"}, "stance": {"type": "string", "enum": ["Pro", "Con", "Neutral"]}}}
    p = table(spark, d, "positions", "position_id", "stakeholder", "stance")
    back = p.select(F.from_json(F.to_json(F.struct(*p.columns)), from_json_schema(schema)).alias("r"))
    return back.where(conforms("r", schema)).select("r.position_id", "r.stance", "r.stakeholder")


@query("""SELECT topic, min(t) AS first_time, max(t) AS last_time, count(*) AS n FROM (SELECT stance AS topic, received_at AS t FROM positions JOIN reports USING (report_key) WHERE stance IS NOT NULL) GROUP BY 1""")
def summary_input(spark: SparkSession, d: str) -> DataFrame:
    """Members of each topic and their time range, as they are handed to a summariser."""
    from ..operators.reports import topic_summary_input

    p = table(spark, d, "positions", "position_id", "report_key", "stakeholder", "position", "stance", "country_code", "support_type").join(table(spark, d, "reports", "report_key", "received_at"), "report_key")
    t = p.where("stance is not null").select("position_id", F.col("stance").alias("topic"))
    return topic_summary_input(p, t.withColumn("kept", F.lit(1)), "position_id", "received_at").select("topic", "first_time", "last_time", "n")
