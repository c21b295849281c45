"""Sources and sinks: records, anchors, gold clusters, knowledge base, caches, resumable results."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import ANCHOR, GOLD, REPORT

# Languages kept from a knowledge-base record.
LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "pl", "uk", "ru")


def read_records(spark: SparkSession, path: str, schema: T.StructType = REPORT, lines: bool = False) -> DataFrame:
    """Files of one JSON array of records each, or with ``lines`` of one record a line (which can be split); records that do not fit keep their text in ``_corrupt_record``."""
    s = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(s).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """Anchor counts from CSV with a header; empty cells are null."""
    return spark.read.schema(ANCHOR).option("header", True).csv(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``(cluster_id, ord, name)`` from a text file holding one array of arrays, in lines of any length."""
    text = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_replace("value", r"\s*\r?\n\s*", ""), GOLD).alias("g"))
    return text.select(F.posexplode("g").alias("cluster_id", "names")).select("cluster_id", F.posexplode("names").alias("ord", "name"))


def read_embeddings(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """``(model, row_id, embedding)``, one folder a model so that unused models are never read."""
    df = spark.read.parquet(path)
    return df.where(F.col("model").isin(*models)) if models else df


def write_embeddings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("model").parquet(path)


def parse_kb(raw: DataFrame, id_col: str, json_col: str, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Knowledge-base records from their JSON; a record that cannot be read gives null fields.

    Labels and aliases of the kept languages are lower-cased, so is the English description; the
    main label keeps its case and is empty where there is no English one.
    """
    value = T.StructType.fromDDL("language string, value string")
    entity = T.StructType([
        T.StructField("labels", T.MapType(T.StringType(), value)), T.StructField("descriptions", T.MapType(T.StringType(), value)),
        T.StructField("aliases", T.MapType(T.StringType(), T.ArrayType(value)))])
    doc = T.StructType([T.StructField("entities", T.MapType(T.StringType(), entity))])
    e = raw.select(F.col(id_col).alias("item_id"), F.element_at(F.map_values(F.from_json(json_col, doc)["entities"]), 1).alias("e"))
    keep = lambda m: F.map_values(F.map_filter(m, lambda k, _: k.isin(*languages)))
    low = lambda a: F.transform(a, lambda x: F.lower(x["value"]))
    return e.select(
        "item_id", F.when(F.col("e").isNotNull(), F.coalesce(F.col("e.labels")["en"]["value"], F.lit(""))).alias("main_label"),
        low(keep(F.col("e.labels"))).alias("labels"), F.lower(F.col("e.descriptions")["en"]["value"]).alias("description"),
        low(F.flatten(keep(F.col("e.aliases")))).alias("aliases"), low(F.coalesce(F.col("e.aliases")["en"], F.array().cast(T.ArrayType(value)))).alias("en_aliases"))


def fetch_records(keys: DataFrame, key: str, fetch: Callable[[list], list[str | None]], batch: int = 50) -> DataFrame:
    """``(key, payload)`` of distinct keys by a lookup handed in, which answers a list of keys with a list of texts.

    A batch that fails is asked key by key; keys that fail alone have a null payload.  The service is
    called from the partitions, never from the driver.
    """
    kind = keys.schema[key].dataType.simpleString()

    def one(k) -> str | None:
        try:
            return fetch([k])[0]
        except Exception:
            return None

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                asked = part[key].tolist()
                try:
                    got = list(fetch(asked))
                except Exception:
                    got = [one(k) for k in asked]
                yield part.assign(payload=got)

    return keys.where(F.col(key).isNotNull()).select(key).distinct().mapInPandas(run, f"`{key}` {kind}, payload string")


def embed_resumed(df: DataFrame, id_col: str, text: str, models: dict, path: str, parts: int = 1) -> DataFrame:
    """``(id, model, embedding)`` kept at ``path``: only rows not embedded yet are sent to the models, in ``parts`` appended one by one.

    What a broken run had finished is not asked for again.
    """
    from ..operators.vectors import embed

    spark = df.sparkSession
    for i in range(parts):
        todo = df.select(id_col, text).where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == i)  # one part after the other, all of them
        if exists(spark, path):
            todo = todo.join(spark.read.parquet(path).select(id_col).distinct(), id_col, "left_anti")
        append_results(embed(todo, text, models).select(id_col, "model", "embedding"), path)
    return spark.read.parquet(path)


def read_config(path: str) -> dict:
    """Driver-side configuration (JSON; YAML where a YAML reader is installed)."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def events_table(spark: SparkSession, config: dict) -> DataFrame:
    """``(key, name, description, topic, search_period)`` of the configured events."""
    events = config.get("datasets", config.get("prompts", {}).get("datasets", config)).get("link_along_events", {})
    rows = [(k, v.get("name"), v.get("description"), v.get("topic"), v.get("search_period")) for k, v in events.items()]
    return spark.createDataFrame(rows, "key string, name string, description string, topic string, search_period string")


def search_period(df: DataFrame, col: str = "search_period") -> DataFrame:
    """``dd.MM.yyyy-dd.MM.yyyy`` split into ``period_start`` and ``period_end`` dates; null if malformed."""
    part = lambda i: F.try_to_timestamp(F.trim(F.try_element_at(F.split(col, "-"), F.lit(i))), F.lit("dd.MM.yyyy")).cast("date")
    return df.withColumn("period_start", part(1)).withColumn("period_end", part(2))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, length, modificationTime)`` of files, without their content."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")


def secret(name: str) -> str:
    """A required environment variable; never put into a plan."""
    if not os.environ.get(name):
        raise KeyError(f"environment variable {name} is not set")
    return os.environ[name]


def write_records(df: DataFrame, folder: str, model: str = "", extra: str = "", stamp: datetime | None = None) -> str:
    """JSON records in a new folder ``{model}_{extra}_report_{yyyyMMdd-HHmmss}``; returns its path."""
    when = (stamp or datetime.now()).strftime("%Y%m%d-%H%M%S")
    path = f"{folder}/{'_'.join(x for x in (model, extra, 'report', when) if x)}"
    df.write.mode("errorifexists").json(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")))


def build_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it was completely written before, else ``build()`` written there and read back."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pending(grid: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Points of a parameter grid without a result yet (arrays compare by their sorted text)."""
    if done is None:
        return grid
    canon = lambda df: df.select("*", *[F.to_json(F.struct(F.sort_array(c) if df.schema[c].dataType.typeName() == "array" else F.col(c))).alias(f"_k_{c}") for c in keys])
    ks = [f"_k_{c}" for c in keys]
    return canon(grid).join(canon(done).select(*ks).distinct(), ks, "left_anti").drop(*ks)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
