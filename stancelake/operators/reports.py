"""Aggregates for reading: countries, topic summaries, pages."""

from __future__ import annotations

import html
import json
from string import Template

from pyspark.sql import DataFrame, functions as F

from ..functions.text import country_or_null
from .dedup import most_common


def country_heatmap(positions: DataFrame, seen: str, top: int = 5) -> DataFrame:
    """``(country_code, positions, stakeholders, top_positions)``: occurrences, distinct stakeholders and the most frequent positions.

    Positions without a country are left out; equally frequent positions come in order of first occurrence (``seen``).
    """
    p = positions.withColumn("country_code", country_or_null("country_code")).where("country_code is not null")
    total = p.groupBy("country_code").agg(F.count("position").alias("positions"), F.count_distinct("stakeholder").alias("stakeholders"))
    best = most_common(p, ["country_code"], "position", seen, top)
    line = F.concat("position", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    text = best.groupBy("country_code").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "<br>").alias("top_positions"))
    return total.join(text, "country_code", "left")


def colour_range(heatmap: DataFrame) -> DataFrame:
    return heatmap.agg(F.min("positions").alias("min_positions"), F.max("positions").alias("max_positions"))


def topic_summary_input(positions: DataFrame, topics: DataFrame, key: str, time: str) -> DataFrame:
    """``(topic, first_time, last_time, n, records)``: the members of each topic as JSON records, with their time range.

    ``records`` holds the whole topic, as a summariser is handed it; the columns beside it are aggregates
    and cost nothing more if ``records`` is not asked for.  Outliers (-1) have no summary.
    """
    m = positions.join(topics.where("topic is not null and topic <> '-1'"), key)
    rec = F.to_json(F.struct(F.col("stakeholder"), F.col("position"), F.col("stance"), F.col("country_code").alias("country"), F.col("support_type"), F.col(time).cast("string").alias("time")))
    rows = F.transform(F.sort_array(F.collect_list(F.struct(key, rec.alias("r")))), lambda x: x["r"])
    return m.groupBy("topic").agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("n"), rows.alias("records"))


_PAGE = Template("<html><head><title>$title</title></head><body><h1>$title</h1><h2>Key points</h2>$points<h2>Stakeholders</h2>$people<h2>$fort</h2>$fors<h2>$againstt</h2>$againsts<h2>Time</h2><p>$time</p>$line</body></html>")


def render_summary(summary: str | dict) -> str:
    """A summary (JSON text, with or without code fences, or a dict) as an HTML page; all text is escaped."""
    if isinstance(summary, str):
        summary = json.loads(summary.replace("```json", "").replace("```html", "").replace("```", ""))
    e = lambda x: html.escape(str(x if x is not None else ""))
    ul = lambda xs: "<ul>" + "".join(f"<li>{x}</li>" for x in xs) + "</ul>"
    both = lambda a, b: f"<b>{e(a)}</b>: {e(b)}"
    people = "".join(f"<h3>{e(c)}</h3>" + ul(both(p.get("name"), p.get("explanation")) for p in ps) for c, ps in (summary.get("important_stakeholders_per_country") or {}).items())
    args = {k: summary.get(k) or {} for k in ("arguments_for", "arguments_against")}
    return _PAGE.substitute(
        title=e(summary.get("title")), points=ul(both(p.get("point"), p.get("explanation")) for p in summary.get("key_points") or []), people=people,
        fort=e(args["arguments_for"].get("title") or "For"), fors=ul(map(e, args["arguments_for"].get("items") or [])),
        againstt=e(args["arguments_against"].get("title") or "Against"), againsts=ul(map(e, args["arguments_against"].get("items") or [])),
        time=e(summary.get("time_analysis")), line=ul(f"{e(t.get('date'))} {both(t.get('person'), t.get('event'))}" for t in summary.get("timeline") or []))
