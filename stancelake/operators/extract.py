"""Articles -> nested reports through a pluggable extractor."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from ..functions.text import author_label, user_prompt
from ..schemas import REPORT

Extractor = Callable[[str], str]


def stub_extractor(prompt: str) -> str:
    """A deterministic offline extractor: every sentence "X said/wants/called ... Y" becomes a position of X."""
    rows = []
    for m in re.finditer(r"([A-Z][^.!?\n]{2,}?) (rejected|criticised|praised|defended|demanded|questioned|endorsed) ([^.!?\n]{3,})", prompt):
        good = m[2] in ("praised", "defended", "endorsed")
        rows.append({
            "stakeholder": m[1].strip(), "position": f"{m[2]} {m[3]}".strip(), "stance": "Pro" if good else "Con", "sentiment": "Positive" if good else "Negative", "emotion": None,
            "context": "Political", "support": {"type": "Not provided", "content": None}, "targets": [{"predicate": m[2], "target": m[3].strip(), "stance_type": "Positive" if good else "Negative"}],
            "country": {"name": "None", "code": "None"}})
    return json.dumps({"positions": rows, "political_issue": None, "is_about_event": bool(rows)})


def reports_from_articles(articles: DataFrame, extractor: Extractor = stub_extractor, delimiter: str = "####", keep_empty: bool = False) -> DataFrame:
    """One report per article, fields as in the report schema.

    Articles for which the extractor fails, or finds no positions, are left out unless ``keep_empty``;
    the service behind the extractor is called in partitions, never from the driver.
    """
    base = articles.select(
        "id", "title", author_label("author", "source").alias("author"), F.coalesce("summary", F.lit("")).alias("summary"), "body", F.col("`@timestamp`").alias("timestamp"),
        user_prompt(delimiter, title="title", summary="summary", body="body").alias("prompt"))

    def run(batches: Iterable) -> Iterator:
        for pdf in batches:
            out = []
            for p in pdf["prompt"]:
                try:
                    out.append(extractor(p))
                except Exception:
                    out.append(None)
            yield pdf.drop(columns=["prompt"]).assign(reply=out)

    names = ["id", "title", "author", "summary", "body", "timestamp"]
    got = base.mapInPandas(run, ", ".join(f"{n} string" for n in [*names, "reply"]))
    r = got.select(*names, F.from_json("reply", REPORT, {"mode": "PERMISSIVE"}).alias("r"))
    r = r.select(*names, F.col("r.political_issue").alias("political_issue"), F.col("r.is_about_event").alias("is_about_event"), F.col("r.positions").alias("positions"))
    return r if keep_empty else r.where("size(positions) > 0")
