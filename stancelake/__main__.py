"""Command line: ``python -m stancelake COMMAND ...``."""

from __future__ import annotations

import argparse

from .schemas import ARTICLE


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="stancelake")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("extract", help="articles (JSON) -> reports")
    x.add_argument("articles"), x.add_argument("output"), x.add_argument("--lines", action="store_true", help="one record a line")
    c = sub.add_parser("clean", help="reports (parquet), anchors (parquet), items (parquet) -> cleaned positions")
    c.add_argument("reports"), c.add_argument("anchors"), c.add_argument("items"), c.add_argument("output")
    for name, default in (("positions", 0.2), ("stakeholders", 0.3), ("targets", 0.15), ("predicates", 0.05)):
        c.add_argument(f"--{name}", type=float, default=default)
    c.add_argument("--voting", default="all"), c.add_argument("--method", default="fast")
    for name, text in (("link-grid", "similarities of labelled pairs (parquet: gold, one column a model) -> metrics of every setting"), ("topic-grid", "vectors (parquet: id, vec) -> outliers and topics of every setting"), ("topics", "vectors (parquet: id, vec) -> topics")):
        g = sub.add_parser(name, help=text)
        g.add_argument("input"), g.add_argument("output")
        g.add_argument("--neighbors", type=int, nargs="+", default=[15]), g.add_argument("--components", type=int, nargs="+", default=[5])
        g.add_argument("--min-cluster-size", type=int, nargs="+", default=[10]), g.add_argument("--min-samples", type=int, nargs="+", default=[5])
        g.add_argument("--thresholds", type=float, nargs="+", default=[0.05, 0.1, 0.15, 0.2, 0.25, 0.3])
    q = sub.add_parser("query", help="run a named query and show rows")
    q.add_argument("name"), q.add_argument("folder"), q.add_argument("--rows", type=int, default=20)
    a = p.parse_args(argv)
    from .session import build_session

    spark = build_session()
    if a.command == "extract":
        from .operators.extract import reports_from_articles
        from .sources.io import read_records, write_records

        print(write_records(reports_from_articles(read_records(spark, a.articles, ARTICLE, a.lines)), a.output, "stub"))
    elif a.command == "clean":
        from .plans.pipeline import PostProcessConfig, post_process

        cfg = PostProcessConfig(a.positions, a.stakeholders, a.targets, a.predicates, a.voting, a.method)
        for name, df in post_process(spark.read.parquet(a.reports), spark.read.parquet(a.anchors), spark.read.parquet(a.items), cfg).items():
            df.write.mode("overwrite").parquet(f"{a.output}/{name}")
    elif a.command == "link-grid":
        from .operators.evaluate import link_grid

        pairs = spark.read.parquet(a.input)
        link_grid(pairs, [c for c in pairs.columns if c != "gold" and dict(pairs.dtypes)[c] in ("double", "float")], "gold", a.thresholds).write.mode("overwrite").parquet(a.output)
    elif a.command in ("topic-grid", "topics"):
        from itertools import product

        from .operators.topics import density_clusters, reduce_dims, topic_grid

        points, names = spark.read.parquet(a.input), ("n_neighbors", "n_components", "min_cluster_size", "min_samples")
        settings = [dict(zip(names, s)) for s in product(a.neighbors, a.components, a.min_cluster_size, a.min_samples)]
        if a.command == "topics":
            s = settings[0]
            out = density_clusters(reduce_dims(points, "id", "vec", s["n_components"]), "id", "vec", s["min_cluster_size"], s["min_samples"], s["n_neighbors"])
        else:
            out = topic_grid(spark, points, "id", "vec", settings)
        out.write.mode("overwrite").parquet(a.output)
    else:
        from .plans.registry import QUERIES

        QUERIES[a.name](spark, a.folder).show(a.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
