"""Graph sinks: CSV, JSON, GraphML, tables; slices as JSON; reports as text."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import redact
from quarrylens.operators.graph import keep_first


def _text(df: DataFrame) -> DataFrame:
    """Columns as text: no nulls, numbers rounded to six places."""
    types = dict(df.dtypes)
    return df.select(*[F.coalesce((F.round(c, 6) if types[c] == "double" else F.col(c)).cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """Ordered files with a header; Spark writes one file for each range."""
    _text(df).orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Lossless: a line for each node and edge, with what it is."""
    one = lambda df, what: df.select(F.to_json(F.struct(F.lit(what).alias("element"), *df.columns), {"ignoreNullFields": "false"}).alias("value"))
    one(nodes, "node").unionAll(one(edges, "edge")).write.mode("overwrite").text(path)


NODE_KEYS, EDGE_KEYS = ("kind", "label", "file", "cluster_id"), ("kind", "label", "confidence")


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, position, value): the lines of a GraphML document, in order of both."""

    def render(df: DataFrame, tag: str, ends: tuple, keys: tuple) -> DataFrame:
        keys = [k for k in keys if k in df.columns]

        def run(batches):
            for pdf in batches:
                out = []
                for r in pdf.to_dict("records"):
                    head = "".join(f" {a}={quoteattr(str(r[c]))}" for a, c in ends)
                    data = "".join(f'<data key="{k}">{escape(str(r[k]))}</data>' for k in keys if r[k] is not None and r[k] == r[k])
                    out.append((str(r["id"]), f"<{tag}{head}>{data}</{tag}>"))
                yield pd.DataFrame(out, columns=["position", "value"])

        return df.mapInPandas(run, "position string, value string")

    spark = nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}" for="all" attr.name="{k}" attr.type="string"/>' for k in dict.fromkeys(NODE_KEYS + EDGE_KEYS)] + ['<graph edgedefault="directed">']
    fixed = lambda part, lines: spark.createDataFrame([(part, f"{i:04d}", x) for i, x in enumerate(lines)], "part int, position string, value string")
    body = render(nodes, "node", (("id", "id"),), NODE_KEYS).select(F.lit(1).alias("part"), "position", "value")
    links = render(edges, "edge", (("id", "id"), ("source", "source"), ("target", "target")), EDGE_KEYS).select(F.lit(2).alias("part"), "position", "value")
    return fixed(0, head).unionAll(body).unionAll(links).unionAll(fixed(3, ["</graph>", "</graphml>"]))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Files in order, written by many tasks: one after the other by name they are the document."""
    rows = graphml_rows(nodes, edges)
    rows.repartitionByRange("part", "position").sortWithinPartitions("part", "position").select("value").write.mode("overwrite").text(path)


def save_tables(prefix: str, **tables: DataFrame) -> list[str]:
    """Managed tables, one row for each id (the last written wins where an order is given), replaced as a whole."""
    names = []
    for name, df in tables.items():
        if "id" in df.columns:
            order = [F.col("written").desc()] if "written" in df.columns else [F.lit(0)]
            df = keep_first(df, ["id"], *order)
        df.write.mode("overwrite").saveAsTable(f"{prefix}_{name}")
        names.append(f"{prefix}_{name}")
    return names


def slice_json(flow: dict, reached: DataFrame, edges: DataFrame, fragments: DataFrame, standalone: bool = False) -> DataFrame:
    """One row of JSON for a slice; source text is redacted here, at the sink.

    A standalone file calls its texts source_fragments and says how many tokens they have.
    """
    ids = reached.agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("nodes"))
    links = edges.agg(F.sort_array(F.collect_list(F.struct("kind", "source", "target"))).alias("edges"))
    texts = fragments.select("fragment", "procedure", "file", "line", redact("text").alias("text")).agg(F.sort_array(F.collect_list(F.struct("fragment", "procedure", "file", "line", "text"))).alias("fragments"))
    if standalone:
        # told of the redacted texts of this file
        flow = {k: v for k, v in flow.items() if k != "context_token_estimate"}
    # lists are of texts
    fields = [(F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)).alias(k) for k, v in flow.items()]
    if standalone:
        many = F.expr("aggregate(fragments, 0L, (n, x) -> n + (length(x.text) + 3) DIV 4)")
        return ids.crossJoin(links).crossJoin(texts).select(F.to_json(F.struct(*fields, "nodes", "edges", F.col("fragments").alias("source_fragments"), many.alias("context_token_estimate"))).alias("value"))
    return ids.crossJoin(links).crossJoin(texts).select(F.to_json(F.struct(*fields, "nodes", "edges", "fragments")).alias("value"))


def export(nodes: DataFrame, edges: DataFrame, folder: str) -> list[str]:
    """All file formats; returns what was written."""
    write_csv(nodes, f"{folder}/nodes.csv", "kind", "id")
    write_csv(edges, f"{folder}/edges.csv", "id")
    write_json(nodes, edges, f"{folder}/graph.json")
    write_graphml(nodes, edges, f"{folder}/graph.graphml")
    return [f"{folder}/{x}" for x in ("nodes.csv", "edges.csv", "graph.json", "graph.graphml")]
