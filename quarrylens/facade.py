"""The stages from source text to a verified contract, over DataFrames."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens import codegen, report
from quarrylens.functions import text
from quarrylens.functions.text import redact, slug_text
from quarrylens.operators import contract, graph, rules, slices, verify
from quarrylens.operators import system as sy
from quarrylens.operators.betweenness import betweenness
from quarrylens.operators.lineage import cut, exists
from quarrylens.sources import ast, catalogs, exports, sqlite
from quarrylens.sources.vb6 import PARSER_VERSION, extract, read_sources
from quarrylens.streaming import runlog


class NotAvailable(RuntimeError):
    """A stage that needs a network, a container or a hosted model."""


class Engine:
    """One system: analyse, slice, read rules, review, make a contract, verify, report."""

    def __init__(self, spark: SparkSession, system_id: str, home: str):
        self.spark, self.system_id, self.home = spark, system_id, Path(home)
        self.home.mkdir(parents=True, exist_ok=True)
        self.rule_log = catalogs.RuleLog(spark, f"file://{self.home.resolve()}/rules", system_id)
        self.log_path = f"file://{self.home.resolve()}/log"
        self.generated: codegen.Generated | None = None

    def _timed(self, stage: str, **fields):
        """A record of the run log for a stage."""
        return runlog.timed(self.spark, self.log_path, stage, system_id=self.system_id, **fields)

    def analyse(
        self, root: str | None = None, sources: DataFrame | None = None, *, by_type: bool = False, dependencies: DataFrame | None = None, cache: str | None = None, parser: list[str] | None = None, timeout: float = 120.0
    ) -> sy.System:
        """From a folder, or from (file, content) rows.

        With ``cache``, a folder, only files whose contents it lacks are read again,
        first by ``parser``, an external command, if there is one, then by the own
        reader. ``by_type`` resolves calls by their receivers' types, ``dependencies``
        (source, target, label) are edges that no source text shows.
        """
        with self._timed("analyse", source=root) as details:
            sources = sources if sources is not None else read_sources(self.spark, root)
            if cache or parser:
                old = None
                if cache and exists(self.spark, cache):
                    old = self.spark.read.schema(ast.SCHEMA).parquet(cache).dropDuplicates(ast.KEYS)
                documents = cut(ast.acquire(sources, PARSER_VERSION, old, parser, timeout))
                if cache:
                    ast.store(documents.where("origin <> 'cache' AND status <> 'FAILED'"), cache)
                details |= {f"files_{r.origin}": str(r["count"]) for r in documents.groupBy("origin").count().collect()}
                extracted = ast.entities(documents)
            else:
                extracted = extract(sources)
            self.system = sy.build(extracted, by_type)
            self.dependencies, self.flow_table = dependencies, None
            self._draw()
            details |= {"nodes": str(self.nodes.count()), "edges": str(self.edges.count())}
        return self.system

    def _draw(self) -> None:
        self.nodes, self.edges = sy.graph(self.system, self.flow_table, self.dependencies)
        self._hubs, self._clusters = None, {}

    def clusters(self, method: str = "auto") -> tuple[DataFrame, str]:
        """Computed once for each analysis and method; the members are in ``self.members``."""
        if method not in self._clusters:
            structural = self.nodes.where(F.col("kind").isin("FILE", "COMPONENT", "PROCEDURE", "SQL", "TABLE", "VIEW", "DBPROC", "ENTRY"))
            members, used = graph.communities(structural, graph.admit(self.edges, structural), method)
            members = cut(members)
            stats = graph.cluster_stats(members, self.edges)
            degree = graph.node_degree(self.nodes, self.edges).select(F.col("id").alias("node"), "degree").join(self.nodes.select(F.col("id").alias("node"), "label"), "node")
            self._clusters[method] = members, cut(stats.join(graph.cluster_labels(members, degree), "root", "left")), used
        self.members, stats, used = self._clusters[method]
        return stats, used

    def _some_clusters(self) -> None:
        """Those of the last clustering; connected components if there was none."""
        if not self._clusters:
            self.clusters("components")

    def hubs(self) -> DataFrame:
        """Computed once for each analysis."""
        if self._hubs is None:
            central = graph.degree_centrality(self.nodes, self.edges)
            self.between = cut(betweenness(self.nodes, self.edges))
            self._hubs = cut(graph.hubs(central, ["COMPONENT", "PROCEDURE", "TABLE", "VIEW", "DBPROC"], self.between))
        return self._hubs

    def slices(self, depth: int = 5) -> tuple[DataFrame, DataFrame]:
        """Of every entry point at once: its summary, and (entry, id, distance) of its nodes."""
        with self._timed("slices"):
            starts = self.nodes.where("kind = 'ENTRY'").select(F.col("id").alias("entry"), "id")
            reached = cut(slices.reach_all(graph.flow_edges(self.nodes, self.edges), starts, depth))
            texts = self.system.procedures.where("body <> ''").select("id", text.token_estimate("body").alias("tokens"))
            self._some_clusters()
            return cut(slices.summaries(reached, self.nodes, depth, texts, self.members)), reached

    def flows(self, depth: int = 5) -> DataFrame:
        """The slice of each entry becomes a FLOW node of the graph, which depends on what it contains: (id, name, entry, node_ids)."""
        _, reached = self.slices(depth)
        names = self.nodes.select(F.col("id").alias("entry"), F.col("label").alias("name"))
        ids = reached.groupBy("entry").agg(F.array_sort(F.collect_list("id")).alias("node_ids"), (F.max("distance") == depth).alias("truncated"))
        flows = ids.join(names, "entry").select(F.concat(F.lit("FLOW-"), text.slug_unicode("name")).alias("id"), "name", "entry", "node_ids", "truncated", F.lit(depth).alias("depth"))
        self.flow_table = cut(graph.keep_first(flows, ["id"], "entry"))
        self._draw()
        return self.flow_table

    def slice(self, entry: str, depth: int = 5) -> dict:
        """The bounded flow from an entry: its row, nodes with distance, edges, redacted fragments, hubs, clusters and rules."""
        with self._timed("slice", source=entry):
            start = sy.resolve_entry(self.nodes, entry)
            followed = cut(graph.flow_edges(self.nodes, self.edges))
            reached = cut(graph.reach(followed, self.spark.createDataFrame([(start,)], "id string"), depth))
            t = graph.truncated(reached, depth).first()
            kept, hubs = graph.induced(self.edges, reached), self.hubs()
            parts = sy.fragments(self.system, reached)
            self._some_clusters()
            seen, away = hubs.join(reached.select("id"), "id", "left_semi"), hubs.join(reached.select("id"), "id", "left_anti")
            kinds = reached.join(self.nodes.select("id", "kind"), "id")
            listed = lambda *names: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*names), F.col("id"))))
            ids = kinds.agg(listed("PROCEDURE").alias("procedure_ids"), listed("SQL").alias("sql_ids"), listed("TABLE", "VIEW", "DBPROC").alias("database_object_ids")).first()
            tokens = parts.agg(F.coalesce(F.sum(text.token_estimate(redact("text"))), F.lit(0))).first()[0]
            clusters = graph.contained(self.members, reached)
            warnings = ["more may lie beyond the bound"] * t.truncated
            names = [r.label for r in seen.orderBy("rank").limit(20).collect()]
            warnings += [f"goes through hubs: {', '.join(names)}"] if names else []
            flow = {"flow_id": f"FLOW-{slug_text(entry)}", "entry": start, "depth": depth, "truncated": t.truncated, "n_nodes": t.n_nodes, **ids.asDict()}
            flow |= {"cluster_ids": sorted(r.root for r in clusters.collect()), "context_token_estimate": int(tokens), "warnings": warnings}
            touched = rules.touches(self.catalog(), reached)
            return {"flow": flow, "nodes": reached, "edges": kept, "fragments": parts, "hubs": seen, "excluded_hubs": away, "clusters": clusters, "rules": touched}

    def write_slice(self, found: dict) -> str:
        path = str(self.home / f"{found['flow']['flow_id']}.json")
        Path(path).write_text(exports.slice_json(found["flow"], found["nodes"], found["edges"], found["fragments"]).first().value)
        return path

    def read_slice(self, path: str) -> dict:
        return json.loads(Path(path).read_text())

    def extract_rules(self, found: dict) -> tuple[DataFrame, DataFrame]:
        """Candidates of a slice go into the catalog if it lacks them; the second result has what was rejected and why."""
        flow = found["flow"]["flow_id"]
        hubs = [r.id for r in found["hubs"].orderBy("rank").limit(1).collect()]
        procedures = [r.id for r in found["nodes"].where("id LIKE 'PROC-%'").limit(1).collect()]
        context = found["fragments"].withColumn("text", redact("text"))
        got = rules.read_rules(context.select("fragment", "procedure", "text"))
        got = got.join(context.select("fragment", "file", "line", F.array("procedure").alias("procedures")), "fragment", "left")
        got = got.withColumns({"flow": F.lit(rules.domain_key(flow, hubs, procedures)), "seq": F.coalesce("line_no", F.lit(1 << 30)), "flow_id": F.lit(flow), "entry_point_id": F.lit(found["flow"]["entry"])})
        admitted = cut(rules.admit(got))
        self.rule_log.add(admitted.where("reason IS NULL"))
        return self.catalog(), admitted.where("reason IS NOT NULL").select("flow", "ordinal", "name", "reason")

    def catalog(self) -> DataFrame:
        return self.rule_log.rules()

    def export_catalog(self, path: str | None = None) -> str:
        """The catalog as a YAML file for people; it is sorted by id."""
        path = path or str(self.home / "rules.yaml")
        catalogs.save_rules(self.catalog(), path, self.system_id)
        return path

    def import_catalog(self, path: str) -> None:
        """Adds the rules of a YAML file that the catalog lacks, with their reviews."""
        self.rule_log.add(catalogs.load_rules(self.spark, path, self.system_id))

    def review(self, rule: str, decision: str, reviewer: str | None = None, note: str | None = None) -> DataFrame:
        """By id, or by a name that only one rule has."""
        cat = self.catalog()
        ids = [r.rule_id for r in cat.where(F.col("rule_id") == rule).limit(2).collect()] or [r.rule_id for r in cat.where(F.col("name") == rule).limit(2).collect()]
        if len(ids) != 1:
            raise LookupError(f"{'no rule answers' if not ids else 'several rules answer'} to {rule!r}")
        at = datetime.now(timezone.utc).isoformat(timespec="microseconds")
        self.rule_log.decide(self.spark.createDataFrame([(ids[0], decision, reviewer, at, note)], catalogs.DECISION_SCHEMA))
        return self.catalog()

    def review_all(self, decision: str, reviewer: str) -> DataFrame:
        at = datetime.now(timezone.utc).isoformat(timespec="microseconds")
        null = F.lit(None).cast("string")
        self.rule_log.decide(self.catalog().where("status = 'candidate'").select("rule_id", F.lit(decision).alias("decision"), F.lit(reviewer).cast("string").alias("reviewer"), F.lit(at).alias("at"), null.alias("note")))
        return self.catalog()

    def contract(self) -> str:
        entries = self.system.entry_points.select(F.col("id").alias("entry_point_id"), "kind")
        cat = self.catalog()
        ops = contract.operations(cat, entries)
        places = F.when(F.col("file").isNotNull(), F.array(F.concat_ws(":", "file", F.col("line").cast("string")))).otherwise(F.array().cast("array<string>"))
        ops = ops.withColumn("description", contract.description(F.coalesce("description", "name"), F.col("rule_id"), F.coalesce("procedures", F.array().cast("array<string>")), places, F.col("behavior_type"))).withColumn("fields", contract.fields(F.col("expression"), F.coalesce("fields", F.array().cast("array<string>"))))
        states = self.system.transitions.select(F.explode(F.array("from_state", "to_state")).alias("name")).where("name <> 'UNKNOWN'").distinct()
        outs = self.system.objects.where((F.col("kind") == "DBPROC") & (F.size("out_params") > 0)).select(F.col("name").alias("title"), F.col("out_params").alias("parameters"))
        path = self.home / "openapi.yaml"
        path.write_text(yaml.safe_dump(contract.openapi(self.system_id, ops, states, outs), sort_keys=False, allow_unicode=True))
        return str(path)

    def verify(self, cases_path: str, answer=None, traces=None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Results, divergence records and totals.

        ``answer`` maps (cases, rules) to (case_id, rule_id, got), the rule simulator by
        default; ``traces`` maps cases to (case_id, trace), the states that the new system
        went through: without it recorded traces are not compared.
        """
        cases = cut(catalogs.load_cases(self.spark, cases_path))
        valid = self.catalog().where("status = 'validated'")
        got = cut((answer or rules.simulate)(cases, valid).withColumnRenamed("rule_id", "key"))
        wanted = cases.withColumn("w", F.when(F.size("legacy_output") > 0, F.col("legacy_output")).otherwise(F.col("expected")))
        keyed = F.forall(F.map_keys("w"), lambda k: k.startswith("RULE-") | k.startswith("HUB-")) & (F.size("w") > 0)
        rows = lambda df: df.select("case_id", F.explode("w").alias("key", "want"))
        compared = verify.compare_rules(rows(wanted.where(keyed)), got).unionByName(verify.compare_payload(rows(wanted.where(~keyed)), got))
        if traces:
            recorded = cases.where(F.size("state_trace") > 0).select("case_id", F.col("state_trace").alias("trace"))
            compared = compared.unionByName(verify.compare_traces(recorded, traces(cases)).drop("n_common", "first"))
        compared = cut(compared)
        results = verify.case_status(compared)
        # a case with a state trace only says nothing that is compared
        silent = cases.join(results, "case_id", "left_anti").select("case_id", *[F.lit(0).cast("long").alias(c) for c in ("n_match", "n_divergence", "n_undecidable")], F.lit("SKIPPED").alias("status"))
        results = cut(results.unionByName(silent))
        failed = compared.join(results.where("status = 'FAILED'").select("case_id"), "case_id", "left_semi")
        records = cut(verify.divergence_records(failed, cases, valid.select("rule_id", "file", "line")))
        return results, records, verify.totals(results, records)

    def report(self, verified: tuple | None = None) -> str:
        stats, used = self.clusters()
        parts = [report.system_report(self.system, self.nodes, self.catalog()), report.graph_report(self.nodes, self.edges, stats, self.hubs(), used)]
        if verified:
            parts.append(report.verification_report(*verified))
        catalog, made = self.catalog(), self.home / "openapi.yaml"
        parts.append(report.traceability(catalog))
        parts.insert(0, report.summary_line(catalog, verified, str(made) if made.exists() else None, self.generated.summary() if self.generated else None))
        if verified:
            (self.home / "divergences.md").write_text(report.divergence_report(self.system_id, verified[1]) + "\n")
        # a report shows the first rows of long tables; whole they lie beside it
        tables = {"clusters": (stats, "idx"), "hubs": (self.hubs(), "rank"), "rules": (catalog, "rule_id")}
        if verified:
            tables |= {"results": (verified[0], "case_id"), "divergences": (verified[1], "divergence_id")}
        for name, (df, order) in tables.items():
            exports.write_csv(df, f"file://{self.home.resolve()}/report/{name}", order)
        path = self.home / "report.md"
        path.write_text("\n\n".join(parts) + "\n")
        return str(path)

    def annotated(self) -> DataFrame:
        """Nodes with cluster, degree, centrality and betweenness."""
        self.clusters()
        self.hubs()
        central = graph.degree_centrality(self.nodes, self.edges).select("id", F.col("centrality").alias("degree_centrality"))
        degree = graph.node_degree(self.nodes, self.edges).select("id", "degree")
        nodes = graph.with_clusters(self.nodes, self.members).join(degree, "id", "left").join(central, "id", "left").join(self.between, "id", "left")
        return cut(nodes.select("id", "kind", "label", "file", "line", "cluster_id", "degree", "degree_centrality", "betweenness"))

    def export(self) -> list[str]:
        with self._timed("export"):
            edges = self.edges.select("id", "kind", "source", "target", "label", "via", "confidence")
            return exports.export(self.annotated(), edges, f"file://{self.home.resolve()}/graph")

    def export_sqlite(self, path: str | None = None) -> str:
        """Nodes with their clusters, edges, clusters, hubs and flows as one SQLite file."""
        stats, used = self.clusters()
        giant = F.when(F.col("is_giant"), "one cluster holds over half of the nodes")
        clusters = stats.select(F.col("root").alias("id"), F.lit(used).alias("algorithm"), "idx", "size", "share", "cohesion", "label", "is_giant", giant.alias("warning"))
        reason = F.concat(F.col("links").cast("string"), F.lit(" links, at least "), F.lit(f"{graph.HUB_RATIO:.0%}"), F.lit(" of the most"))
        hubs = self.hubs().select(F.col("hub_id").alias("id"), F.col("label").alias("name"), F.col("links").alias("degree"), F.col("centrality").alias("degree_centrality"), "betweenness", reason.alias("reason"))
        flows = None
        if self.flow_table is not None:
            of = lambda prefix: F.filter("node_ids", lambda x: x.startswith(prefix))
            flows = self.flow_table.select("id", "name", F.col("entry").alias("entry_point_id"), "depth", "truncated", of("PROC-").alias("procedure_ids"), of("SQL-").alias("sql_ids"))
        meta = self.spark.createDataFrame([("system_id", self.system_id), ("algorithm", used)], "key string, value string")
        return sqlite.write_sqlite(path or self.home / "graph.db", nodes=self.annotated(), edges=self.edges, clusters=clusters, hubs=hubs, meta=meta, **({"flows": flows} if flows is not None else {}))

    def generate_code(self, package: str = "legacy.contract", compile_it: bool = False, runner=codegen.run, command: str = "openapi-generator-cli", timeout: int = 900) -> codegen.Generated:
        """A project from the contract, by a generator that must be installed."""
        try:
            self.generated = codegen.generate(self.home / "openapi.yaml", self.home / "generated", package, timeout, runner, generator=command)
            return codegen.compile_java(self.generated, runner=runner) if compile_it else self.generated
        except codegen.CodegenError as e:
            raise NotAvailable(str(e)) from e
