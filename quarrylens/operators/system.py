"""From extracted entities to a system of tables, and on to its graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.sqlfacts import facts
from quarrylens.functions.text import slug
from quarrylens.operators import graph as g
from quarrylens.operators.lineage import cut
from quarrylens.operators.model import infer_types, inferred_transitions, resolve_typed
from quarrylens.sources.vb6 import entity


@dataclass
class System:
    """The tables of one analysed system."""

    files: DataFrame
    components: DataFrame
    procedures: DataFrame
    variables: DataFrame
    calls: DataFrame
    statements: DataFrame
    objects: DataFrame
    transitions: DataFrame
    entry_points: DataFrame
    declarations: DataFrame


def _id(prefix: str, *parts: str):
    return F.concat_ws("-", F.lit(prefix), *[slug(p) for p in parts])


def build(extracted: DataFrame, by_type: bool = False) -> System:
    """All tables; the extraction is written down once. With ``by_type`` a call with a receiver goes to the procedure of its type first."""
    x = cut(extracted)
    files = entity(x, "file").select(_id("FILE", "file").alias("id"), "file", "sha256", "line_count", "status", "diagnostics")
    components = g.keep_first(entity(x, "component").withColumn("id", _id("CMP", "name")), ["id"], "file", "seq")
    accessor = F.when(F.col("kind").startswith("property_"), F.concat(F.lit("-"), F.upper(F.substring("kind", 10, 10)))).otherwise("")
    procedures = entity(x, "procedure").withColumn("id", F.concat(_id("PROC", "component", "name"), accessor))
    procedures = g.keep_first(procedures, ["id"], "file", "seq").withColumn("component_id", _id("CMP", "component"))
    calls = entity(x, "call").withColumn("caller_id", _id("PROC", "component", "procedure"))
    order = Window.partitionBy("caller_id", "line").orderBy("seq")
    calls = calls.withColumn("i", F.row_number().over(order) - 1).withColumn("id", F.concat_ws("-", F.lit("CALL"), "caller_id", slug("callee"), F.concat(F.lit("L"), "line"), "i"))
    calls = _resolve_by_type(calls, procedures, components, x) if by_type else _resolve(calls, procedures)
    sql = entity(x, "sql").withColumn("f", facts("text")).select("file", "seq", "component", "procedure", "text", "raw", "is_dynamic", "line", "state_tokens", "mentions_state_column", "domain", "f.*")
    sql = sql.withColumn("id", F.concat_ws("-", F.lit("SQL"), slug("file"), F.concat(F.lit("L"), "line"), F.substring(F.sha2("raw", 256), 1, 8))).withColumn("procedure_id", _id("PROC", "component", "procedure"))
    writes = entity(x, "state_write").withColumn("procedure_id", _id("PROC", "component", "procedure"))
    transitions = _transitions(writes, sql)
    entries = entity(x, "entry_point").withColumn("id", F.when(F.col("kind") == "FORM", _id("ENTRY", "name")).otherwise(F.concat_ws("-", _id("ENTRY", "name"), F.lit("P"))))
    entries = g.keep_first(entries.withColumns({"component_id": _id("CMP", "component"), "procedure_id": F.when(F.col("procedure").isNotNull(), _id("PROC", "component", "procedure"))}), ["id"], F.col("procedure").isNull(), "file", "seq")
    # an entry point of a component that is only declared is none
    entries = entries.join(components.select(F.col("id").alias("component_id")), "component_id", "left_semi")
    declared = entity(x, "declaration")
    # by the file's stem first, then by name
    by_stem = components.select(F.col("name").alias("by_stem"), F.lower(F.regexp_extract("file", r"([^/\\]+)[.][^.]+$", 1)).alias("k1"))
    by_name = components.select(F.col("name").alias("by_name"), F.lower("name").alias("k2"))
    declared = declared.join(by_stem, F.lower("stem") == F.col("k1"), "left").join(by_name, F.lower("component") == F.col("k2"), "left")
    declared = declared.select("file", "component", "kind", F.coalesce("by_stem", "by_name").alias("real"), F.coalesce("by_stem", "by_name").isNull().alias("orphan"))
    return System(files, components, procedures, entity(x, "variable"), calls, sql, _objects(sql, calls), transitions, entries, declared)


def _resolve(calls: DataFrame, procedures: DataFrame) -> DataFrame:
    names = procedures.where("NOT declared").groupBy(F.lower("name").alias("lname")).agg(F.countDistinct("id").alias("n"), F.min("id").alias("only"))
    j = calls.join(names, F.lower("callee") == F.col("lname"), "left")
    own = F.col("kind") != "EXTERNAL"
    return j.withColumns({"callee_id": F.when(own & (F.col("n") == 1), F.col("only")), "kind": F.when(own & (F.col("n") > 1), "UNRESOLVED").otherwise(F.col("kind"))}).drop("lname", "n", "only", "i")


def _resolve_by_type(calls: DataFrame, procedures: DataFrame, components: DataFrame, x: DataFrame) -> DataFrame:
    """Receivers are variables of the procedure, of its component, or public ones, in this order, or components by name."""
    c = F.col
    low = lambda *parts: F.concat_ws("|", *[F.lower(F.coalesce(p, F.lit(""))) for p in parts])
    none = F.lit("")
    spot = lambda scope: F.when(scope == "local", low(c("component"), c("procedure"), c("name"))).when(scope == "global", low(none, none, c("name"))).otherwise(low(c("component"), none, c("name")))
    leaf = lambda t: F.element_at(F.split(t, r"\."), -1)
    variables = entity(x, "variable").select(spot(c("scope")).alias("var"), leaf("type_name").alias("type"))
    given = procedures.select("component", c("name").alias("procedure"), F.explode("parameters").alias("p"))
    variables = variables.unionAll(given.select(low(c("component"), c("procedure"), c("p.name")), leaf("p.type_name")))
    variables = cut(variables.unionAll(components.select(low(none, none, c("name")), c("name"))))
    known = variables.select("var").distinct()

    def place(df: DataFrame, name: str, out: str) -> DataFrame:
        keys = (low(c("component"), c("procedure"), c(name)), low(c("component"), none, c(name)), low(none, none, c(name)))
        for i, key in enumerate(keys):
            df = df.join(known.select(c("var").alias(f"_{i}")), key == c(f"_{i}"), "left")
        return df.withColumn(out, F.when(c(name).isNotNull(), F.coalesce("_0", "_1", "_2", keys[0]))).drop("_0", "_1", "_2")

    sets = cut(place(place(entity(x, "assignment").withColumn("source", F.regexp_replace("source", r"(?i)^me\.", "")), "target", "var"), "source", "from"))
    declared = variables.unionAll(sets.where("type_name IS NOT NULL").select("var", leaf("type_name")))
    types = infer_types(declared, sets.where("source IS NOT NULL").select("var", c("from").alias("source")))
    asked = place(calls.select("id", "callee", "kind", "component", "procedure", F.regexp_replace("receiver", r"(?i)^me\.", "").alias("name")), "name", "receiver")
    got = resolve_typed(asked.select(c("id").alias("call_id"), "callee", "kind", "receiver"), procedures.where("NOT declared"), types)
    got = cut(got.select(c("call_id").alias("id"), "callee_id", F.when(c("kind") == "TYPED", "DYNAMIC").otherwise(c("kind")).alias("kind")))
    return calls.drop("kind", "i").join(got, "id")


def _objects(sql: DataFrame, calls: DataFrame) -> DataFrame:
    """Tables, views and stored procedures that statements name, each once, with the first place, the callers and out parameters."""
    place = F.struct("file", "line")
    one = lambda kind, name: sql.select(F.lit(kind).alias("kind"), F.explode(name).alias("name"), place.alias("place"), "procedure_id", (F.col("parse_status") == "OK").alias("ok"))
    seen = one("TABLE", F.col("tables")).unionByName(one("VIEW", F.col("views"))).unionByName(one("DBPROC", F.when(F.col("procedure_name").isNotNull(), F.array("procedure_name")).otherwise(F.array().cast("array<string>"))))
    # OUT and IN parameters are named in calls that register them, in the procedure of the statement
    args = calls.where(F.lower("callee").isin("registerout", "setin")).select("caller_id", F.lower("callee").alias("how"), F.explode(F.transform("arguments", lambda a: F.regexp_replace(a, '"', ""))).alias("arg")).where(F.col("arg").rlike("^P_[A-Z0-9_]+$"))
    args = args.groupBy("caller_id").agg(F.array_sort(F.collect_set(F.when(F.col("how") == "registerout", F.col("arg")))).alias("out_params"), F.array_sort(F.collect_set(F.when(F.col("how") == "setin", F.col("arg")))).alias("in_params"))
    seen = seen.join(args, F.col("procedure_id") == F.col("caller_id"), "left")
    per = seen.withColumn("id", F.concat_ws("-", "kind", slug("name"))).groupBy("id").agg(
        F.min_by("kind", "place").alias("kind"), F.min_by("name", "place").alias("name"), F.min("place").alias("first_seen"), F.when(F.bool_or("ok"), "OK").otherwise("PARTIAL").alias("status"),
        F.array_sort(F.collect_set("procedure_id")).alias("called_by"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("out_params")))).alias("out_params"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("in_params")))).alias("in_params"),
    )
    return per


def _transitions(writes: DataFrame, sql: DataFrame) -> DataFrame:
    """Each change of state once for each procedure: by writes, from one write to the next, by SQL that mentions a state's column."""
    c = F.col
    row = ["domain", "from_state", "to_state", F.concat_ws(".", "component", "procedure").alias("trigger"), "procedure_id", "file", "line", "seq"]
    kind = lambda evidence, n: [F.lit(evidence).alias("evidence"), F.lit(n).alias("n")]
    seen = writes.withColumns({"from_state": F.lit("UNKNOWN"), "to_state": c("value")}).select(*row, *kind("OBSERVATION", 0))
    guessed = inferred_transitions(writes, "procedure_id", ["line", "seq"]).select(*row, *kind("INFERENCE", 1))
    said = sql.where("mentions_state_column").withColumns({"from_state": F.lit("UNKNOWN"), "to_state": F.explode("state_tokens")}).select(*row, *kind("OBSERVATION", 2))
    kept = g.keep_first(seen.unionByName(guessed).unionByName(said), ["domain", "from_state", "to_state", "trigger"], "file", "n", "line", "seq")
    return kept.select("domain", "from_state", "to_state", "trigger", "procedure_id", F.concat_ws(":", "file", c("line").cast("string")).alias("source"), "evidence")


def any_node(s: System, wanted: DataFrame) -> DataFrame:
    """(ref, id) of references to a procedure, else a component, else a file, by id; what is none of them is left out."""
    out = wanted.select("ref").distinct()
    for i, table in enumerate((s.procedures, s.components, s.files)):
        ids = table.select(F.col("id").alias(f"id{i}")).distinct()
        out = out.join(ids, F.col("ref") == F.col(f"id{i}"), "left")
    return out.select("ref", F.coalesce("id0", "id1", "id2").alias("id")).where("id IS NOT NULL")


def graph(s: System, flows: DataFrame | None = None, dependencies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label, file, line) and admitted edges (id, kind, source, target, label, via, confidence).

    ``flows`` (id, name, node_ids) become nodes that depend on their members,
    ``dependencies`` (source, target, label) edges between procedures, components or files.
    """
    null = lambda t: F.lit(None).cast(t)
    node = lambda df, kind, label, file, line: df.select("id", F.lit(kind).alias("kind"), label.alias("label"), file.alias("file"), line.alias("line"))
    c = F.col
    parameters = s.procedures.select(c("id").alias("proc"), "file", "line", F.posexplode("parameters").alias("pos", "p")).withColumn("id", F.concat_ws("-", F.lit("PARAM"), "proc", slug(c("p.name"))))
    nodes = g.union(
        node(s.files, "FILE", c("file"), c("file"), null("int")),
        node(s.components, "COMPONENT", c("name"), c("file"), null("int")),
        node(s.procedures, "PROCEDURE", F.concat_ws(".", "component", "name"), c("file"), c("line")),
        node(parameters, "PARAMETER", c("p.name"), c("file"), c("line")),
        node(s.statements, "SQL", c("text"), c("file"), c("line")),
        s.objects.select("id", c("kind"), c("name").alias("label"), c("first_seen.file").alias("file"), c("first_seen.line").alias("line")),
        node(s.entry_points, "ENTRY", c("name"), c("file"), c("line")),
    )
    if flows is not None:
        nodes = g.union(nodes, node(flows, "FLOW", c("name"), null("string"), null("int")))
    nodes = cut(g.keep_first(nodes, ["id"], "kind", "file", "line"))
    edge = lambda df, kind, a, b, label="", via="", conf="OK": df.select(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), c(a).alias("source"), c(b).alias("target"), F.lit(label).alias("label"), F.lit(via).alias("via"), F.lit(conf).alias("confidence"))
    file_id = F.concat(F.lit("FILE-"), slug("file"))
    depends = s.components.select("id", F.explode("depends_on").alias("name")).join(s.components.select(F.lower("name").alias("k"), c("id").alias("target")), F.lower("name") == c("k")).where("id <> target")
    merged = s.calls.where("callee_id IS NOT NULL").groupBy("caller_id", "callee_id").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("via"), F.when(F.bool_and(c("kind") == "STATIC"), "OK").otherwise("PARTIAL").alias("confidence"))
    calls = merged.select(F.lit("CALLS").alias("kind"), c("caller_id").alias("source"), c("callee_id").alias("target"), F.lit("").alias("label"), "via", "confidence")
    objects = s.objects.select(c("id").alias("target"), F.upper("name").alias("k"), "kind")
    named = s.statements.select("id", "procedure_id", "operation", "access_mode", F.explode(F.array_distinct(F.concat("tables", "views", F.when(c("procedure_name").isNotNull(), F.array("procedure_name")).otherwise(F.array().cast("array<string>"))))).alias("name"))
    touches = named.join(objects, F.upper("name") == c("k"))
    verb = F.when(c("operation") == "CALL", "INVOKES").when(c("access_mode") == "WRITE", "WRITES").when(c("kind") == "VIEW", "QUERIES").otherwise("READS")
    edges = g.union(
        edge(s.components.withColumn("f", file_id), "CONTAINS", "f", "id"),
        edge(s.procedures, "CONTAINS", "component_id", "id"),
        edge(parameters, "HAS_PARAMETER", "proc", "id"),
        edge(depends, "DEPENDS_ON", "id", "target"),
        calls,
        edge(s.statements, "DEPENDS_ON", "procedure_id", "id", "executes"),
        touches.select(verb.alias("kind"), c("id").alias("source"), "target", F.lit("").alias("label"), F.lit("").alias("via"), F.lit("OK").alias("confidence")),
        edge(s.entry_points, "ENTRY_TO", "id", "component_id"),
        edge(s.entry_points.where("procedure_id IS NOT NULL"), "ENTRY_TO", "id", "procedure_id"),
    )
    if flows is not None:
        edges = g.union(edges, edge(flows.select("id", F.explode("node_ids").alias("member")).where("member <> id"), "DEPENDS_ON", "id", "member", "contains"))
    if dependencies is not None:
        known = any_node(s, dependencies.select(F.col("source").alias("ref")).unionAll(dependencies.select("target")))
        at = lambda end: known.select(c("ref").alias(end), c("id").alias(f"{end}_id"))
        ends = dependencies.join(at("source"), "source").join(at("target"), "target")
        edges = g.union(edges, ends.select(F.lit("DEPENDS_ON").alias("kind"), c("source_id").alias("source"), c("target_id").alias("target"), "label", F.lit("").alias("via"), F.lit("OK").alias("confidence")))
    edges = g.keep_first(edges, ["kind", "source", "target"], "via")
    edges = g.admit(edges, nodes).withColumn("id", F.concat_ws("-", F.lit("EDGE"), "kind", "source", "target"))
    return nodes, cut(edges)


class EntryNotFound(LookupError):
    """No entry point or several answer to a name."""


def resolve_entry(nodes: DataFrame, name: str) -> str:
    """The node that a name means: an entry's id or label, Component.Member, a procedure's bare name, any id. More than one is refused."""
    low = name.lower()
    label = F.lower("label")
    ladder = (
        F.lower("id") == low,
        (F.col("kind") == "ENTRY") & (label == low),
        (F.col("kind") == "PROCEDURE") & (label == low),
        (F.col("kind") == "PROCEDURE") & (F.element_at(F.split(label, r"\."), -1) == low),
    )
    for step in ladder:
        found = [r.id for r in nodes.where(step).select("id").orderBy("id").limit(2).collect()]
        if len(found) == 1:
            return found[0]
        if found:
            raise EntryNotFound(f"{name!r} is ambiguous: {', '.join(found)} and maybe more")
    raise EntryNotFound(f"nothing is called {name!r}")


def fragments(s: System, reached: DataFrame | None = None) -> DataFrame:
    """Bodies of the procedures in a slice, without one of all, in order: fragment, procedure, file, line, text."""
    bodies = (s.procedures if reached is None else s.procedures.join(reached.select("id"), "id", "left_semi")).where("body <> ''")
    return bodies.select(F.col("id").alias("fragment"), F.concat_ws(".", "component", "name").alias("procedure"), "file", "line", F.col("body").alias("text"))
