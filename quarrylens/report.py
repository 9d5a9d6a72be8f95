"""Markdown reports from aggregated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTHING = "_none_"


def cell(x) -> str:
    if x is None:
        return ""
    text = ", ".join(map(str, x)) if isinstance(x, (list, tuple)) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return text.replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, *columns: str, most: int = 500) -> str:
    """A table of the given columns; what goes beyond ``most`` rows is counted, not hidden."""
    cols = list(columns) or df.columns
    rows = df.select(*cols).limit(most + 1).collect()
    if not rows:
        return NOTHING
    lines = ["| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols)] + ["| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"\n_{df.count() - most} more rows_")
    return "\n".join(lines)


def graph_report(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, hubs: DataFrame, method: str) -> str:
    by_kind = lambda df: df.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")
    giant = clusters.where("is_giant").count()
    return "\n\n".join(
        ["# Graph", "## Nodes", markdown_table(by_kind(nodes)), "## Edges", markdown_table(by_kind(edges)), f"## Clusters ({method})", markdown_table(clusters.orderBy("idx")), "One cluster holds over half of the nodes." if giant == 1 else "No cluster dominates.", "## Hubs", markdown_table(hubs.orderBy("rank"))]
    )


def rules_report(rules: DataFrame) -> str:
    counts = rules.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")
    return "\n\n".join(["# Rules", markdown_table(counts), markdown_table(rules.orderBy("rule_id"), "rule_id", "status", "confidence", "name", "expression", "behavior_type", "file", "line")])


def verification_report(results: DataFrame, records: DataFrame, totals: DataFrame) -> str:
    t = totals.first()
    verdict = "fine" if t.ok_strict else "not fine"
    return "\n\n".join(["# Verification", f"{t.passed} passed, {t.failed} failed, {t.skipped} skipped, {t.blocking} blocking: {verdict}.", markdown_table(results.orderBy("case_id"), "case_id", "status", "n_match", "n_divergence", "n_undecidable"), "## Divergences", markdown_table(records.orderBy("divergence_id"), "divergence_id", "rule_id", "status", "summary", "source", "blocking")])


def divergence_report(system_id: str, records: DataFrame, most: int = 1000) -> str:
    """A block for each divergence, with rule, flow, both answers and source; what goes beyond ``most`` is counted."""
    n, blocking = records.agg(F.count("*"), F.count_if("blocking")).first()
    parts = ["# Divergences", f"System `{system_id}`: {n} divergences, {blocking} of them blocking."]
    if not n:
        parts.append("Every case that could be decided agrees; cases that could not be decided say nothing.")
    for r in records.orderBy("divergence_id").limit(most).collect():
        x = r.asDict()
        say = lambda name, empty: cell(x.get(name)) or empty
        rows = (("Rule", say("rule_id", "none known")), ("Flow", say("flow_id", "none known")), ("Legacy", say("legacy", "not recorded")), ("New system", say("new_system", "no answer")), ("Source", say("source", "not recorded")), ("Status", say("status", "") + ("" if x["blocking"] else ", advisory")))
        parts.append("\n".join([f"## {x['divergence_id']}", "", *(f"- {k}: `{v}`" for k, v in rows), "", f"> {cell(x['summary'])}"]))
    if n > most:
        parts.append(f"_{n - most} more divergences_")
    return "\n\n".join(parts)


def traceability(rules: DataFrame) -> str:
    """Where each rule comes from, and whether the contract carries it."""
    place = F.when(F.coalesce("file", F.lit("")) != "", F.concat_ws(":", "file", F.col("line").cast("string"))).otherwise("unknown")
    inside = F.when(F.col("status") == "validated", "yes").otherwise("not in the contract")
    return "\n\n".join(["## From rule to source", markdown_table(rules.select("rule_id", "status", place.alias("source"), inside.alias("endpoint")).orderBy("rule_id"))])


def summary_line(rules: DataFrame, verified: tuple | None, contract: str | None, code: str | None) -> str:
    """What was done and what was not, so that silence is never taken for success."""
    n = {r.status: r.n for r in rules.groupBy("status").agg(F.count("*").alias("n")).collect()}
    t = verified[2].first() if verified else None
    checked = f"{t.passed} cases passed, {t.failed} failed, {t.skipped} skipped" if t else "verification was not run"
    return f"{sum(n.values())} rules, {n.get('validated', 0)} validated; contract: {contract or 'not made'}; code: {code or 'not generated'}; {checked}."


def system_report(system, nodes: DataFrame, rules: DataFrame | None = None) -> str:
    count = lambda df: df.count()
    parts = ["# System", "\n".join(f"- {k}: {count(df)}" for k, df in (("files", system.files), ("components", system.components), ("procedures", system.procedures), ("calls", system.calls), ("statements", system.statements), ("database objects", system.objects), ("state transitions", system.transitions), ("entry points", system.entry_points), ("nodes", nodes)))]
    parts += ["## Files that could not be read in full", markdown_table(system.files.where("status <> 'OK'").orderBy("file"), "file", "status", "diagnostics"), "## Database objects", markdown_table(system.objects.orderBy("id"), "id", "kind", "status", "called_by"), "## State transitions", markdown_table(system.transitions.orderBy("domain", "from_state", "to_state", "trigger"), "domain", "from_state", "to_state", "trigger", "evidence")]
    if rules is not None:
        parts.append(rules_report(rules))
    return "\n\n".join(parts)
