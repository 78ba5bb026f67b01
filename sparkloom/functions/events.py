"""Event logs as people read them: feed items, one-line summaries and notifications of JSON event payloads.

Payloads are variants; a field that is missing reads as an empty text, so no event is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import compact_number, rounded

# Event type, kind and label of its feed item, and what its message is made of (fields in braces).
FEED = [
    ("mission_error", "error", "{code}", "{message}"),
    ("agent_status", "agent", "AGENT", "{agentType} → {status}"),
    ("agent_output", "agent", "AGENT", "{message}"),
    ("scan_started", "scan", "SCAN", "supply chain scan started ({profile})"),
    ("scan_completed", "scan", "SCAN", "scan complete: {summary.totalFindings} findings"),
    ("scan_finding", "scan", "FINDING", "{finding.severity}: {finding.packageName}@{finding.version}"),
    ("mission_started", "event", "START", "mission started"),
    ("mission_completed", "event", "DONE", "mission {finalState}"),
    ("mission_log", "log", "{phase}", "{message}"),
    ("quota_update", "event", "QUOTA", "{providerId}: {status}"),
    ("quota_exhausted", "error", "QUOTA", "{providerId} exhausted"),
]
# Event types and their summary.
SUMMARY = [
    ("agent_status", "{agentType} {agentId} -> {status}"),
    ("agent_output", "{agentType} {agentId} {eventType}: {message}"),
    ("milestone_progress", "{milestoneId} -> {status} ({completedUnits}/{totalUnits})"),
    ("mission_log", "[{phase}] {message}"),
    ("mission_error", "{code}: {message}"),
    ("mission_status", "{status}"),
    ("mission_started", "{missionId}"),
    ("mission_queued", "{missionId}"),
    ("mission_completed", "{missionId}"),
    ("cost_update", "{missionId}"),
    ("escalation", "{missionId}"),
    ("milestones_set", "{missionId}"),
    ("scan_started", "{missionId}"),
    ("scan_completed", "{missionId}"),
    ("scan_finding", "{missionId}"),
    ("mutation_progress", "{repoName}: {line}"),
    ("quota_update", "{providerId} {status}"),
    ("quota_exhausted", "{providerId} resets {windowResetsAt}"),
]


def field(payload: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(payload, f"$.{path}", "string"), F.lit(""))


def filled(pattern: str, payload: Column) -> Column:
    """A pattern with its fields read from the payload."""
    parts = []
    for i, text in enumerate(pattern.replace("{", "}").split("}")):
        if text:
            parts.append(field(payload, text) if i % 2 else F.lit(text))
    return F.concat(*parts)


def spoken(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def feed(events: DataFrame) -> DataFrame:
    """type, payload and all other columns, with kind, label and message of each event's feed item."""
    t, p = F.col("type"), F.col("payload")
    money = F.format_string("$%.2f", rounded(F.coalesce(F.try_variant_get(p, "$.totalCost", "double"), F.lit(0.0)), 2))
    tokens = compact_number(F.coalesce(F.try_variant_get(p, "$.totalTokens", "double"), F.lit(0.0)))
    kind, label, message = F.when(t == "cost_update", "cost"), F.when(t == "cost_update", "COST"), F.when(t == "cost_update", F.concat(money, F.lit(" · "), tokens, F.lit(" tokens")))
    for name, a, b, c in FEED:
        said = filled(c, p)
        kind = kind.when(t == name, a)
        label = label.when((t == name) & (F.lit(name) == "agent_output") & (field(p, "eventType") == "tool_call"), "TOOL").when(t == name, F.upper(spoken(filled(b, p)) if "{code}" in b else filled(b, p)))
        message = message.when(t == name, spoken(said) if name == "agent_status" else said)
    return events.withColumns({"kind": kind.otherwise("event"), "label": label.otherwise(F.upper(t)), "message": message.otherwise(spoken(t))})


def summary(kind: Column, payload: Column) -> Column:
    """One line for an event; a type that is not known is named in angle brackets."""
    out = F.when(F.lit(False), "")
    for name, pattern in SUMMARY:
        out = out.when(kind == name, filled(pattern, payload))
    return out.otherwise(F.concat(F.lit("<"), F.coalesce(kind, F.lit("")), F.lit(">")))


def notifications(events: DataFrame) -> DataFrame:
    """mission_id, notice and body, one row for each mission and notice; of repeated ones the first by seq."""
    p = F.col("payload")
    done = field(p, "finalState") == "completed"
    notice = F.when(F.col("type") == "escalation", "escalation").when((F.col("type") == "mission_completed") & done, "completed").when(F.col("type") == "mission_completed", "failed")
    told = events.select("seq", field(p, "missionId").alias("mission_id"), notice.alias("notice")).where("notice is not null")
    first = told.groupBy("mission_id", "notice").agg(F.min("seq").alias("seq"))
    ends = F.when(F.col("notice") == "escalation", "… needs your decision").when(F.col("notice") == "completed", "… finished successfully").otherwise("… has failed")
    return first.withColumn("body", F.concat(F.lit("Mission "), F.substring("mission_id", 1, 8), ends))
