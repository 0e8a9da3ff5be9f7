"""Typed records: what each type's fields are, and checks of rows against them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A line per type, "name: field flags [= default] [in a|b|c], ..".
# Flags: * filterable, ~ searchable, ? may be null, # number, ! boolean.
DECLARED = """
agent.task_state: task_id*, status* in pending|active|blocked|done|failed, step# = 0, plan_summary~ =, blocked_by*?, parent_task_id*?
agent.tool_call: task_id*, tool_name*, args =, result_summary~ =, success*! = true, latency_ms# = 0, error_type*?
agent.observation: task_id*, source* in tool|user|env|internal, content~, confidence# = 1.0, supersedes?
agent.decision: task_id*, choice~, alternatives =, rationale~ =
code.decision: scope*~, decision~, rationale~ =, alternatives =, files_affected =, decided_by* =, decided_at =, revisit_after?
code.pattern: name*~, language* =, example_code =, when_to_use~ =, when_not_to_use~ =, files_using =
code.incident: title~, severity* in p0|p1|p2|p3, root_cause~ =, fix_summary~ =, commit* =, files_affected =, prevention =
code.dependency_note: package*~, note~, version* =, risk* = low in low|medium|high|critical, upgrade_blocked_by~?
collab.action_item: assignee*~, description~, status* = open in open|done|dropped, due_date =, meeting_id* =, context~ =
collab.decision: topic~, decision~, participants =, meeting_id* =, dissent~ =, revisit_date?
collab.follow_up: from_meeting*, to_meeting*, topic~, status* = pending in pending|addressed|dropped
collab.stakeholder_position: person*~, topic*~, position~, last_expressed =, confidence# = 0.5
conv.fact: subject*~, predicate~, object~, confidence# = 1.0, source_turn_id*?, category* = other in identity|preference|relationship|goal|location|other
conv.preference: user_id*, domain*~, preference~, strength# = 0.5, last_confirmed =
conv.contradiction: fact_a_id*, fact_b_id*, resolution~?, resolved_at?
creative.character: name*~, project* =, traits~ =, relationships~ =, arc~ =, last_appearance =
creative.world_detail: project*, category* in geography|politics|magic_system|technology|culture|history, detail~, canonical*! = true, introduced_in =
creative.continuity: project*, assertion~, source* =, contradicted_by*?
creative.plot_thread: project*, thread~, status* = planted in planted|developing|resolved|abandoned, introduced_in =, resolved_in?
customer.profile: customer_id*, name~, company*~ =, tier* = free in free|pro|enterprise, first_seen =, last_contact =
customer.issue: customer_id*, category*~, description~, status* = open in open|resolved|escalated, resolution~ =, resolved_at?
customer.sentiment: customer_id*, score#, signal~, channel* in support|email|social|call
customer.preference: customer_id*, domain*~, preference~, source* = explicit in explicit|inferred
km.note: title~, source* = manual in manual|extracted|imported, tags* =, project*?, url?
km.connection: from_id*, to_id*, relationship* in supports|contradicts|extends|depends_on|related, strength# = 0.5
km.question: question_text~, status* = open in open|answered|stale, answer_id*?, asked_by =, context~ =
km.insight: claim~, supporting_evidence =, confidence# = 0.5, domain* =, derived_from* = observation in synthesis|observation|external
research.hypothesis: claim~, status* = proposed in proposed|testing|confirmed|refuted|inconclusive, confidence# = 0.5, domain*~ =, depends_on?
research.experiment: hypothesis_id*, method~, parameters =, status* = planned in planned|running|complete|failed, started_at =, completed_at?
research.result: experiment_id*, outcome* in pass|fail|ambiguous, key_metrics~ =, interpretation~ =, surprises~ =
research.literature: title~, authors~ =, year# = 0, key_claim~ =, relevance~ =, doi*?
"""


@dataclass
class Field:
    name: str
    kind: str = "string"
    filterable: bool = False
    searchable: bool = False
    nullable: bool = False
    default: str | None = None
    choices: list[str] = field(default_factory=list)

    @property
    def required(self) -> bool:
        return self.default is None and not self.nullable


_REGISTRY: dict[str, list[Field]] = {}


def register(name: str, fields: list[Field]) -> None:
    """Add a type; a name can be taken once only."""
    if name in _REGISTRY:
        raise ValueError(f"type {name} exists")
    _REGISTRY[name] = fields


def _declare(line: str) -> None:
    name, _, rest = line.partition(": ")
    fields = []
    for part in rest.split(", "):
        part, _, choices = part.partition(" in ")
        mark, eq, default = part.partition(" =")
        base = mark.rstrip("*~?#!")
        flags = mark[len(base) :]
        kind = "double" if "#" in flags else "boolean" if "!" in flags else "string"
        fields.append(Field(base, kind, "*" in flags, "~" in flags, "?" in flags, default.strip() if eq else None, choices.split("|") if choices else []))
    register(name, fields)


for _line in DECLARED.strip().splitlines():
    _declare(_line)


def get(name: str) -> list[Field]:
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def struct(name: str) -> T.StructType:
    """The type as a Spark schema, its flags in the fields' metadata."""
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(f.name, kinds[f.kind], not f.required, {"filterable": f.filterable, "searchable": f.searchable, "choices": f.choices}) for f in get(name)])


def catalogue(spark) -> DataFrame:
    """One row per field of all types."""
    rows = [(n, i, f.name, f.kind, f.filterable, f.searchable, f.required, len(f.choices)) for n in names() for i, f in enumerate(get(n))]
    return spark.createDataFrame(rows, "type string, place int, field string, kind string, filterable boolean, searchable boolean, required boolean, choices int")


def violations(df: DataFrame, name: str) -> Column:
    """Names of the fields that break the type: required but null, or outside of the choices."""
    tests = []
    for f in get(name):
        bad = F.lit(False)
        if f.required:
            bad = bad | F.col(f.name).isNull()
        if f.choices:
            bad = bad | (F.col(f.name).isNotNull() & ~F.col(f.name).isin(*f.choices))
        tests.append(F.when(bad, F.lit(f.name)))
    return F.array_compact(F.array(*tests))


def search_text(name: str) -> Column:
    """The searchable fields joined by blanks; nulls are skipped, empty texts are not."""
    return F.concat_ws(" ", *(F.col(f.name).cast("string") for f in get(name) if f.searchable))


def to_metadata(name: str) -> Column:
    """JSON of the type's name and all fields that are not null."""
    return F.to_json(F.struct(F.lit(name).alias("type"), *(F.col(f.name) for f in get(name))))


def typed_filter(name: str, **wanted) -> dict:
    """A filter for ``compile_where``; only filterable fields and allowed choices."""
    fields = {f.name: f for f in get(name)}
    for k, v in wanted.items():
        if k not in fields or not fields[k].filterable:
            raise ValueError(f"{k} is not filterable in {name}")
        if fields[k].choices and v not in fields[k].choices:
            raise ValueError(f"{v!r} is no choice of {k}")
    return {"type": name, **wanted}


def any_violation(df: DataFrame, name: str) -> DataFrame:
    """Rows that break the type, with the reasons."""
    return df.withColumn("violations", violations(df, name)).where(F.size("violations") > 0)


def valid(df: DataFrame, name: str) -> bool:
    return any_violation(df, name).isEmpty()


