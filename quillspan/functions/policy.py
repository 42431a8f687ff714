"""Answering policy: budgets, clamps and states as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Effort -> (top_k, candidates, prefetch, claims for each chunk), and the largest top_k.
BUDGETS = {"brief": (4, 20, 50, 2), "standard": (8, 40, 50, 3), "thorough": (48, 120, 150, 4)}
FIELDS, MAX_TOP_K, DEFAULT_EFFORT = ("top_k", "candidates", "prefetch", "claims"), 96, "standard"
# Speech rates and the shortest billed second count.
CHARS_PER_SECOND, HIGH_FACTOR, MIN_BILLED_S = 14.5, 1.40, 15


def budget(effort: Column, field: str) -> Column:
    """A budget field of an effort; unknown efforts take the default's."""
    i = FIELDS.index(field)
    known = F.create_map(*[F.lit(x) for k, v in BUDGETS.items() for x in (k, v[i])])
    return F.coalesce(known[effort], F.lit(BUDGETS[DEFAULT_EFFORT][i]))


def clamp_top_k(asked: Column, default: Column) -> Column:
    """Requested number of results within bounds, else the budget's."""
    return F.greatest(F.lit(1), F.least(F.lit(MAX_TOP_K), F.coalesce(asked, default)))


def answer_state(evidence: Column, sufficient: Column, verified: Column) -> Column:
    """State of an answer from counts of evidence and verified citations."""
    return F.when(evidence == 0, "no_evidence").when(~sufficient, "insufficient").when(verified == 0, "no_verified_citation").otherwise("answered")


def transcription_usd(seconds: Column, rate: Column) -> Column:
    """Price of a recording, billed by the minute from 15 seconds on; null without a rate."""
    return F.when(rate > 0, F.greatest(F.lit(MIN_BILLED_S), seconds) / 60 * rate)


def projected_characters(seconds: Column, high: bool = False) -> Column:
    """Characters that speech of a duration is expected to give."""
    return (seconds * CHARS_PER_SECOND * (HIGH_FACTOR if high else 1.0)).cast("int")


def style_level(requested: Column, evidence: Column, supported: Column) -> Column:
    """Effort whose style an answer takes: the narrowest where the evidence, or what clears
    the dense floor, is less than that effort reads; else the one asked for."""
    floor = BUDGETS["brief"][0]
    thin = (evidence < floor) | (supported.isNotNull() & (supported < floor))
    return F.when(thin, "brief").otherwise(F.when(requested.isin(list(BUDGETS)), requested).otherwise(DEFAULT_EFFORT))


# Stage -> the cost stages charged in it, and artifact -> the stage that writes it.
COST_STAGES = {
    "learning": ["profile"], "correcting": ["correction"], "embedding": ["embedding"], "evaluating": ["evalset", "evaluation"], "tuning": ["tuning"],
    "semantics": ["semantics", "semantics-condense"], "replaying semantics": ["semantics-replay"], "transcribing": ["transcription"],
}
ARTIFACT_STAGES = {"captions": "probing", "transcription_result": "transcribing", "transcript": "grouping", "transcript_text": "grouping", "evidence": "extracting", "estimate": "previewing"}
ARTIFACT_OVERRIDES = {("video", "evidence"): "grouping", ("rebuild", "estimate"): "estimating"}


def _lookup(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def stage_of_cost(cost_stage: Column) -> Column:
    """Workflow stage that made a charge; null for a charge of no known stage."""
    return _lookup({c: s for s, costs in COST_STAGES.items() for c in costs}, cost_stage)


def stage_of_artifact(name: Column, run_kind: Column) -> Column:
    """Workflow stage that wrote an artifact: by the run's kind first, then by name."""
    special = _lookup({f"{k}/{n}": s for (k, n), s in ARTIFACT_OVERRIDES.items()}, F.concat(run_kind, F.lit("/"), name))
    return F.coalesce(special, _lookup(ARTIFACT_STAGES, name))


def stage_order(stage: Column, stages: list[str]) -> Column:
    """Place of a stage among ``stages`` from 0; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, stages)), stage)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(stages)).otherwise(at - 1).cast("int")


def run_kind(override: Column, reindex: Column) -> Column:
    """Kind of an import's run: the override, or whether it indexes anew."""
    return F.coalesce(F.nullif(override, F.lit("")), F.when(reindex, "reindex").otherwise("index"))


def corrects_by_default(caption_kind: Column) -> Column:
    """Whether correction starts ticked: only automatic captions lack punctuation."""
    return F.coalesce(caption_kind == "auto", F.lit(False))


def compose_system(rules: Column, precedence: str, style: Column) -> Column:
    """Rules, the sentence that they win, and the style, by blank lines; the rules alone without a style."""
    trimmed = F.regexp_replace(F.coalesce(style, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", rules).otherwise(F.concat_ws("\n\n", rules, F.lit(precedence), trimmed))


# Fixed value: filter keys that a caller may set.
FILTER_KEYS = ("document_id", "version_id", "kind", "library_id")


def allowed_filter(asked: dict, library_id, tenant_id) -> dict:
    """Known keys of a filter; library and tenant are the server's, whatever was asked."""
    return {k: v for k, v in asked.items() if k in FILTER_KEYS} | {"library_id": library_id, "tenant_id": tenant_id}
