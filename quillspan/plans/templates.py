"""Named read templates: validated parameters, tenant scope and a row ceiling on every read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import graph as G
from quillspan.operators.catalog import clamp_limit

# Default ceiling, and the higher ones of bulk reads.
CEILING, CEILINGS = 200, {"document_limit": 1000, "concept_limit": 20_000, "claim_limit": 20_000, "mention_limit": 60_000}
KINDS = {"id": str, "string": str, "int": int, "float": float, "id_list": list}


@dataclass(frozen=True)
class Template:
    """A named plan over entity DataFrames, with typed parameters."""

    name: str
    params: dict[str, str]
    plan: Callable[[dict[str, DataFrame], dict], DataFrame]
    order: tuple[str, ...]
    limit: str = "limit"
    planner_visible: bool = True
    defaults: dict = field(default_factory=dict)


TEMPLATES: dict[str, Template] = {}


def register(t: Template) -> Template:
    """Add a template; it must be scoped by tenant, ordered, and typed throughout."""
    if "tenant_id" not in t.params or not t.order or set(t.params.values()) - set(KINDS):
        raise ValueError(f"template {t.name} needs tenant_id, an order and known types")
    TEMPLATES[t.name] = t
    return t


def bind(t: Template, args: dict) -> dict:
    """Coerced arguments with defaults; unknown, missing and mistyped ones are refused."""
    unknown, missing = set(args) - set(t.params) - {t.limit}, set(t.params) - set(args) - set(t.defaults)
    if unknown or missing:
        raise ValueError(f"{t.name}: unknown {sorted(unknown)}, missing {sorted(missing)}")
    out = {k: KINDS[kind](args.get(k, t.defaults.get(k))) for k, kind in t.params.items()}
    for k, kind in t.params.items():
        if kind == "id_list":
            out[k] = out[k][:CEILING]
    return out | {t.limit: clamp_limit(args.get(t.limit), CEILINGS.get(t.limit, CEILING))}


def run(name: str, entities: dict[str, DataFrame], **args) -> DataFrame:
    """Result of a template: every entity scoped to the tenant, ordered, cut at the ceiling.

    The ceiling is part of each template's meaning: reads for display.
    """
    t = TEMPLATES[name]
    bound = bind(t, args)
    scoped = {k: G.scoped(df, bound["tenant_id"]) for k, df in entities.items()}
    order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in t.order]
    return t.plan(scoped, bound).orderBy(*order).limit(bound[t.limit])


def catalogue() -> list[dict]:
    """Templates that a planner may choose from."""
    return [{"name": t.name, "params": t.params} for t in TEMPLATES.values() if t.planner_visible]


FLOOR = {"confidence_floor": G.CONFIDENCE_FLOOR}
_mentions = lambda e, p: e["mentions"].where(F.col("confidence") >= p["confidence_floor"])

register(Template("document_outline", {"version_id": "id", "tenant_id": "string"}, lambda e, p: e["sections"].where(F.col("version_id") == p["version_id"]), ("path",)))
register(Template("section_chunks", {"section_id": "id", "tenant_id": "string"}, lambda e, p: e["chunks"].where(F.col("section_id") == p["section_id"]), ("ordinal",)))
register(Template(
    "chunk_neighbours", {"chunk_id": "id", "tenant_id": "string"},
    lambda e, p: e["chunks"].alias("c").join(e["chunks"].where(F.col("chunk_id") == p["chunk_id"]).select(F.col("version_id").alias("v"), F.col("ordinal").alias("o")), (F.col("version_id") == F.col("v")) & (F.abs(F.col("ordinal") - F.col("o")) <= 1), "left_semi"), ("ordinal",),
))
register(Template("concepts_in_version", {"version_id": "id", "tenant_id": "string", "confidence_floor": "float"}, lambda e, p: G.concepts_in_version(_mentions(e, p).where(F.col("version_id") == p["version_id"])).join(e["concepts"], "concept_id"), ("-mentions", "concept_id"), defaults=FLOOR))
register(Template(
    "chunks_for_concepts", {"concept_ids": "id_list", "library_id": "string", "tenant_id": "string", "confidence_floor": "float"},
    lambda e, p: _mentions(e, p).where(F.col("concept_id").isin(p["concept_ids"])).join(e["versions"].where(F.col("library_id") == p["library_id"]), "version_id", "left_semi").groupBy("chunk_id").agg(F.max("confidence").alias("confidence"), F.countDistinct("concept_id").alias("concepts")), ("-concepts", "-confidence", "chunk_id"), defaults=FLOOR,
))
register(Template("concept_by_name", {"canonical_names": "id_list", "tenant_id": "string"}, lambda e, p: e["concepts"].where(F.col("key").isin(p["canonical_names"])), ("concept_id",)))
register(Template("related_documents", {"version_id": "id", "tenant_id": "string", "confidence_floor": "float"}, lambda e, p: G.related_versions(_mentions(e, p).select("version_id", "concept_id"), e["versions"], CEILING).where(F.col("version_id") == p["version_id"]), ("-shared", "other_id"), defaults=FLOOR))
register(Template("claims_about_concept", {"concept_id": "id", "tenant_id": "string"}, lambda e, p: e["claims"].where(F.col("about") == p["concept_id"]).join(e["chunks"], "chunk_id", "left_semi"), ("claim_id",)))
register(Template("claims_for_chunks", {"chunk_ids": "id_list", "tenant_id": "string"}, lambda e, p: e["claims"].where(F.col("chunk_id").isin(p["chunk_ids"])).join(e["concepts"].select(F.col("concept_id").alias("about"), "key"), "about", "left"), ("chunk_id", "claim_id")))
register(Template("chunk_texts", {"version_id": "id", "chunk_ids": "id_list", "tenant_id": "string"}, lambda e, p: e["chunks"].where((F.col("version_id") == p["version_id"]) & F.col("chunk_id").isin(p["chunk_ids"])), ("ordinal",)))
register(Template("library_documents", {"library_id": "string", "tenant_id": "string"}, lambda e, p: e["versions"].where((F.col("library_id") == p["library_id"]) & F.col("active")), ("title", "version_id"), limit="document_limit"))
register(Template("version_mention_pairs", {"version_id": "id", "tenant_id": "string"}, lambda e, p: e["mentions"].where(F.col("version_id") == p["version_id"]).select("chunk_id", "concept_id"), ("chunk_id", "concept_id"), limit="mention_limit", planner_visible=False))

_of_version = lambda name: lambda e, p: e[name].where(F.col("version_id") == p["version_id"])
VERSION = {"version_id": "id", "tenant_id": "string"}


def _pairs(e: dict, p: dict) -> DataFrame:
    """Claims that relate two concepts, whichever way round."""
    both = [p["concept_a"], p["concept_b"]]
    return e["claims"].where(F.col("about").isin(both) & F.col("involves").isin(both) & (F.col("about") != F.col("involves")) & (F.col("confidence") >= p["confidence_floor"]))


def _reached(e: dict, p: dict) -> DataFrame:
    """Distinct concepts of a version by its mentions, and by its claims' two ends."""
    claims = _of_version("claims")(e, p)
    routes = [_of_version("mentions")(e, p).select("concept_id"), claims.select(F.col("about").alias("concept_id")), claims.select(F.col("involves").alias("concept_id"))]
    return G.reached(routes)


def _library_mentions(e: dict, p: dict) -> DataFrame:
    """Weighted mention edges of one library's concepts that enough of its versions hold."""
    versions = e["versions"].where((F.col("library_id") == p["library_id"]) & F.col("active"))
    return G.library_mentions(_mentions(e, p), versions, p["min_documents"]).drop("library_id")


register(Template("claims_between_concepts", {"concept_a": "id", "concept_b": "id", "tenant_id": "string", "confidence_floor": "float"}, _pairs, ("-confidence", "claim_id"), defaults=FLOOR))
register(Template("citations_for_chunks", {"chunk_ids": "id_list", "tenant_id": "string"}, lambda e, p: e["citations"].where(F.col("chunk_id").isin(p["chunk_ids"])), ("chunk_id", "citation_id")))
register(Template("library_mentions", {"library_id": "string", "tenant_id": "string", "confidence_floor": "float", "min_documents": "int"}, _library_mentions, ("-weight", "version_id", "concept_id"), limit="mention_limit", defaults=FLOOR | {"min_documents": 1}))
register(Template("graph_node_counts", {"tenant_id": "string"}, lambda e, p: G.label_counts({k: e[k] for k in ("chunks", "concepts", "versions", "claims")}), ("label",), planner_visible=False))
register(Template("graph_edge_counts", {"tenant_id": "string"}, lambda e, p: e["mentions"].groupBy(F.lit("MENTIONS").alias("type")).agg(F.count("*").alias("n")), ("type",), planner_visible=False))
register(Template("version_counts", VERSION, lambda e, p: G.label_counts({k: _of_version(k)(e, p) for k in ("chunks", "claims", "mentions")}), ("label",), planner_visible=False))
register(Template("version_chunk_kinds", VERSION, lambda e, p: _of_version("chunks")(e, p).groupBy("kind").agg(F.count("*").alias("n")), ("kind",), planner_visible=False))
register(Template("version_section_levels", VERSION, lambda e, p: _of_version("sections")(e, p).groupBy("level").agg(F.count("*").alias("n")), ("level",), planner_visible=False))
register(Template("version_claim_shape", VERSION, lambda e, p: _of_version("claims")(e, p).groupBy("status").agg(F.count("*").alias("claims"), F.count(F.nullif("quote", F.lit(""))).alias("with_quote")), ("status",), planner_visible=False))
register(Template("version_claim_keys", VERSION, lambda e, p: _of_version("claims")(e, p).select("claim_id", F.concat_ws(" ", "chunk_id", "text").alias("claim_key")), ("claim_id",), limit="claim_limit", planner_visible=False))
register(Template("version_concept_ids", VERSION, _reached, ("concept_id",), limit="concept_limit", planner_visible=False))
register(Template("version_concepts_reached", VERSION, lambda e, p: _reached(e, p).agg(F.count("*").alias("concepts")), ("concepts",), planner_visible=False))
