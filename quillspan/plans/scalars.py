"""Registered queries over text and policy scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import policy as P
from quillspan.functions import text as T
from quillspan.registry import query
from quillspan.sources.tables import table

HASHED = f"h AS (SELECT doc_id, sha1(unhex('{T.POINT_NAMESPACE}') || CAST(CAST(doc_id AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR) AS BLOB)) AS h FROM documents)"


@query("point_ids", f"WITH {HASHED} SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h")
def point_ids(spark, sf_dir):
    """Deterministic point id of every document and length."""
    return table(spark, sf_dir, "documents", "doc_id", "n_chars").select("doc_id", T.point_id(F.col("doc_id"), F.col("n_chars")).alias("point_id"))


@query("path_ids", "SELECT page_id, list_last(string_split(url, '/')) || ':' || substr(sha256(list_last(string_split(url, '/'))), 1, 8) AS id FROM pages")
def path_ids(spark, sf_dir):
    """Short id of every page by the last part of its address."""
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.path_id(F.col("url")).alias("id"))


PROSE = "p AS (SELECT doc_id, 'It says so [chk_' || substr(sha256(text), 1, 24) || ', chk_' || substr(sha256(text), 9, 24) || ']. And  ' || lang || ' chk_' || substr(sha256(text), 3, 24) || ' , too.' AS prose FROM documents)"


@query("clean_prose", f"WITH {PROSE} SELECT doc_id, 'It says so. And ' || lang || ', too.' AS prose FROM p JOIN documents USING (doc_id)")
def clean_prose(spark, sf_dir):
    """Prose with planted chunk ids, cleaned."""
    d, h = table(spark, sf_dir, "documents", "doc_id", "text", "lang"), F.sha2("text", 256)
    cut = lambda a: F.concat(F.lit("chk_"), F.substring(h, a, 24))
    prose = F.concat(F.lit("It says so ["), cut(1), F.lit(", "), cut(9), F.lit("]. And  "), F.col("lang"), F.lit(" "), cut(3), F.lit(" , too."))
    return d.select("doc_id", T.clean_prose(prose).alias("prose"))


@query("page_cursors", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch_us(o_orderdate) END AS at_us, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'run' || o_custkey END AS id FROM orders")
def page_cursors(spark, sf_dir):
    """Cursors written and read again; every third one is damaged."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_custkey")
    stamp = F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    c = T.cursor(F.concat(stamp, F.lit("|run"), F.col("o_custkey").cast("string")))
    return o.select("o_orderkey", F.unix_micros(c["started_at"].cast("timestamp")).alias("at_us"), c["id"].alias("id"))


@query("style_levels", "SELECT o_orderkey, CASE WHEN o_orderkey % 60 < 4 OR (o_custkey % 2 = 0 AND o_custkey % 7 < 4) THEN 'brief' WHEN o_orderpriority LIKE '1%' THEN 'thorough' WHEN o_orderpriority LIKE '2%' THEN 'brief' ELSE 'standard' END AS level FROM orders")
def style_levels(spark, sf_dir):
    """Style of answers by what was asked, found and supported; odd customers have no count of support."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    asked = F.when(F.col("o_orderpriority").like("1%"), "thorough").when(F.col("o_orderpriority").like("2%"), "brief").when(F.col("o_orderpriority").like("3%"), "unknown")
    supported = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 7)
    return o.select("o_orderkey", P.style_level(asked, F.col("o_orderkey") % 60, supported).alias("level"))


def _sql_map(pairs: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


COST_NAMES = [c for costs in P.COST_STAGES.values() for c in costs] + ["unheard of"]
ARTIFACTS = [*P.ARTIFACT_STAGES, "unheard of"]
RUN_KINDS = ["index", "video", "rebuild", ""]


@query("stage_attribution", f"WITH e AS (SELECT event_id, (array[{', '.join(repr(c) for c in COST_NAMES)}])[event_id % {len(COST_NAMES)} + 1] AS cost, (array[{', '.join(repr(a) for a in ARTIFACTS)}])[event_id % {len(ARTIFACTS)} + 1] AS artifact, (array{RUN_KINDS})[event_id % 4 + 1] AS kind FROM events) SELECT event_id, {_sql_map({c: s for s, cs in P.COST_STAGES.items() for c in cs}, 'cost')} AS cost_stage, coalesce({_sql_map({f'{k}/{n}': s for (k, n), s in P.ARTIFACT_OVERRIDES.items()}, "kind || '/' || artifact")}, {_sql_map(P.ARTIFACT_STAGES, 'artifact')}) AS artifact_stage, CASE WHEN kind <> '' THEN kind WHEN event_id % 5 = 0 THEN 'reindex' ELSE 'index' END AS run_kind FROM e")
def stage_attribution(spark, sf_dir):
    """Stage of planted charges and artifacts, by the run's kind."""
    e = table(spark, sf_dir, "events", "event_id")
    at = lambda names: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int"))
    kind = at(RUN_KINDS)
    return e.select("event_id", P.stage_of_cost(at(COST_NAMES)).alias("cost_stage"), P.stage_of_artifact(at(ARTIFACTS), kind).alias("artifact_stage"), P.run_kind(kind, F.col("event_id") % 5 == 0).alias("run_kind"))


@query("stage_ordering", "SELECT DISTINCT event_type, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS INTEGER) AS place FROM events")
def stage_ordering(spark, sf_dir):
    """Place of every stage; unknown ones come last."""
    e = table(spark, sf_dir, "events", "event_type").distinct()
    return e.select("event_type", P.stage_order(F.col("event_type"), ["view", "click", "purchase"]).alias("place"))


@query("semantic_counts", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 5 END AS concepts, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 3 END AS claims, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST((doc_id % 3 + 1) // 2 AS BIGINT) END AS quoted FROM documents")
def semantic_counts(spark, sf_dir):
    """Concepts, claims and quoted claims in planted JSON; every fourth document is none."""
    d = table(spark, sf_dir, "documents", "doc_id")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    claims = F.transform(upto(F.col("doc_id") % 3), lambda i: F.struct(F.lit("c").alias("text"), F.when(i % 2 == 1, "q").otherwise("").alias("quote")))
    made = F.to_json(F.struct(F.transform(upto(F.col("doc_id") % 5), lambda i: i.cast("string")).alias("concepts"), claims.alias("claims")))
    c = T.semantic_counts(F.when(F.col("doc_id") % 4 == 0, "no json").otherwise(made))
    return d.select("doc_id", *[c[n].cast("long").alias(n) for n in ("concepts", "claims", "quoted")])


def _edges(pattern: str) -> str:
    """Word boundaries spelt out, as those of the oracle's engine know ASCII letters only."""
    first, last = pattern.index(r"\b"), pattern.rindex(r"\b")
    body = pattern[first + 2 : last] + (pattern[last + 2 :] if last != first else "")
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_]){body.replace(chr(92) + 'b', '')}" + (r"($|[^\p{L}\p{N}_])" if pattern.endswith(r"\b") else "")


@query("page_text_heuristics", rf"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents), q AS (SELECT doc_id, s, contains(s, '¿') OR ends_with(regexp_replace(s, '\s+$', ''), '?') OR regexp_matches(s, '{_edges(T.IMPERATIVES)}') AS ask FROM l) SELECT doc_id, count_if(ask) AS questions, count_if(NOT ask AND (regexp_matches(s, '{T.BIBLIOGRAPHIC}') OR length(s) > 120)) AS notes FROM q GROUP BY doc_id")
def page_text_heuristics(spark, sf_dir):
    """Lines of every document that read as questions and as notes."""
    lines = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return lines.groupBy("doc_id").agg(F.count_if(T.reads_as_question(F.col("s"))).alias("questions"), F.count_if(T.reads_as_note(F.col("s"))).alias("notes"))


RULES, WINS = "Answer from the evidence.", "What follows is about form; the rules win."


@query("system_prompts", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{RULES}' ELSE '{RULES}' || chr(10) || chr(10) || '{WINS}' || chr(10) || chr(10) || 'In ' || lang END AS prompt, doc_id % 3 = 0 AS corrects FROM documents")
def system_prompts(spark, sf_dir):
    """Rules with a style for odd ids and a blank one for others; and defaults by caption kind."""
    style = F.when(F.col("doc_id") % 2 == 0, "  \n").otherwise(F.concat(F.lit(" In "), F.col("lang"), F.lit("\n")))
    kind = F.when(F.col("doc_id") % 3 == 0, "auto").when(F.col("doc_id") % 3 == 1, "manual")
    return table(spark, sf_dir, "documents", "doc_id", "lang").select("doc_id", P.compose_system(F.lit(RULES), WINS, style).alias("prompt"), P.corrects_by_default(kind).alias("corrects"))


@query("paragraph_joins", r"WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS p FROM documents) SELECT doc_id, sha256(array_to_string(p, chr(10) || chr(10))) AS joined, sha256(array_to_string(p, chr(10))) AS repaired FROM t")
def paragraph_joins(spark, sf_dir):
    """Lines joined as paragraphs, and the blank lines between them collapsed again."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    joined = T.join_paragraphs(F.split("text", "\n"))
    return d.select("doc_id", F.sha2(joined, 256).alias("joined"), F.sha2(T.repair_paragraph(joined), 256).alias("repaired"))
