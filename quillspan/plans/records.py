"""Registered catalog writes: nations stand for libraries, regions for tenants, customers for
catalog documents, orders for runs, line items for artifacts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import records as R
from quillspan.registry import query
from quillspan.sources.tables import table


def nations(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("library_id"), F.col("n_name").alias("name"), F.lit("es").alias("language"), F.col("n_regionkey").alias("tenant_id")).withColumn("library_id", F.col("library_id").cast("string"))


ASKED = "asked AS (SELECT CAST(n_nationkey AS VARCHAR) AS library_id, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE lower(n_name) END AS name, 'en' AS language, CASE WHEN n_nationkey % 5 = 4 THEN -1 ELSE n_regionkey END AS tenant_id FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT CAST(100 + r_regionkey AS VARCHAR), CASE WHEN r_regionkey % 2 = 0 THEN '' ELSE r_name END, 'fr', r_regionkey FROM region)"


def asked_libraries(spark, sf_dir):
    old = nations(spark, sf_dir).where(F.col("library_id").cast("int") % 3 == 0)
    key = F.col("library_id").cast("int")
    changed = old.select("library_id", F.when(key % 2 == 0, "").otherwise(F.lower("name")).alias("name"), F.lit("en").alias("language"), F.when(key % 5 == 4, -1).otherwise(F.col("tenant_id")).alias("tenant_id"))
    r = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    added = r.select((F.col("r_regionkey") + 100).cast("string").alias("library_id"), F.when(F.col("r_regionkey") % 2 == 0, "").otherwise(F.col("r_name")).alias("name"), F.lit("fr").alias("language"), F.col("r_regionkey").alias("tenant_id"))
    return changed.unionByName(added)


@query("ensure_libraries", f"WITH {ASKED} SELECT coalesce(CAST(n.n_nationkey AS VARCHAR), a.library_id) AS library_id, CASE WHEN n.n_nationkey IS NULL THEN coalesce(nullif(a.name, ''), a.library_id) WHEN a.library_id IS NOT NULL AND a.tenant_id = n.n_regionkey AND a.name <> '' THEN a.name ELSE n.n_name END AS name, CASE WHEN n.n_nationkey IS NULL THEN a.language WHEN a.tenant_id = n.n_regionkey THEN a.language ELSE 'es' END AS language, coalesce(n.n_regionkey, a.tenant_id) AS tenant_id FROM nation n FULL JOIN asked a ON a.library_id = CAST(n.n_nationkey AS VARCHAR)")
def ensure_libraries(spark, sf_dir):
    """Libraries after a batch of renames, blank names, foreign claims and new ones."""
    return R.ensure_libraries(nations(spark, sf_dir), asked_libraries(spark, sf_dir))


@query("refused_libraries", f"WITH {ASKED} SELECT a.library_id FROM asked a JOIN nation n ON a.library_id = CAST(n.n_nationkey AS VARCHAR) WHERE a.tenant_id <> n.n_regionkey")
def refused_libraries(spark, sf_dir):
    """Libraries of that batch that another tenant owns."""
    return R.refused(nations(spark, sf_dir), asked_libraries(spark, sf_dir), ["library_id"], "tenant_id")


@query("answer_styles", "SELECT r_regionkey AS tenant_id, effort, CASE WHEN r_regionkey % 2 = 1 AND effort = 'brief' THEN 'edited ' || r_name ELSE r_name || ' ' || effort END AS body FROM region, (VALUES ('brief'), ('thorough')) e(effort) WHERE NOT (r_regionkey % 2 = 0 AND effort = 'brief')")
def answer_styles(spark, sf_dir):
    """Style overrides after edits; blank ones are deleted."""
    r = table(spark, sf_dir, "region", "r_regionkey", "r_name").withColumnRenamed("r_regionkey", "tenant_id")
    old = r.select("tenant_id", F.explode(F.array(F.lit("brief"), F.lit("thorough"))).alias("effort"), "r_name").select("tenant_id", "effort", F.concat_ws(" ", "r_name", "effort").alias("body"))
    edits = r.select("tenant_id", F.lit("brief").alias("effort"), F.when(F.col("tenant_id") % 2 == 0, "   ").otherwise(F.concat(F.lit(" edited "), F.col("r_name"))).alias("body"))
    return R.set_styles(old, edits)


def catalog(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return c.select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("author"), F.col("c_nationkey").alias("folder_id"), F.lit(None).cast("string").alias("path"), (F.col("c_custkey") % 7 != 0).alias("present"))


@query("upsert_documents", "SELECT c_custkey AS document_id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS title, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'scan' WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS author, c_nationkey AS folder_id, CASE WHEN c_custkey % 3 = 0 THEN '/in/' || c_custkey END AS path, c_custkey % 3 = 0 OR c_custkey % 7 <> 0 AS present FROM customer UNION ALL SELECT c_custkey + 1000000, upper(c_name), NULL, NULL, '/in/' || c_custkey + 1000000, TRUE FROM customer WHERE c_custkey % 100 = 0".replace("'/in/' || c_custkey + 1000000", "'/in/' || (c_custkey + 1000000)"))
def upsert_documents(spark, sf_dir):
    """Catalog documents after a scan: known ones filled and revived, new ones added."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    # The ids of new documents may be those of customers too, so the key says which of both a row is.
    key = lambda fresh, c: F.struct(fresh.alias("fresh"), c.alias("id"))
    ids = c.where("c_custkey % 3 = 0").withColumn("fresh", F.lit(False)).unionByName(c.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name", F.lit(True).alias("fresh")))
    author = F.when((F.col("c_custkey") % 5 == 0) & ~F.col("fresh"), "scan")
    seen = ids.select(key(F.col("fresh"), F.col("c_custkey")).alias("document_id"), F.upper("c_name").alias("title"), author.alias("author"), F.lit(None).cast("int").alias("folder_id"), F.concat(F.lit("/in/"), F.col("c_custkey").cast("string")).alias("path"), F.lit(True).alias("present"))
    docs = catalog(spark, sf_dir)
    held = docs.withColumn("document_id", key(F.lit(False), F.col("document_id")))
    return R.upsert_documents(held, seen).withColumn("document_id", F.col("document_id.id")).select(docs.columns)


@query("mark_absent", "SELECT c_custkey AS document_id, c_custkey % 7 <> 0 AND c_custkey % 4 <> 0 AS present FROM customer")
def mark_absent(spark, sf_dir):
    """Documents that a scan did not find are marked, not removed."""
    docs = catalog(spark, sf_dir)
    return R.mark_absent(docs, docs.where("document_id % 4 = 0").select("document_id")).select("document_id", "present")


@query("register_versions", "SELECT version_id, state, bytes, holders FROM (SELECT substr(sha256(text), 1, 24) AS version_id, CASE WHEN min(doc_id) FILTER (WHERE doc_id % 2 = 0) IS NOT NULL THEN 'indexed' ELSE 'registered' END AS state, CAST(min(strlen(text)) AS BIGINT) AS bytes, count(DISTINCT doc_id) AS holders FROM documents GROUP BY text)")
def register_versions(spark, sf_dir):
    """Versions and holders after odd documents arrive; equal content keeps its version."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    even = d.where("document_id % 2 = 0")
    held = even.groupBy("sha256").agg(F.min("bytes").alias("bytes")).select(F.substring("sha256", 1, 24).alias("version_id"), "sha256", "bytes", F.lit("indexed").alias("state"))
    links = even.select("document_id", F.substring("sha256", 1, 24).alias("version_id"))
    versions, links = R.register_versions(held, links, d.where("document_id % 2 = 1"))
    return versions.join(links.groupBy("version_id").agg(F.count("*").alias("holders")), "version_id").select("version_id", "state", "bytes", "holders")


@query("documents_holding", "SELECT substr(sha256(text), 1, 24) AS version_id, list_sort(list(doc_id)) AS documents FROM documents GROUP BY text HAVING count(*) BETWEEN 2 AND 50")
def documents_holding(spark, sf_dir):
    """Documents that share a version, where two to fifty do."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.substring(F.sha2("text", 256), 1, 24).alias("version_id"))
    several = d.groupBy("version_id").agg(F.count("*").alias("n")).where("n between 2 and 50")
    return d.join(several, "version_id", "left_semi").groupBy("version_id").agg(F.array_sort(F.collect_list("doc_id")).alias("documents"))


def runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("version_id"), (F.col("o_custkey") % 5).alias("tenant_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("started_at"), F.lit("running").alias("state"), F.lit(None).cast("timestamp_ntz").alias("ended_at"))


@query("run_lifecycle", "SELECT o_orderkey AS run_id, o_orderstatus AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 3 = 1 THEN 'succeeded' ELSE 'running' END AS state, CASE WHEN o_orderkey % 3 < 2 THEN epoch_us(o_orderdate) + 60000000 END AS ended_us FROM orders UNION ALL SELECT -o_orderkey - 1, 'again', 'running', NULL FROM orders WHERE o_orderkey % 50 = 0")
def run_lifecycle(spark, sf_dir):
    """Runs started twice, new ones, and ended ones; ends of unknown runs are dropped."""
    old = runs(spark, sf_dir)
    again = old.withColumn("kind", F.lit("again"))
    started = R.start_runs(old, again.where("run_id % 2 = 0").unionByName(again.where("run_id % 50 = 0").withColumn("run_id", -F.col("run_id") - 1)))
    ends = old.where("run_id % 3 < 2").select("run_id", F.when(F.col("run_id") % 3 == 0, "failed").otherwise("succeeded").alias("state"), (F.col("started_at") + F.expr("INTERVAL 1 MINUTE")).alias("ended_at"))
    stray = ends.withColumn("run_id", F.col("run_id") + 10**12)
    done = R.finish_runs(started, ends.unionByName(stray))
    return done.select("run_id", "kind", "state", F.unix_micros(F.col("ended_at").cast("timestamp")).alias("ended_us"))


@query("record_run_events", "SELECT o_custkey % 5 AS tenant_id, count(*) AS events, count_if(l_linenumber > 3) AS late FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def record_run_events(spark, sf_dir):
    """Events after a replay with repeats and with rows of unknown runs, by the run's tenant."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus")
    e = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("seq"), F.col("l_shipdate").alias("at"), F.col("l_linestatus").alias("stage"))
    known = runs(spark, sf_dir)
    held = e.where("seq <= 3").groupBy("run_id", "seq").agg(F.min("at").alias("at"), F.min("stage").alias("stage"))
    held = held.join(known.select("run_id", "tenant_id"), "run_id").select("run_id", "seq", "at", "stage", "tenant_id")
    late = e.where("seq >= 2").unionByName(e.where("seq = 5")).unionByName(e.where("seq = 1").withColumn("run_id", F.col("run_id") + 10**12))
    out = R.record_events(held, late, known)
    return out.groupBy("tenant_id").agg(F.count("*").alias("events"), F.count_if(F.col("seq") > 3).alias("late"))


ARTIFACTS = "a AS (SELECT l_orderkey AS run_id, l_linestatus || l_returnflag AS name, l_linenumber AS seq, l_partkey AS size FROM lineitem), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, name ORDER BY seq DESC, size DESC) AS k FROM a) WHERE k = 1)"


def artifacts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag", "l_linenumber", "l_partkey")
    a = li.select(F.col("l_orderkey").alias("run_id"), F.concat("l_linestatus", "l_returnflag").alias("name"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("size"))
    held = a.where("seq = 1").groupBy("run_id", "name", "seq").agg(F.min("size").alias("size"))
    return R.record_artifacts(held, a)


@query("record_artifacts", f"WITH {ARTIFACTS} SELECT run_id, name, seq, size FROM w")
def record_artifacts(spark, sf_dir):
    """Artifacts of runs, the last one written of each name."""
    return artifacts(spark, sf_dir).select("run_id", "name", "seq", "size")


@query("latest_run_with_artifact", f"WITH {ARTIFACTS} SELECT version_id, name, run_id FROM (SELECT o_custkey AS version_id, name, run_id, row_number() OVER (PARTITION BY o_custkey, name ORDER BY o_orderdate DESC, run_id DESC) AS k FROM w JOIN orders ON o_orderkey = run_id) WHERE k = 1".replace("row_number() OVER (PARTITION BY o_custkey", "row_number() OVER (PARTITION BY o_custkey"))
def latest_run_with_artifact(spark, sf_dir):
    """Newest run of every version that wrote each artifact."""
    return R.latest_run_with_artifact(runs(spark, sf_dir), artifacts(spark, sf_dir))


@query("run_events_in_order", "SELECT l_orderkey AS run_id, string_agg(l_linestatus, '' ORDER BY l_linenumber, l_linestatus) AS stages, min(l_linenumber) AS first_seq FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def run_events_in_order(spark, sf_dir):
    """Stages of every run in the order of their numbers, not of their clocks."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus").withColumnRenamed("l_orderkey", "run_id")
    known = li.join(runs(spark, sf_dir).select("run_id"), "run_id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_linestatus")))  # a run has a handful of events
    return known.groupBy("run_id").agg(F.array_join(F.transform(listed, lambda e: e["l_linestatus"]), "").alias("stages"), F.min("l_linenumber").alias("first_seq"))


@query("profile_warnings", "SELECT s_suppkey AS warning_id, s_nationkey AS version_id, round(s_acctbal / 10000, 4) AS similarity FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 4 <> 0")
def profile_warnings(spark, sf_dir):
    """Warnings that stay open after every fourth is acknowledged."""
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").where("s_acctbal > 0")
    w = s.select(F.col("s_suppkey").alias("warning_id"), F.col("s_nationkey").alias("version_id"), F.round(F.col("s_acctbal") / 10000, 4).alias("similarity"), F.lit(True).alias("open"))
    return R.acknowledge(w, w.where("warning_id % 4 = 0").select("warning_id")).where("open").drop("open")


@query("conversation_titles", "SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND conv_id % 3 = 0 THEN 'mine ' || conv_id WHEN conv_id % 2 = 0 THEN 'hers ' || conv_id ELSE 'auto ' || conv_id END AS title, CASE WHEN conv_id % 2 = 0 THEN FALSE ELSE TRUE END AS generated FROM (SELECT DISTINCT conv_id FROM conversations)")
def conversation_titles(spark, sf_dir):
    """Titles after generated and written ones arrive; what a person wrote is not replaced by a generated one."""
    c = table(spark, sf_dir, "conversations", "conv_id").distinct()
    kind = F.col("conv_id") % 2 == 1
    text = lambda p: F.concat(F.lit(p), F.col("conv_id").cast("string"))
    old = c.select("conv_id", F.lit(0).alias("started_at"), F.when(kind, text("old ")).otherwise(text("hers ")).alias("title"), kind.alias("generated"))
    generated = c.select("conv_id", F.lit(1).alias("started_at"), text("auto ").alias("title"), F.lit(True).alias("generated"))
    written = c.where("conv_id % 2 = 0 and conv_id % 3 = 0").select("conv_id", F.lit(2).alias("started_at"), text("mine ").alias("title"), F.lit(False).alias("generated"))
    return R.set_titles(R.set_titles(old, generated), written).select("conv_id", "title", "generated")


def turn_table(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn").groupBy("conv_id", "turn").agg(F.lit("q").alias("question"))
    state = F.when(F.col("turn") % 2 == 0, "open").otherwise("answered")
    return c.withColumn("state", state).withColumn("answer", F.when(F.col("turn") % 2 == 1, "old"))


@query("settled_turns", "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'answered' WHEN turn % 4 = 0 THEN 'failed' ELSE 'open' END AS state, CASE WHEN turn % 2 = 1 THEN 'old' WHEN turn % 4 = 0 THEN 'new' END AS answer FROM t UNION ALL SELECT conv_id, max(turn) + 1, 'open', NULL FROM t GROUP BY conv_id")
def settled_turns(spark, sf_dir):
    """Turns after answers arrive (settled ones keep theirs), and a new question in every conversation."""
    t = turn_table(spark, sf_dir)
    answers = t.where("turn % 4 in (0, 1)").select("conv_id", "turn", F.lit("failed").alias("state"), F.lit("new").alias("answer"))
    asked = t.select("conv_id").distinct().withColumn("question", F.lit("next"))
    return R.open_turns(R.settle_turns(t, answers), asked).select("conv_id", "turn", "state", "answer")


@query("relayed_deltas", "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), d AS (SELECT conv_id, turn, unnest(generate_series(0, 4)) AS chunk_seq FROM t) SELECT conv_id, turn, chunk_seq, turn % 2 = 1 AS ends, turn % 2 = 0 AS kept FROM d WHERE chunk_seq > 2")
def relayed_deltas(spark, sf_dir):
    """Deltas after a position that were published twice, whether their turn has ended, and what a clearing keeps."""
    t = turn_table(spark, sf_dir)
    d = t.select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("chunk_seq"))
    again = t.select("conv_id", "turn", F.explode(F.sequence(F.lit(2), F.lit(4))).alias("chunk_seq"))
    all_ = R.publish(d, again)
    kept = R.clear_deltas(all_, t).withColumn("kept", F.lit(True))
    out = R.relay(all_, t, 2).join(kept, ["conv_id", "turn", "chunk_seq"], "left")
    return out.select("conv_id", "turn", "chunk_seq", "ends", F.coalesce("kept", F.lit(False)).alias("kept"))


HELD = "l AS (SELECT DISTINCT o_custkey AS document_id, o_orderpriority || (o_custkey % 40) AS version_id FROM orders)"


def holdings(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority")
    links = o.select(F.col("o_custkey").alias("document_id"), F.concat("o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("version_id")).distinct()
    documents = links.groupBy("document_id").agg(F.max("version_id").alias("active_version"))
    return documents, links, links.select("version_id").distinct()


@query("remove_versions", f"WITH {HELD} SELECT document_id, CASE WHEN max(version_id) LIKE '5%' THEN NULL ELSE max(version_id) END AS active_version, count_if(version_id NOT LIKE '5%') AS links FROM l GROUP BY 1")
def remove_versions(spark, sf_dir):
    """Active pointers and links after all versions of one kind are removed."""
    documents, links, versions = holdings(spark, sf_dir)
    documents, links, _ = R.remove_versions(documents, links, versions, versions.where("version_id like '5%'"))
    n = links.groupBy("document_id").agg(F.count("*").alias("links"))
    return documents.join(n, "document_id", "left").select("document_id", "active_version", F.coalesce("links", F.lit(0)).alias("links"))


@query("remove_documents", f"WITH {HELD}, k AS (SELECT * FROM l WHERE document_id % 40 > 9) SELECT (SELECT count(DISTINCT document_id) FROM k) AS documents, (SELECT count(*) FROM k) AS links, (SELECT count(DISTINCT version_id) FROM k) AS versions")
def remove_documents(spark, sf_dir):
    """What is left when documents go with the versions that only they held."""
    documents, links, versions = holdings(spark, sf_dir)
    left = R.remove_documents(documents, links, versions, documents.where("document_id % 40 <= 9"))
    from quillspan.operators.catalog import one_row

    return one_row([df.agg(F.count("*").alias(n)) for df, n in zip(left, ("documents", "links", "versions"), strict=True)])
