"""Every query of the library by name, with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.functions.ignore import ignored
from meridia.functions.time import DAY, HOUR, MINUTE, civil_to_utc_us, to_us
from meridia.operators import asof, integrity, measures, records, signals
from meridia.operators.history import with_row_before
from meridia.operators.requests import read_requests
from meridia.sources.tables import decoded, table

from .oracle import ORACLE_SQL

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", to_us(F.col("ts")).alias("ts_us"), "event_type", "value", "ts", "props")
    return rows.filter(F.col("event_type").isin(*kinds)) if kinds else rows


@query
def aligned_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each anomaly the vehicle's latest signal at or before it, with the owner's label."""
    frames = _events(spark, sf_dir, "error").select("user_id", "event_id", "ts_us")
    signals = _events(spark, sf_dir, "view").select("user_id", "ts_us", F.col("event_id").alias("signal_id"), F.col("value").alias("signal_value"))
    found = asof.asof_join(frames, signals, ["user_id"], "ts_us", ["signal_id", "signal_value"], 7 * DAY)
    owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_u"), F.col("c_nationkey").alias("code"))
    labels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    named = records.with_label(found.join(owner, F.col("user_id") == F.col("_u"), "left"), "code", labels)
    return named.select("event_id", "user_id", "ts_us", "signal_id", "signal_value", (F.col("ts_us") - F.col("matched_ts_us")).alias("age_us"), F.coalesce("label", F.lit("unknown")).alias("label"))


@query
def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole window of one request, in one range filter that reaches the scan."""
    rows = table(spark, sf_dir, "events")
    inside = (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-13").cast("timestamp_ntz"))
    return rows.filter(inside).select("event_id", "user_id", "event_type", "value", to_us(F.col("ts")).alias("ts_us"))


@query
def point_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _events(spark, sf_dir, "view").select("user_id", "ts_us", "value")
    copies = points.filter(F.col("user_id") % 3 == 0)
    other = points.filter(F.col("user_id") % 5 == 0).withColumn("value", F.col("value") + 1)
    return records.distinct_points(points.unionByName(copies).unionByName(other))


@query
def message_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _events(spark, sf_dir).select(F.col("event_id").alias("message_id"), F.col("user_id").alias("vehicle"), F.col("ts_us").alias("received_us"))
    again = sent.filter(F.col("vehicle") % 4 == 1).withColumn("received_us", F.col("received_us") + 5 * MINUTE)
    return records.first_by(again.unionByName(sent), ["message_id"], ["received_us"])


@query
def frame_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_id", "ts_us")
    return measures.with_gap(rows, ["user_id"], "ts_us", "event_id")


@query
def frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.rate(_events(spark, sf_dir), ["user_id"], "ts_us", HOUR)


@query
def skip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_id", "ts_us")
    return measures.skips(rows, ["user_id"], "ts_us", "event_id", 6 * HOUR)


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.quantiles(_events(spark, sf_dir), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.histogram(_events(spark, sf_dir), ["event_type"], "value", 10.0)


@query
def event_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five points nearest to each anomaly, within half an hour."""
    anchors = _events(spark, sf_dir, "error").select("user_id", F.col("event_id").alias("anchor_id"), F.col("ts_us").alias("anchor_us"))
    points = _events(spark, sf_dir).filter("event_type <> 'error'").select("user_id", "event_id", "event_type", "ts_us")
    pairs = asof.nearest_points(anchors, points, ["user_id"], "anchor_us", "ts_us", "event_id", 5, 30 * MINUTE)
    near = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.abs(F.col("ts_us") - F.col("anchor_us")), "event_id"))
    return pairs.withColumn("place", near.cast("long")).filter("place <= 5").select("anchor_id", "event_id", "event_type", (F.col("ts_us") - F.col("anchor_us")).alias("offset_us"), "place")


@query
def state_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.runs(_events(spark, sf_dir), ["user_id"], "ts_us", "event_id", "event_type")


@query
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "5 hours")


@query
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("day", F.floor(F.col("ts_us") / DAY))
    return measures.stage_durations(rows, ["user_id", "day"], "event_type", "ts_us", 900_000_000)


@query
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes to labels; a code that the dimension lacks keeps its number."""
    coded = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 3).alias("code"))
    labels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return records.with_label(coded, "code", labels).select("c_custkey", F.col("code").cast("long").alias("code"), "label")


@query
def unknown_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _events(spark, sf_dir).select(F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("code"))
    return records.unknown_codes(codes, "code", table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("code")))


@query
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for attempts: priority for the environment, status for the outcome."""
    outcome = F.when(F.col("o_orderstatus") == "P", "error").when(F.col("o_orderstatus") == "F", "ok").otherwise("empty")
    env = F.when(F.col("o_orderpriority") <= "3", "primary").otherwise("fallback")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("year"), outcome.alias("outcome"), env.alias("env"))
    return records.choose_source(rows, ["o_custkey", "year"])


@query
def same_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.one_environment(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@query
def complete_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.complete_pages(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query
def branch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose both branches hold: something shipped, and nothing before the order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_returnflag")
    window = items.join(orders.select("o_orderkey", "o_orderdate"), "o_orderkey").groupBy("o_orderkey").agg(F.every(F.col("l_shipdate") >= F.col("o_orderdate")).alias("passed"))
    content = items.groupBy("o_orderkey").agg(F.some(F.col("l_returnflag") != "R").alias("passed"))
    return records.gate(window, content, ["o_orderkey"])


@query
def retry_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for attempts; a returned line is a failure that is not retried."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    ok = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus"]
    return records.pick_attempt(rows, ["l_orderkey"], order, ok, F.col("l_returnflag") == "R")


@query
def fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _events(spark, sf_dir, "signup").select("event_id", "user_id", "ts_us")
    return records.fair_order(tasks, "user_id", "ts_us", "event_id")


@query
def slot_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.admitted(_events(spark, sf_dir, "signup").select("event_id", "user_id", "ts_us"), "user_id", "ts_us", "event_id", 2)


@query
def status_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, "signup").select("user_id", F.floor(F.col("ts_us") / DAY).alias("day"), "event_id")
    return records.binding(rows, ["user_id", "day"], "event_id")


@query
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest state of each task on each of its two axes, kept apart."""
    axis = F.when(F.col("event_type").isin("view", "click"), "execution").otherwise("delivery")
    rows = _events(spark, sf_dir).select("user_id", axis.alias("axis"), "ts_us", "event_id", F.col("event_type").alias("state"))
    return records.last_by(rows, ["user_id", "axis"], ["ts_us", "event_id"])


@query
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "ts_us", "event_id", "event_type")
    allowed = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view")]
    return records.transitions(rows, "user_id", "ts_us", "event_id", "event_type", allowed)


@query
def followup_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head of each conversation's queue: the first user turn that nothing follows up."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = turns.withColumn("_next", after).filter("role = 'user'")
    return records.next_unfinished(asked, "conv_id", "turn", F.coalesce(F.col("_next") == "assistant", F.lit(False)))


@query
def recovery_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = F.when(F.col("l_linenumber") % 2 == 1, "log").otherwise("signal")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), branch.alias("branch"), "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return records.recovery_plan(rows, "o_orderkey", "branch", F.col("l_returnflag") == "N", orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderpriority LIKE '1%'"))


@query
def interrupted_takeover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for interrupted jobs, their columns for what is known of them."""
    key = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(
        "o_orderkey", (key % 5 != 0).alias("process_gone"), (key % 7 != 0).alias("children_gone"), (F.col("o_totalprice") > 20_000).alias("source_valid"),
        (F.col("o_orderstatus") == "F").alias("has_report"), F.col("o_custkey").alias("lease_seen"), F.when(key % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("lease_now"),
    )
    return records.takeover_plan(jobs, "o_orderkey")


@query
def followup_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "pages").select("page_id", "url")
    tries = table(spark, sf_dir, "pages").filter("url LIKE 'https:%'").select("page_id", (F.col("page_id") % 3 != 0).alias("registered"))
    return records.with_followup(reports, tries, "page_id")


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.file_digests(table(spark, sf_dir, "pages"), "page_id", "html")


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of the pages fetched safely; the others have none. Sizes and results follow
    from the page number."""
    kind = F.col("page_id") % 7
    size = F.when(kind == 1, F.col("bytes") + 1).otherwise(F.col("bytes"))
    result = F.when(kind == 2, "unknown").when(kind == 3, "failed").otherwise("confirmed")
    safe = integrity.file_digests(table(spark, sf_dir, "pages").filter("url LIKE 'https:%'"), "page_id", "html")
    return safe.select("page_id", "sha256", size.alias("bytes"), result.alias("result"))


@query
def delivery_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = _artifacts(spark, sf_dir)
    return records.delivery_status(artifacts, _receipts(spark, sf_dir), "page_id")


@query
def delivery_resend(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = _artifacts(spark, sf_dir)
    status = records.delivery_status(artifacts, _receipts(spark, sf_dir), "page_id")
    return records.resend_plan(status, artifacts.filter("bytes > 1500"), "page_id")


@query
def completion_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed artifacts to announce: those without a confirmed delivery."""
    artifacts = _artifacts(spark, sf_dir)
    sent = records.delivery_status(artifacts, _receipts(spark, sf_dir), "page_id").filter("status = 'sent'")
    return artifacts.join(sent, "page_id", "left_anti").select("page_id", "sha256")


@query
def artifact_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    flags = {
        "has_doctype": html.startswith("<!DOCTYPE html>"),
        "is_closed": html.endswith("</html>"),
        "has_article": html.contains("<article>"),
        "self_contained": ~html.rlike(r'<script[^>]+src='),
        "in_size": F.octet_length(html).between(1000, 50_000),
    }
    rows = table(spark, sf_dir, "pages").select("page_id", *(v.alias(k) for k, v in flags.items()))
    valid = F.lit(True)
    for k in flags:
        valid = valid & F.col(k)
    return rows.withColumn("valid", valid)


@query
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return records.expired(orders, "o_orderdate", 14).select("o_orderkey", "o_orderstatus")


@query
def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a manifest of the labelled ones, some sizes off by one, and of the
    benchmark's items, which no document is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("bytes"))
    listed = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    off = F.when(F.col("toxic") == 1, 1).otherwise(0)
    items = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.length("text").cast("long").alias("bytes"))
    return integrity.reconcile(docs, listed.select("doc_id", (F.col("n_chars") + off).alias("bytes")).unionByName(items), "doc_id", ["bytes"])


@query
def provenance_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents and benchmark items as provenance; bad ones were changed since."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    listed = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    told = F.when(F.col("quality") == 0, F.sha2(F.lit("changed").cast("binary"), 256)).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    items = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return integrity.subset_violations(listed.select("doc_id", told.alias("sha256")).unionByName(items), docs, "doc_id", "sha256")


@query
def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.file_digests(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest for each hundred pages; some paths hold a control character."""
    sign = F.when(F.col("page_id") % 5 == 1, F.lit("\u001f")).when(F.col("page_id") % 5 == 2, F.lit("\\u001F")).otherwise("")
    rows = table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / 100).alias("manifest"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), sign).alias("path"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256")
    )
    return integrity.canonical_digest(rows, ["manifest"], "path", "sha256")


@query
def release_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest of all pages."""
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))
    return integrity.whole_digest(rows, "path", "sha256")


@query
def case_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    return integrity.case_collisions(part.select(F.concat_ws("/", name, "p_brand").alias("name")), "name")


@query
def folded_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that only full case folding finds equal."""
    key = F.col("p_partkey")
    stem = F.concat(F.lit("stra"), F.when(key % 3 == 0, "\u00dfe").when(key % 3 == 1, "SSE").otherwise("ze"), F.floor(key / 6).cast("string"))
    return integrity.case_collisions(table(spark, sf_dir, "part").select(stem.alias("name")), "name")


@query
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: some with a byte order mark, some that are no UTF-8."""
    raw = F.col("text").cast("binary")
    kind = F.col("doc_id") % 3
    content = F.when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(kind == 2, F.concat(raw, F.unhex(F.lit("C328")))).otherwise(raw)
    text = decoded(content)
    return table(spark, sf_dir, "documents").select("doc_id", text.isNotNull().alias("valid"), F.sha2(text.cast("binary"), 256).alias("sha256"))


def _release(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as files, and a manifest with some digests and some sizes changed."""
    files = integrity.file_digests(table(spark, sf_dir, "pages"), "page_id", "html")
    key = F.col("page_id")
    listed = files.select("page_id", F.when(key % 11 == 1, F.sha2(F.lit("changed").cast("binary"), 256)).otherwise(F.col("sha256")).alias("sha256"), F.when(key % 11 == 2, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"))
    return files.filter(key % 11 != 3), listed.filter(key % 11 != 4)


@query
def entry_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and size together against the manifest's."""
    files, listed = _release(spark, sf_dir)
    return integrity.reconcile(files, listed, "page_id", ["sha256", "bytes"])


@query
def release_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a release's map equals its manifest, in number too."""
    files, listed = _release(spark, sf_dir)
    return integrity.equality(files, listed, "page_id", ["sha256"])


@query
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the nations, written as one JSON object and read again."""
    from meridia.sources.tables import manifest, write_manifest
    from meridia.functions.scratch import work_dir

    name = F.col("n_name").cast("binary")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("path"), F.sha2(name, 256).alias("sha256"), F.octet_length(name).cast("long").alias("bytes"))
    at = f"{work_dir(spark)}/manifest"
    write_manifest(rows, at, "1")
    return manifest(spark, at)


@query
def file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file's literal is exempt from one rule, the same literal elsewhere isn't."""
    path = F.concat(F.lit("tests/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, EXEMPT_FILE).otherwise("/other.py"))
    text = F.concat_ws(" ", "text", F.when(F.col("doc_id") % 3 == 0, F.lit(EXEMPT_URL)).otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), text.alias("text"))
    return integrity.scan_rules(rows, "doc_id", "text", private_rules("text", F.col("path")))


@query
def strict_json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON value and nothing after it; keys may repeat."""
    kind = F.col("event_id") % 7
    again = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "k": 1, "k": "b"}'))
    text = F.when(kind == 1, F.concat("props", F.lit(" x"))).when(kind == 2, F.concat("props", F.lit(", 1"))).when(kind == 3, "").when(kind == 4, again).when(kind == 5, F.lit("[1 2]")).otherwise(F.col("props"))
    return _events(spark, sf_dir).select("event_id", integrity.strict_json(text).alias("valid"))


@query
def branch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both branches of a job read one vehicle, window and environment."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    log = orders.filter(key % 13 != 5).select("o_orderkey", F.col("o_custkey").alias("vehicle"), start.alias("start_us"), (start + DAY).alias("end_us"), F.lit("primary").alias("env"))
    signal = orders.filter(key % 13 != 6).select(
        "o_orderkey", F.when(key % 13 == 1, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("vehicle"), F.when(key % 13 == 2, start + HOUR).otherwise(start).alias("start_us"),
        F.when(key % 13 == 3, start + HOUR).otherwise(start + DAY).alias("end_us"), F.when(key % 13 == 4, "fallback").otherwise("primary").alias("env"),
    )
    return records.same_window(log, signal, "o_orderkey", ["vehicle", "start_us", "end_us", "env"])


@query
def task_sorted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "ts_us", "event_id", "value")
    return records.sorted_in_tasks(rows, ["user_id"], ["ts_us", "event_id"])


@query
def process_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the latest earlier view of its source, context and node."""
    on = ["source", "context", "node"]
    keys = [(F.col("event_id") % 2).alias("source"), F.col("user_id").alias("context"), F.expr("try_cast(get_json_object(props, '$.k') as bigint) % 3").alias("node")]
    errors = _events(spark, sf_dir, "error").select(*keys, "ts_us", "event_id")
    views = _events(spark, sf_dir, "view").select(*keys, "ts_us", F.col("event_id").alias("view_id"))
    found = asof.asof_join(errors, views, on, "ts_us", ["view_id"], DAY)
    return found.select("event_id", *on, "view_id", (F.col("ts_us") - F.col("matched_ts_us")).alias("age_us"))


@query
def inference_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End minus start of each frame: a view starts it and the vehicle's next event ends it."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", "ts_us", "event_type")
    with_end = with_row_before(rows.withColumn("back_us", -F.col("ts_us")).withColumn("back_id", -F.col("event_id")), ["user_id"], "back_us", "back_id", "ts_us", "end_us")
    return with_end.filter("event_type = 'view'").select("event_id", (F.col("end_us") - F.col("ts_us")).alias("latency_us"))


@query
def frame_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames lost between two of a vehicle: numbers that its next event skips, in steps of 40."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", "ts_us", F.floor(F.col("event_id") / 40).alias("frame"))
    before = with_row_before(rows, ["user_id"], "ts_us", "event_id", "frame", "last_frame")
    return before.filter(F.col("frame") - F.col("last_frame") > 1).select("event_id", (F.col("frame") - F.col("last_frame") - 1).alias("lost"))


@query
def message_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task of each conversation turn by an ordered rule table."""
    rules = [("[0-9]{4}-[0-9]{2}-[0-9]{2}", "report"), (r"\?", "question"), ("(?i)^[aeiou]", "followup")]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", records.route(F.col("text"), rules, "none").alias("task"))


@query
def serial_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slot for all: the first of the fair order."""
    return records.admitted(_events(spark, sf_dir, "signup").select("event_id", "user_id", "ts_us"), "user_id", "ts_us", "event_id", 1)


RULES = [
    ("mail", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+", "@"),
    ("secret", r"(secret|token|api_key|password)\s*[:=]"),
    ("license", r"[Ll]icense"),
    ("address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("long_number", r"[0-9]{13,}"),
]


#: The reference's lists (C3, C5, C6, C7, C17). (?U): \b and \s as Python has them for texts.
PRIVATE_RULES = [
    ("credential", r"(?U)\b(?:glpat-|ghp_|github_pat_)[A-Za-z0-9_-]{16,}"),
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("identity", r"(?U)\b(?:ou|oc|om)_[a-f0-9]{16,}\b|\bcli_[a-f0-9]{12,}\b"),
    ("user_path", r"(?iU)\b[A-Z]:[\\/]+Users[\\/]+[^\\/\s\"\x27]+"),
    ("authenticated_url", r"(?U)https?://[^/\s\"\x27]+:[^/@\s\"\x27]+@"),
]
TOKEN_RULES = [
    ("private_key_line", r"(?md)^-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("access_token", r"(?<![A-Za-z0-9_])(?:glpat-|gh[pousr]_|github_pat_|sk-proj-)[A-Za-z0-9_-]{20,}"),
]
TENANT_URL = r"(?U)https?://([^/\s<>\"\x27]+)/(?:sheets|docx|wiki)/([A-Za-z0-9]{20,})"
TENANT_HOSTS = ["example.feishu.cn", "fixture.invalid", "example.com"]
VEHICLE_ID = r"(?<![A-Za-z0-9_])[A-HJ-NPR-Z0-9]{17}(?![A-Za-z0-9_])"
VEHICLE_IDS = [
    "DEM0VEH1CLE000001", "DEM0VEH1CLE000002", "DEM0VEH1CLEX00001", "DEM0VEH1CLEX00002", "DEM0VEH1CLEX00003",
    "WBA123456789ABCDE", "WBA00000000000000", "L1234567890123456", "L2234567890123456",
]
PRIVATE_PARTS = ["private", "secrets", ".lark-cli", "data", "wtv081", "wheelhouse"]
PRIVATE_SUFFIXES = [".exe", ".dll", ".whl", ".zip", ".pyc", ".pem", ".key", ".pfx"]
#: One file's literal isn't an authenticated URL.
EXEMPT_FILE, EXEMPT_URL = "/test_download_scheduler.py", "https://" + "user:secret@test.download.invalid/input.bin"


def private_rules(text: str, path: Column | None = None) -> list[tuple[str, str | Column]]:
    """All content rules of the reference, for scan_rules, of a text column and its file's path."""
    seen = F.col(text)
    if path is not None:
        seen = F.when(path.endswith(EXEMPT_FILE), F.replace(seen, F.lit(EXEMPT_URL), F.lit(""))).otherwise(seen)
    inspected = [(n, seen.rlike(p) if n == "authenticated_url" else p) for n, p in PRIVATE_RULES]
    host = F.exists(F.regexp_extract_all(text, F.lit(TENANT_URL), F.lit(1)), lambda h: ~h.isin(TENANT_HOSTS))
    vehicle = F.exists(F.regexp_extract_all(text, F.lit(VEHICLE_ID), F.lit(0)), lambda v: ~v.isin(VEHICLE_IDS) & ~v.rlike("^[0-9]+$"))
    return [*inspected, ("tenant_resource", host), ("vehicle_id", vehicle), *TOKEN_RULES]


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that end with a line which a rule of the reference finds, or allows."""
    a = lambda start, sign, n: F.concat(F.lit(start), F.repeat(F.lit(sign), F.lit(n)))
    lines = [
        a("glpat-", "a", 16), a("ghp_", "a", 20), a("github_pat_", "a", 19), a("ghu_", "a", 20), a("sk-proj-", "a", 20),
        F.lit("-----BEGIN RSA PRIVATE KEY-----"), F.lit("x -----BEGIN PRIVATE KEY-----"), a("ou_", "a", 16), a("cli_", "b", 12),
        F.lit("C:\\Users\\someone"), F.lit("https://someone:word@host.invalid/x"), a("https://tenant.invalid/docx/", "T", 20),
        a("https://example.com/wiki/", "T", 20), F.lit("DEM0VEH1CLE000001 DEM0VEH1CLE000009"), F.lit("WBA00000000000000 12345678901234567"),
    ]
    line = F.get(F.array(*lines), F.pmod("doc_id", F.lit(len(lines))).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", "lang", "source").alias("kind"), F.concat_ws("\n", "text", line).alias("text"))


@query
def private_data_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.scan_rules(_planted(spark, sf_dir), "doc_id", "text", private_rules("text"))


@query
def private_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.scan_counts(_planted(spark, sf_dir), "kind", "text", private_rules("text"))


@query
def private_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with each forbidden part and suffix, and others that pass."""
    n, parts, suffixes = F.col("p_partkey"), F.array(*map(F.lit, PRIVATE_PARTS)), F.array(*map(F.lit, PRIVATE_SUFFIXES))
    kind = F.pmod(n, F.lit(17)).cast("int")
    dotfile = F.concat(F.lit("a/"), F.get(suffixes, F.pmod(n, F.lit(8)).cast("int")))
    path = F.when(kind < 6, F.concat(F.lit("a/"), F.get(parts, kind), F.lit("/b.py"))).when(kind < 14, F.concat(F.lit("a/b"), F.upper(F.get(suffixes, kind - 6)))).when(kind == 14, "a/.env.example").when(kind == 15, dotfile).otherwise("a/database/b.py")
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), integrity.path_verdict(path, PRIVATE_PARTS, PRIVATE_SUFFIXES).alias("verdict"))


@query
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.scan_rules(table(spark, sf_dir, "documents"), "doc_id", "text", RULES)


@query
def url_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    allowed = spark.createDataFrame([("www.ththre.example.com",), ("m.ththth.example.net",), ("blog.tiontion.example.com",)], "token string")
    found = integrity.disallowed_tokens(pages, "page_id", "url", r"https?://([^/?#]+)", allowed)
    return found.groupBy(F.col("token").alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query
def vin_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle-shaped tokens of seventeen signs; all digits and synthetic ones are fine."""
    docs = table(spark, sf_dir, "documents")
    token = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("TESTVEH"), F.lpad(F.col("doc_id").cast("string"), 10, "0"))).when(F.col("doc_id") % 3 == 1, F.lpad(F.col("doc_id").cast("string"), 17, "1")).otherwise("SYNTHETC000000001")
    text = docs.select("doc_id", F.concat_ws(" ", "text", token).alias("text"))
    allowed = spark.createDataFrame([("SYNTHETC000000001",)], "token string")
    found = integrity.disallowed_tokens(text, "doc_id", "text", r"(?<![A-Za-z0-9_])([A-HJ-NPR-Z0-9]{17})(?![A-Za-z0-9_])", allowed)
    return found.filter(~F.col("token").rlike("^[0-9]+$")).select("doc_id", "token")


@query
def path_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 11
    path = (
        F.when(kind == 0, F.concat(F.lit("/"), "p_name")).when(kind == 1, F.concat(F.lit("a/../"), "p_name")).when(kind == 2, F.concat(F.lit("a/__pycache__/"), "p_name"))
        .when(kind == 3, F.concat("p_name", F.lit(".PEM"))).when(kind == 4, F.lit("x/.env.local")).when(kind == 5, F.lit("x/.env.example"))
        .when(kind == 6, F.concat("p_name", F.lit("/.pem"))).when(kind == 7, F.concat("p_name", F.lit("/.key.key"))).when(kind == 8, F.concat("p_name", F.lit(".pem/")))
        .otherwise(F.concat(F.lit("src/"), "p_name", F.lit(".py")))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", integrity.path_verdict(F.col("path"), ["__pycache__", ".git", "secrets"], [".pem", ".key", ".pfx"]).alias("verdict"))


@query
def json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 6 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    rows = _events(spark, sf_dir).withColumn("_t", text).select("event_type", F.expr("try_parse_json(_t) IS NOT NULL").alias("ok"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("ok")).cast("long")).alias("invalid"))


@query
def syntax_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether small derived scripts parse; every third has an open bracket."""
    code = F.concat(F.lit("x = ["), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise("]"))
    return table(spark, sf_dir, "part").select("p_partkey", integrity.syntax_valid(code).alias("valid"))


@query
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("kind", F.concat_ws(".", "lang", "source"))
    return integrity.scan_counts(docs, "kind", "text", RULES)


@query
def request_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free request texts to vehicle and UTC window; without a date they need a question."""
    day = F.date_format("ts", "yyyy-MM-dd")
    a, b = F.date_format("ts", "HH:mm"), F.date_format(F.col("ts") + F.expr("INTERVAL 40 MINUTES"), "HH:mm")
    car = F.concat(F.lit("V"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    text = F.when(F.col("event_id") % 5 == 0, F.concat_ws(" ", F.lit("report for"), car, F.lit("from"), a, F.lit("to"), b)).otherwise(F.concat_ws(" ", F.lit("please report"), car, day, a, F.lit("to"), b))
    rows = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", text.alias("raw_text"))
    return normalize_requests(rows, "Asia/Shanghai")


def normalize_requests(rows: DataFrame, zone: str) -> DataFrame:
    """event_id, vehicle, start_us, end_us, status. An end before its start is the next day."""
    text = F.col("raw_text")
    day = F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    at = F.regexp_extract_all(text, F.lit(r"([0-9]{2}:[0-9]{2})"), F.lit(1))
    start = civil_to_utc_us(F.concat_ws(" ", day, F.try_element_at(at, F.lit(1))), zone)
    end = civil_to_utc_us(F.concat_ws(" ", day, F.try_element_at(at, F.lit(2))), zone)
    end = F.when(end < start, end + DAY).otherwise(end)
    vehicle = F.regexp_extract(text, r"\b(V[0-9]{6})\b", 1)
    status = F.when(vehicle == "", "no_vehicle").when(start.isNull() | end.isNull(), "needs_clarification").otherwise("ready")
    ready = status == "ready"
    return rows.select("event_id", vehicle.alias("vehicle"), F.when(ready, start).alias("start_us"), F.when(ready, end).alias("end_us"), status.alias("status"))


@query
def stream_point_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's hourly counts of distinct points, after its end; equal to the batch's."""
    from meridia.streaming.demo import hourly_points

    return hourly_points(spark, sf_dir)


def _frames_and_dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as frames of eight bytes (every tenth has three), and a dictionary of the nations in two
    versions, with some days that neither holds for and one entry that can't be read."""
    # the number's lowest 64 bits, of a product that may pass them
    number = F.col("event_id").cast("decimal(19,0)") * F.lit(1103515245 * 4093).cast("decimal(13,0)") + F.col("user_id").cast("decimal(19,0)") * F.lit(7919).cast("decimal(4,0)")
    low = F.pmod(number, F.lit(str(1 << 64)).cast("decimal(20,0)"))
    half = F.lit(1 << 32).cast("decimal(10,0)")
    halves = (F.call_function("div", low, half), (low % half).cast("long"))
    whole = F.unhex(F.concat(*(F.lpad(F.hex(c), 8, "0") for c in halves)))
    payload = F.when(F.col("event_id") % 10 == 0, F.substring(whole, 1, 3)).otherwise(whole)
    frames = _events(spark, sf_dir).select("event_id", (F.col("user_id") % 7).alias("message"), "ts_us", payload.alias("payload"))
    key, day = F.col("n_nationkey"), lambda n: F.lit(1704067200000000 + n * DAY)
    common = dict(signal=F.col("n_name"), message=F.col("n_regionkey").cast("long"), length=1 + key * 7 % 24, signed=key % 3 == 0, factor=F.lit(0.25), offset=F.lit(-10.0), unit=F.lit("m"))
    order = F.when(key == 24, "other").when(key % 2 == 0, "little").otherwise("big")
    one = dict(version=F.lit("1"), start=key * 5 % 50, byte_order=order, from_us=F.lit(None).cast("long"), to_us=day(11))
    two = dict(version=F.lit("2"), start=(key * 5 + 3) % 50, byte_order=order, from_us=day(14), to_us=F.lit(None).cast("long"))
    nations = table(spark, sf_dir, "nation")
    versions = [nations.select(*(c.alias(name) for name, c in (common | v).items())) for v in (one, two)]
    return frames, versions[0].unionByName(versions[1])


@query
def signal_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's signals by the dictionary's version of its time."""
    found = signals.decode(*_frames_and_dictionary(spark, sf_dir))
    return found.select("event_id", "message", "signal", "version", "raw", "value", "status")


@query
def signal_dictionary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each entry of the dictionary was met, by status."""
    frames, dictionary = _frames_and_dictionary(spark, sf_dir)
    return signals.dictionary_check(signals.decode(frames, dictionary), dictionary, [])


@query
def branch_barrier_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches of each job as streams; what fails or stays away closes the job too."""
    from meridia.streaming.demo import barrier

    return barrier(spark, sf_dir)


@query
def followup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions behind the report, one open at a time, by keyed state with timers."""
    from meridia.streaming.demo import followups

    return followups(spark, sf_dir)


@query
def receipted_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events persisted, verified and then published with receipts."""
    from meridia.streaming.demo import receipted

    return receipted(spark, sf_dir)


#: Rules of the query ``file_selection``, as a file of them has them.
IGNORE = ["# places", "*.html", "!en/*.html", "/de/", "!/de/6*", "**/1?", "es/[0-4]*", "!es/4?0", "fr/**/9*"]


@query
def file_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the pages as files of a tree, and whether ignore rules leave them out."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), "/$", "/index")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", ignored(F.col("path"), IGNORE).alias("ignored"))


@query
def request_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in several shapes, each with all its readings: written dates, relative days, days that
    may be months, texts without a date, and texts of two vehicles."""
    car = F.concat(F.lit("DEM0VEH1CLE"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    day = lambda shape: F.date_format("ts", shape)
    span = F.concat_ws(" 至 ", day("HH:mm"), F.date_format(F.col("ts") + F.expr("INTERVAL 40 MINUTES"), "HH:mm"))
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat_ws(" ", F.lit("日志分析"), car, day("yyyy-MM-dd"), span)).when(kind == 1, F.concat_ws(" ", car, F.lit("yesterday"), span, F.lit("UTC")))
        .when(kind == 2, F.concat_ws(" ", car, day("d/M"), span)).when(kind == 3, F.concat_ws(" ", car, span))
        .when(kind == 4, F.concat(car, F.lit("，"), day("yyyy年M月d日"), span)).otherwise(F.concat_ws(" ", car, F.lit("DEM0VEH1CLEX00001"), day("yyyy-MM-dd"), span))
    )
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("raw_text"), to_us(F.col("ts")).alias("received_us"))
    return read_requests(rows)


@query
def rolling_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the time since a user's event before, by type, over the last seven days of each
    day, from sketches of single days."""
    gaps = measures.with_gap(_events(spark, sf_dir), ["user_id"], "ts_us", "event_id")
    sketches = measures.day_sketches(gaps, ["event_type"], "ts_us", "gap_us")
    return measures.rolling_quantiles(sketches, ["event_type"], 7, {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99})
