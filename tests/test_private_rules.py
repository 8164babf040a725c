"""One hit of each rule of the reference, and what its lists allow."""

from pyspark.sql import functions as F

from meridia.operators import integrity
from meridia.plans import catalog

HITS = {
    "gl" + "pat-" + "a" * 16: ["credential"],
    "gh" + "p_" + "a" * 20: ["credential", "access_token"],
    "x" + "gh" + "p_" + "a" * 20: [],
    "github" + "_pat_" + "a" * 15: [],
    "gh" + "u_" + "a" * 20: ["access_token"],
    "gh" + "u_" + "a" * 19: [],
    "sk-" + "proj-" + "a" * 20: ["access_token"],
    "one\n-----BEGIN EC " + "PRIVATE KEY-----": ["private_key", "private_key_line"],
    "one -----BEGIN " + "PRIVATE KEY-----": ["private_key"],
    "ou_" + "0a" * 8: ["identity"],
    "cli_" + "0" * 12: ["identity"],
    "see c:/Users/someone/x": ["user_path"],
    "C:\\\\Users\\\\someone": ["user_path"],
    "https://someone:word@host.invalid/": ["authenticated_url"],
    catalog.EXEMPT_URL: ["authenticated_url"],
    "http://tenant.invalid/sheets/" + "T" * 20: ["tenant_resource"],
    "http://tenant.invalid/sheets/" + "T" * 19: [],
    "http://fixture.invalid/docx/" + "T" * 20: [],
    "LSVAA4182E2123456,": ["vehicle_id"],
    "LSVAA4182E2123456x 12345678901234567 " + " ".join(catalog.VEHICLE_IDS): [],
}


def test_each_content_rule_of_the_reference(spark):
    docs = spark.createDataFrame(list(enumerate(HITS)), "k long, text string")
    found = {k: [] for k in range(len(HITS))}
    for r in integrity.scan_rules(docs, "k", "text", catalog.private_rules("text")).orderBy("place").collect():
        found[r["k"]].append(r["rule"])
    assert found == dict(enumerate(HITS.values()))


def test_one_literal_of_one_file_is_exempt(spark):
    rows = [("a/test_download_scheduler.py", catalog.EXEMPT_URL), ("a/test_download_scheduler.py", "https://a:b@c/"), ("a/other.py", catalog.EXEMPT_URL)]
    docs = spark.createDataFrame(rows, "path string, text string")
    hits = integrity.scan_rules(docs, "path", "text", catalog.private_rules("text", F.col("path"))).collect()
    assert sorted((r["path"], r["rule"]) for r in hits) == [("a/other.py", "authenticated_url"), ("a/test_download_scheduler.py", "authenticated_url")]


def test_each_path_rule_of_the_reference(spark):
    want = {f"a/{p}/b.py": "part" for p in ("private", "secrets", ".lark-cli", "data", "wtv081", "wheelhouse")}
    want |= {f"a/b.{s}": "suffix" for s in ("exe", "DLL", "whl", "Zip", "pyc", "pem", "key", "pfx")}
    want |= {"/a": "absolute", "a/../b": "parent", "a\\b": "backslash", "a:b": "colon", "a/.env.x": "environment", "a/.env.example": "ok", "database/b.py": "ok"}
    paths = spark.createDataFrame([(p,) for p in want], "path string")
    got = paths.select("path", integrity.path_verdict(F.col("path"), catalog.PRIVATE_PARTS, catalog.PRIVATE_SUFFIXES).alias("v")).collect()
    assert {r["path"]: r["v"] for r in got} == want
