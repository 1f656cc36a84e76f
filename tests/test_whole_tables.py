"""Queries over whole tables: every row of the input is answered for."""

import hashlib
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import compare, embed
from tracequarry.plans import registry

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@needs_tables
def test_every_customer_gets_a_window(spark):
    nation = {r["c_custkey"]: r["c_nationkey"] for r in of(spark, "customer").collect()}
    got = registry.queries()["pack_windows"](spark, SF).collect()
    assert Counter(r["c_custkey"] for r in got) == Counter(list(nation))
    sizes, held = Counter(r["window"] for r in got), Counter(nation.values())
    assert max(sizes.values()) <= 20
    for r in got:
        n = nation[r["c_custkey"]]
        assert r["window"].split(":")[0] == (f"g{n}" if held[n] >= 4 else "small")


def test_small_groups_share_windows(spark):
    rows = [(i, "a") for i in range(45)] + [(100 + i, f"s{i // 3}") for i in range(24)] + [(200 + i, "four") for i in range(4)]
    got = embed.pack_windows(spark.createDataFrame(rows, "k long, g string"), "k", "g").collect()
    assert sorted(r["k"] for r in got) == sorted(k for k, _ in rows)
    assert Counter(r["window"] for r in got) == {"ga:0": 15, "ga:1": 15, "ga:2": 15, "small:0": 12, "small:1": 12, "gfour:0": 4}


def redacted(text):
    words = "password|passcode|token|secret|otp|verification_code|api_key|cvv|card_number"
    for q in "'\"":  # a value of one kind of quotes holds no assignment of the other kind here
        text = re.sub(rf"(?ia)(\b[a-z0-9_]*(?:{words})[a-z0-9_]*\b\s*[:=]\s*){q}[^{q}\n]*{q}", rf"\1{q}[REDACTED]{q}", text or "")
    return re.sub(r"(?ia)\bBearer\s+[a-z0-9._~+\-/=]+", "Bearer [REDACTED]", text)


def test_texts_with_apostrophes_are_redacted(spark, tmp_path):
    texts = ["it's plain", "it's password = 'x y' and token: \"z\"", 'my_secret="don\'t"', None, "", "otp = '1'\napi_key: '2' isn't", "can't: Bearer a.b-c"]
    schema = "doc_id long, text string"
    spark.createDataFrame(list(enumerate(texts)), schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text_sha"] for r in registry.queries()["redact_text"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(redacted(t).encode()).hexdigest() for i, t in enumerate(texts)}
    assert redacted(texts[1]) == "it's password = '[REDACTED]' and token: \"[REDACTED]\""


@needs_tables
def test_every_document_is_redacted(spark):
    got = registry.queries()["redact_text"](spark, SF).collect()
    want = [(r["doc_id"], hashlib.sha256(redacted(r["text"]).encode()).hexdigest()) for r in of(spark, "documents").collect()]
    assert Counter(tuple(r) for r in got) == Counter(want)


@needs_tables
def test_every_task_is_in_one_report(spark):
    category = {r["o_custkey"]: r["category"] for r in registry.queries()["longitudinal_pairs"](spark, SF).collect()}
    reports = [r["report"] for r in registry.queries()["comparison_report"](spark, SF).collect()]
    assert Counter(int(x) for r in reports for x in re.findall(r"#### Task (\d+):", r)) == Counter(list(category))
    heads = {"improved": "Improved", "regressed": "Regressed", "persistent_fail": "Persistent failures", "stable_success": "Stable successes"}
    for c, head in heads.items():
        assert sum(int(re.search(rf"- {head} .*: (\d+)", r)[1]) for r in reports) == list(category.values()).count(c)


def test_one_report_for_each_group(spark):
    rows = [(i, i // 1000, c, "f", c in ("regressed", "stable_success"), 0.5, 1, c in ("improved", "stable_success"), 0.5, 1) for i, c in ((1, "improved"), (2, "regressed"), (1000, "improved"))]
    schema = "id long, part long, category string, task_family string, prev_success boolean, prev_score double, prev_steps int, curr_success boolean, curr_score double, curr_steps int"
    got = dict(compare.comparison_text(spark.createDataFrame(rows, schema).withColumn("task", F.lit("t")), "id", ["part"]).collect())
    assert {p: re.findall(r"Total samples: \d+|Task \d+", r) for p, r in got.items()} == {0: ["Total samples: 2", "Task 2", "Task 1"], 1: ["Total samples: 1", "Task 1000"]}


@needs_tables
def test_every_order_gives_a_job(spark):
    got = registry.queries()["comparison_jobs"](spark, SF).collect()
    known = {r["c_custkey"] for r in of(spark, "customer").collect()}
    want = Counter((f"M{r['o_custkey']:06d}", f"T{r['o_orderkey'] % 200}") for r in of(spark, "orders").collect() if r["o_custkey"] in known)
    assert Counter((r["edit_id"], r["task_id"]) for r in got) == want


@needs_tables
def test_every_shared_nation_is_found(spark):
    got = registry.queries()["split_intersection"](spark, SF).collect()
    sides = [{r[c] for r in of(spark, t).collect()} for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    assert sorted(r["key"] for r in got) == sorted(sides[0] & sides[1])
