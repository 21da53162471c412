"""A service from settings: limits, cache, backends, audit."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citewright.config import Settings
from citewright.operators import judge
from citewright.plans.answer import Models
from citewright.plans.service import Service, per_minute, resolve

FACT = "The tall tower of the town was built of grey stone in the year {}."
T0 = datetime(2024, 1, 1)


def requests(spark, *rows):
    return spark.createDataFrame([(i, t, q, T0 + timedelta(seconds=s)) for i, t, q, s in rows], "request_id long, tenant string, query string, ts timestamp")


def at(seconds):
    return F.lit(T0 + timedelta(seconds=seconds)).cast("timestamp")


@pytest.fixture
def service(spark, tmp_path):
    def web(queries):
        return queries.filter("query_ord = 0").select("request_id", "query_ord", F.lit(0).alias("result_ord"), F.lit("https://one.org/a").alias("url"), F.lit(FACT.format(1900)).alias("content"), F.lit("t").alias("title"), F.lit("raw").alias("content_mode"))

    def broken(queries):
        raise OSError("down")

    settings = Settings(search_backend="both", rate_limit="2/minute", cache_ttl_s=100, cache_size=2, audit_retention=2, llm_api_key="secret")
    return Service(spark, settings, Models(judge.QuoteSynthesiser(), judge.OverlapJudge(0.0)), web=web, corpus=broken, cache=str(tmp_path / "cache"), audit=str(tmp_path / "audit"))


def test_limits_cache_and_audit(spark, service):
    q = "tower built in the year 1900 stone"
    out, refused = service.run(requests(spark, (1, "a", q, 0), (2, "a", q, 1), (3, "a", q, 2), (4, "b", q, 3)), at(10))
    got = {r["request_id"]: (r["cached"], json.loads(r["body"])["status"]) for r in out.collect()}
    assert got == {1: (False, "success"), 2: (True, "success"), 4: (False, "success")}  # tenants share nothing
    assert [tuple(r) for r in refused.collect()] == [(3, "a")]
    out, refused = service.run(requests(spark, (5, "a", q, 70)), at(80))
    assert [(r["request_id"], r["cached"]) for r in out.collect()] == [(5, True)] and refused.count() == 0
    out, _ = service.run(requests(spark, (6, "a", q, 200)), at(200))  # expired
    assert [(r["request_id"], r["cached"]) for r in out.collect()] == [(6, False)]
    assert service.entries().count() == 1
    assert {r["request_id"] for r in service.trails().select("request_id").distinct().collect()} == {6, 4} or service.trails().select("request_id").distinct().count() == 2
    assert ("llm_api_key", "***") in service.status()


def test_all_backends_down(spark, service):
    def broken(queries):
        raise OSError("down")

    service.backends = [broken]
    found = service.search(requests(spark, (1, "a", "q", 0)).select("request_id", F.lit(0).alias("query_ord"), "query"))
    assert [tuple(r) for r in found.select("url", "error").collect()] == [(None, "OSError: down")]


def test_settings_decide(spark):
    assert per_minute("20/minute") == 20 and per_minute("1/second") == 60 and per_minute("90/hour") == 2 and per_minute("0/minute") == 0
    with pytest.raises(ValueError):
        per_minute("many")
    providers = [("cloud", "llm_api_key", lambda k: ("cloud", k)), ("local", "", lambda k: ("local", k))]
    assert resolve(providers, Settings(llm_api_key="x")) == ("cloud", "x") and resolve(providers, Settings()) == ("local", "")
    with pytest.raises(ValueError, match="cloud"):
        resolve(providers[:1], Settings())
    with pytest.raises(ValueError):
        Service(spark, Settings(search_backend="web"), Models(judge.QuoteSynthesiser()))
