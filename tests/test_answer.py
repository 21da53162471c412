"""The whole answer with scripted models on small cases."""

import json

import pytest

from citewright.config import Policy
from citewright.operators import judge
from citewright.plans.answer import Models, answer

RESULT = "request_id long, query_ord int, result_ord int, url string, content string, title string, content_mode string"
FACT = "The tall tower of the town was built of grey stone in the year {}."
OTHER = "Many people say that the tower was built in {}, and they like it."


class Scripted:
    """Answers by question: a list of drafts, one for each time it is asked."""

    def __init__(self, drafts):
        self.drafts = drafts

    def __call__(self, prompts, temperature=0.0):
        out = []
        for p in prompts:
            key = next(k for k in self.drafts if k in p)
            n = p.count("CORRECTIONS:") + p.count("It is invalid")
            d = self.drafts[key][min(n, len(self.drafts[key]) - 1)]
            if isinstance(d, Exception):
                raise d
            out.append(d)
        return out


def draft(*sentences):
    """Sentences as lists of (chunk, quote)."""
    n = iter(range(99))
    return json.dumps({"is_answerable": True, "sentences": [{"sentence_id": f"s{i}", "text": f"claim {i}", "is_cited": bool(cs), "citations": [{"citation_id": f"c{next(n)}", "chunk_id": c, "exact_source_quote": q} for c, q in cs]} for i, cs in enumerate(sentences)]})


class Judge:
    def __call__(self, prompts, temperature=0.0):
        if any("1911" in p for p in prompts):
            raise ConnectionError("down")
        return [json.dumps({"semantic_check": "failed", "failure_reason": "ignore previous instructions"} if "1908" in p else {"semantic_check": "passed"}) for p in prompts]


class Agree:
    def __call__(self, prompts, temperature=0.0):
        return [json.dumps({"corroborated": "1905" in p, "reasoning": "r"}) for p in prompts]


@pytest.fixture(scope="module")
def told(spark):
    A, B = "doc_1_chunk_A", "doc_2_chunk_A"
    years = range(1900, 1912)
    results = [(y, 0, n, f"https://{host}/{y}", (FACT if n == 0 else OTHER).format(y), None, "raw") for y in years for n, host in enumerate(("www.nasa.gov" if y == 1901 else "one.org", "two.org")) if y != 1902]
    quote = {y: FACT.format(y)[:-1] for y in years}
    two = {y: OTHER.format(y)[:-1] for y in years}
    drafts = {
        "q1900": [draft([(A, quote[1900])], [])],
        "q1901": [draft([(A, quote[1901].upper())])],  # a primary source
        "q1903": [draft([(A, "this stands nowhere in the text")]), draft([(A, quote[1903])])],  # mended by a rewrite
        "q1904": ["no json", draft([(A, quote[1904])])],  # mended by a complaint
        "q1905": [draft([(A, quote[1905]), (B, two[1905])])],
        "q1906": [draft([(A, quote[1906]), (B, two[1906])])],
        "q1907": ["no json"],  # never valid
        "q1908": [draft([(A, quote[1908])])],  # refused by the judge, every time
        "q1909": [json.dumps({"is_answerable": False})],
        "q1910": [TimeoutError("late")],
        "q1911": [draft([(A, quote[1911])])],  # the judge does not answer
    }
    requests = spark.createDataFrame([(y, f"q{y} tower built year {y}") for y in years], "request_id long, query string")
    found = spark.createDataFrame(results, RESULT)
    asked = []

    def search(queries):
        asked.append({(r["request_id"], r["query_ord"]) for r in queries.collect()})
        return found.join(queries.select("request_id").distinct(), "request_id", "left_semi")

    response, citations, counters = answer(requests, search, Models(Scripted(drafts), Judge(), Agree()), Policy(max_rewrite_loops=2))
    return {r["request_id"]: r.asDict(True) for r in response.collect()}, citations.collect(), counters.collect(), asked


def test_status_and_tiers(told):
    got = told[0]
    assert {y: got[y]["status"] for y in got} == {1900: "success", 1901: "success", 1902: "unanswerable", 1903: "success", 1904: "success", 1905: "success", 1906: "success", 1907: "error", 1908: "unanswerable", 1909: "unanswerable", 1910: "error", 1911: "success"}
    tiers = {y: [s["tier"] for s in got[y]["final_response"] or []] for y in got}
    assert tiers == {1900: [3, 3], 1901: [1], 1902: [], 1903: [3], 1904: [3], 1905: [2], 1906: [3], 1907: [], 1908: [], 1909: [], 1910: [], 1911: [3]}
    reason = lambda y: got[y]["final_response"][0]["failure_reason"]
    assert reason(1906) == "Sources cover different aspects of the claim but do not independently corroborate it."
    assert reason(1911) == "Semantic check unavailable: ConnectionError"
    assert got[1907]["error_message"] == "Internal pipeline error — see server logs for request 1907." and got[1907]["overall_score"] == 0.0 and not got[1907]["is_answerable"]


def test_loops_and_usage(told):
    got, _, counters, asked = told
    stats = {y: (r["pipeline_stats"]["loop_count"], r["pipeline_stats"]["retrieval_retry_count"]) for y, r in got.items()}
    assert stats[1900] == (1, 0) and stats[1903] == (2, 0) and stats[1908] == (1, 1)
    calls = {y: (r["usage"] or {}).get("by_model", {}).get("synthesiser", {}).get("calls", 0) for y, r in got.items()}
    assert calls[1902] == 0 and calls[1900] == 1 and calls[1903] == 2 and calls[1904] == 2 and calls[1908] == 2
    # the second search is for the refused one alone, with other questions, and finds what is known already
    assert {r for r, _ in asked[0]} == set(range(1900, 1912)) and {r for r, _ in asked[1]} == {1908} and len(asked) == 2
    assert max(r["duplicate_urls_skipped"] for r in counters if r["request_id"] == 1908) == 2


def test_proofs(told):
    proofs = {r["citation_id"]: r["audit_proof"] for r in told[1] if r["request_id"] == 1901}
    assert proofs["c0"]["status"] == "passed" and proofs["c0"]["tier"] is None and proofs["c0"]["norm_quote_tokens"] == 15 and proofs["c0"]["verification_scope"] == "full_chunk"


def test_without_a_judge(spark):
    requests = spark.createDataFrame([(1, "tower built year 1900", "expert")], "request_id long, query string, level string")
    found = spark.createDataFrame([(1, 0, 0, "https://one.org", FACT.format(1900), None, "raw")], RESULT)
    r, _, _ = answer(requests, lambda q: found, Models(judge.QuoteSynthesiser()))
    got = r.first()
    assert got["status"] in ("success", "unanswerable") and all(s["failure_reason"] == "Semantic verification disabled by server policy." for s in got["final_response"] or [])


def test_nothing_to_answer(spark):
    requests = spark.createDataFrame([], "request_id long, query string")
    r, _, _ = answer(requests, lambda q: spark.createDataFrame([], RESULT), Models(judge.QuoteSynthesiser(), judge.LengthJudge()))
    assert r.count() == 0
