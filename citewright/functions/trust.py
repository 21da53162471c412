"""Domain trust and quality scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citewright.config import Policy
from citewright.functions.text import strip

#: Domains by class.
PRIMARY = (
    "europa.eu un.org worldbank.org imf.org oecd.org unesco.org wto.org w3.org whatwg.org ietf.org rfc-editor.org iso.org iec.ch unicode.org ecma-international.org "
    "docs.python.org developer.mozilla.org nodejs.org go.dev rust-lang.org kubernetes.io docs.oracle.com learn.microsoft.com developer.apple.com developer.android.com postgresql.org"
).split()
REFERENCE = "arxiv.org pubmed.ncbi.nlm.nih.gov nature.com science.org ieee.org acm.org scholar.google.com en.wikipedia.org britannica.com".split()
LOW_QUALITY = "reddit.com quora.com answers.yahoo.com medium.com blogspot.com".split()
GOVERNMENT_TOP = ".gov .mil .int".split()
GOVERNMENT_SECOND = (
    "gov.uk gov.au gov.in gov.br gov.za gov.sg gov.hk gov.il gov.ie gov.pl gov.pt gov.it gov.gr gov.sa gob.mx gob.es gob.ar gob.cl gob.pe gob.pa gouv.fr govt.nz gc.ca canada.ca admin.ch bund.de gv.at overheid.nl"
).split()
#: Fixed value: what makes a chunk rich in facts.
DATA_MARKERS = "(?i)[0-9]+\\.?[0-9]*\\s*%|[0-9]{4}|(?:fig(?:ure)?|table)\\s*[0-9]|https?://"


@dataclass(frozen=True)
class DomainSets:
    authoritative: frozenset[str]
    low: frozenset[str]
    primary: frozenset[str]


def domain_sets(policy: Policy) -> DomainSets:
    """Defaults less exclusions, plus what the policy adds. Added names are taken as written; exclusions in lower case."""
    out = {x.strip().lower() for x in policy.exclude_default_domains}
    return DomainSets(
        frozenset((set(PRIMARY) | set(REFERENCE)) - out | set(policy.authoritative_domains)),
        frozenset(set(LOW_QUALITY) - out | set(policy.low_quality_domains)),
        frozenset(set(PRIMARY) - out | set(policy.authoritative_domains)),
    )


def government(dom: Column) -> Column:
    hit = F.lit(False)
    for t in GOVERNMENT_TOP:
        hit = hit | dom.endswith(t)
    for s in GOVERNMENT_SECOND:
        hit = hit | (dom == s) | dom.endswith("." + s)
    return hit


def suffixes(dom: Column) -> Column:
    """A domain and all domains above it: a.b.c, b.c, c."""
    parts = F.split(dom, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def member(dom: Column, names: frozenset[str]) -> Column:
    """Whether a domain or one above it is listed: one hash look-up for each suffix."""
    return F.exists(suffixes(dom), lambda s: s.isin(sorted(names))) if names else F.lit(False)


def policy_table(spark: SparkSession, sets: DomainSets) -> DataFrame:
    rows = [(d, "authoritative") for d in sorted(sets.authoritative)] + [(d, "low") for d in sorted(sets.low)] + [(d, "primary") for d in sorted(sets.primary)]
    return spark.createDataFrame(rows, "name string, class string")


def suffix_join(domains: DataFrame, policy: DataFrame, col: str = "domain") -> DataFrame:
    """Dot-suffix matching as an equi-join: every domain meets the listed names at or above it."""
    return domains.withColumn("name", F.explode(suffixes(F.col(col)))).join(F.broadcast(policy), "name")  # a policy holds at most 300 names


def primary(dom: Column, sets: DomainSets) -> Column:
    return government(dom) | member(dom, sets.primary)


def authoritative(dom: Column, sets: DomainSets) -> Column:
    return government(dom) | member(dom, sets.authoritative)


def source_score(dom: Column, sets: DomainSets) -> Column:
    return (
        F.when(government(dom), 0.9)
        .when(dom.isin(sorted(sets.authoritative)), 0.9)
        .when(dom.isin(sorted(sets.low)), 0.3)
        .when(member(dom, sets.authoritative), 0.85)
        .when(member(dom, sets.low), 0.3)
        .otherwise(0.5)
    )


def chunk_score(text: Column) -> Column:
    """Length from 0.2 at 40 characters to 1 at 500, and 0.1 for each sign of data, at most 0.3."""
    n = F.length(strip(text))
    by_length = F.when(n < 40, F.lit(0.1)).otherwise(F.least(F.lit(1.0), F.lit(0.2) + (n - 40) * F.lit(0.8) / F.lit(460)))
    bonus = F.least(F.lit(0.3), F.regexp_count(text, F.lit(DATA_MARKERS)) * F.lit(0.1))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), by_length + bonus), 4))


def combined_score(source: Column, chunk: Column, policy: Policy = Policy()) -> Column:
    return F.round(F.lit(float(policy.source_weight)) * source + F.lit(float(policy.chunk_weight)) * chunk, 4)


def score_chunks(chunks: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """request_id, text, domain, retrieval_pos -> quality columns and the order by quality; weak chunks go."""
    sets = domain_sets(policy)
    # a generator, so that the threshold below does not copy the scores into a filter
    scores = F.struct(source_score(F.col("domain"), sets).alias("source_quality_score"), chunk_score(F.col("text")).alias("chunk_quality_score"))
    out = chunks.select("*", F.inline(F.array(scores)))
    out = out.withColumn("quality_score", combined_score(F.col("source_quality_score"), F.col("chunk_quality_score"), policy)).filter(F.col("quality_score") >= policy.quality_threshold)
    return out.withColumn("scored_pos", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("quality_score"), "retrieval_pos")))
