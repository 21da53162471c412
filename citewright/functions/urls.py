"""URL functions and query expansion. Native columns; Python only for IPv6 literals and punycode."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

SCHEME = "^([a-zA-Z][a-zA-Z0-9+.-]*):"
NETLOC = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def domain(url: Column) -> Column:
    """Lower-cased authority without www. and port; with userinfo the part before its colon stays."""
    authority = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), NETLOC, 1))
    return F.split(F.regexp_replace(authority, "^www\\.", ""), ":", 2)[0]


def host(url: Column) -> Column:
    """Lower-cased host without userinfo and port; brackets of IPv6 literals go."""
    authority = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), NETLOC, 1))
    bare = F.regexp_replace(authority, "^.*@", "")
    return F.when(bare.startswith("["), F.regexp_extract(bare, "^\\[([^\\]]*)\\]", 1)).otherwise(F.split(bare, ":", 2)[0])


def normal_form(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), "/+$", "")


def banned(dom: Column, names: list[str]) -> Column:
    """Equal to a banned name or below it."""
    low = [n.lower() for n in names]
    hit = F.lit(False)
    for n in low:
        hit = hit | (dom == n) | dom.endswith("." + n)
    return hit


@F.pandas_udf(BooleanType())
def _ipv6_public(s: pd.Series) -> pd.Series:
    def one(x):
        try:
            ip = ipaddress.ip_address(x)
        except ValueError:
            return None
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)

    return s.map(one, na_action="ignore")


#: IPv4 ranges that are not public (first address, prefix length).
NOT_PUBLIC = [("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]
IPV4 = "^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def once(value: Column, use) -> Column:
    """use(value), with value worked out once however often use() names it: as columns are expressions, each mention would else be a copy of it in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def url_safety(url: Column) -> Column:
    """ok, or why a URL must not be read: only http(s) with public hosts pass."""
    raw = F.coalesce(url, F.lit(""))
    h = host(url)
    facts = F.struct(F.lower(F.regexp_extract(raw, SCHEME, 1)).alias("scheme"), h.alias("host"), _ipv6_public(F.when(h.contains(":"), h)).alias("six"))

    def number(h: Column) -> Column:
        return F.when(h.rlike(IPV4), once(F.split(h, "\\."), lambda o: o[0].cast("long") * 16777216 + o[1].cast("long") * 65536 + o[2].cast("long") * 256 + o[3].cast("long")))

    def inner(n: Column) -> Column:
        hit = F.lit(False)
        for first, bits in NOT_PUBLIC:
            low = int(ipaddress.ip_address(first))
            hit = hit | n.between(low, low + 2 ** (32 - bits) - 1)
        return hit

    def decide(x: Column) -> Column:
        h, scheme = x["host"], x["scheme"]
        literal = h.contains(":")
        by_name = (
            F.when(literal & (x["six"] == F.lit(False)), F.concat(F.lit("non_global_ip:"), h))
            .when(literal & (x["six"] == F.lit(True)), "ok")
            .when(~h.contains("."), "bare_hostname")
            .otherwise("ok")
        )
        by_number = once(number(h), lambda n: F.when(n.isNull(), by_name).when(inner(n), F.concat(F.lit("non_global_ip:"), h)).otherwise("ok"))
        return (
            F.when(~scheme.isin("http", "https"), F.concat(F.lit("disallowed_scheme:"), F.when(scheme == "", "none").otherwise(scheme)))
            .when(h == "", "empty_host")
            .when(h.isin("localhost", "localhost.localdomain"), "localhost")
            .otherwise(by_number)
        )

    return F.when(raw == "", "empty_url").otherwise(once(facts, decide))


@F.pandas_udf(StringType())
def _decode_labels(s: pd.Series) -> pd.Series:
    def label(x: str) -> str:
        if not x.startswith("xn--"):
            return x
        try:
            return x.encode("ascii").decode("idna")
        except UnicodeError:
            return x

    return s.map(lambda d: ".".join(map(label, d.split("."))), na_action="ignore")


def normal_domain(dom: Column) -> Column:
    """Lower case, trimmed; punycode labels decoded where they can be."""
    low = F.lower(F.trim(dom))
    coded = low.contains("xn--")
    return F.when(coded, _decode_labels(F.when(coded, low))).otherwise(low)


def expand_query(q: Column, retry: Column | None = None) -> Column:
    """The searches for a question; on a retry, other ones."""
    low = F.trim(F.lower(q))
    first = F.array_compact(
        F.array(
            q,
            F.when(~low.startswith("what is") & ~low.startswith("what are"), F.concat(F.lit("What is "), q)),
            F.when(~low.startswith("explain"), F.concat(F.lit("Explain "), q)),
        )
    )
    if retry is None:
        return first
    return F.when(retry, F.array(q, F.concat(q, F.lit(" details")), F.concat(q, F.lit(" evidence facts")))).otherwise(first)


def chunk_url(doc_id: Column, index: Column) -> Column:
    """The address of a chunk of the own corpus."""
    return F.concat(F.lit("https://corpus.local/doc/"), F.replace(F.url_encode(doc_id), F.lit("+"), F.lit("%20")), F.lit("#chunk-"), index.cast("string"))
