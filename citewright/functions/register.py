"""The functions under SQL names, so that every operator can be used from spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

from citewright.functions import text as T
from citewright.functions import urls as U


def register(spark: SparkSession) -> list[str]:
    """Register the functions that need Python; the native ones are temporary SQL functions."""
    spark.udf.register("cw_decode_references", T.decode_references)
    spark.udf.register("cw_normalise", T._normalise)
    spark.udf.register("cw_decode_labels", U._decode_labels)
    native = {
        "cw_domain(url STRING)": "split(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\\\.', ''), ':', 2)[0]",
        "cw_norm_url(url STRING)": "regexp_replace(lower(url), '/+$', '')",
        "cw_content_hash(t STRING)": "substring(sha2(t, 256), 1, 16)",
        "cw_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": "if(size(a) = size(b), aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), 0D)",
        "cw_idf(n DOUBLE, df DOUBLE)": "ln((n - df + 0.5D) / (df + 0.5D) + 1D)",
    }
    for head, body in native.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return ["cw_decode_references", "cw_normalise", "cw_decode_labels", *[h.split("(")[0] for h in native]]
