"""Queries of pages and what they link to as one corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import documents as docs
from lectern.operators import pages, tables
from lectern.plans import query
from lectern.sources.readers import table


@query(
    """SELECT 'page' AS source_type, count(*) AS n, sum(length(url))::BIGINT AS chars FROM pages UNION ALL
SELECT 'attachment', count(DISTINCT href), sum(length(href))::BIGINT FROM (SELECT DISTINCT href FROM (SELECT unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages))"""
)
def pages_and_links(spark, d) -> DataFrame:
    """Pages and what they link to as one corpus, each link once."""
    p = table(spark, d, "pages")
    attached = tables.keep_first(pages.links(p).select("href", "page_id", "pos"), ["href"], ["page_id", "pos"]).select(F.col("href").alias("url"), F.lit("attachment").alias("source_type"))
    both = docs.with_attachments(p.select("page_id", "url", F.lit("page").alias("source_type")), attached)
    return both.groupBy("source_type").agg(F.count("*").alias("n"), F.sum(F.length("url")).alias("chars"))
