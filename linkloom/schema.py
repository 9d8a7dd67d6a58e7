"""Schemas and fixed vocabulary shared by every job."""

from pyspark.sql import types as T

# Landed table layouts. Nothing in this package infers a schema.
PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
FINDING = T.StructType(
    [
        T.StructField("input", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
    ]
)
FINDING_COLUMNS = FINDING.fieldNames()

# DDL for the JSON and XML payloads read by the ingest jobs.
CDX_ARRAY = "array<array<string>>"
CDX_LINE = "url string, timestamp string, _bad string"
INDEX_LIST = "array<struct<id:string,name:string,`cdx-api`:string>>"
REPORT = "detected_urls array<struct<url:string>>"
PAGED = "has_next boolean, url_list array<struct<url:string>>, _bad string"
SITEMAP = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"

# Every kind a finding can carry, in reporting order.
KINDS = [
    "url",
    "href",
    "javascript",
    "linkfinder",
    "form",
    "upload-form",
    "subdomains",
    "aws",
    "robots",
    "sitemap",
    "other-sources",
    "network",
    "render",
    "raw",
]
