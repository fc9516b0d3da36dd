"""Declared schemas for site configs, extracted records, jobs and runs.

All in-flight record fields are free text; empty string and null are treated
alike everywhere through ``functions.text.ne``.
"""

from pyspark.sql import types as T

S = T.StringType()

PAGINATION_SCHEMA = T.StructType([
    T.StructField("strategy", S),
    T.StructField("param", S),
    T.StructField("start", T.IntegerType()),
    T.StructField("increment", T.IntegerType()),
    T.StructField("max_pages", T.IntegerType()),
    T.StructField("next_selector", S),
    T.StructField("load_more_selector", S),
    T.StructField("delay_ms", T.IntegerType()),
])

SITE_SCHEMA = T.StructType([
    T.StructField("id", S),
    T.StructField("name", S),
    T.StructField("url", S),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("delay_ms", T.IntegerType()),
    T.StructField("extract_hint", S),
    T.StructField("tab_urls", T.ArrayType(S)),
    T.StructField("pagination", PAGINATION_SCHEMA),
])

LISTING_FIELDS = ["title", "reference", "issuer", "category", "deadline", "briefing_date",
                  "budget", "status", "description", "url", "location", "contact",
                  "tender_type"]
DETAIL_FIELDS = ["full_description", "requirements", "submission_method", "contact_name",
                 "contact_email", "contact_phone", "briefing_date", "additional_info",
                 "tender_type"]
FILE_FIELDS = ["full_description", "requirements", "submission_method", "contact_name",
               "contact_email", "contact_phone", "deadline", "budget", "additional_info"]

LISTING_SCHEMA = T.StructType([T.StructField(f, S) for f in LISTING_FIELDS])
DETAIL_SCHEMA = T.StructType([T.StructField(f, S) for f in DETAIL_FIELDS])
FILE_SCHEMA = T.StructType([T.StructField(f, S) for f in FILE_FIELDS])

DOC_REF_SCHEMA = T.StructType([T.StructField("name", S), T.StructField("url", S)])

# Fields the ordered enrichment merge fills with the first non-empty value.
MERGE_FIRST_FIELDS = ["contact_name", "contact_email", "contact_phone", "submission_method",
                      "requirements", "briefing_date", "additional_info", "tender_type"]

TENDER_COLUMNS = (["fingerprint", "site_id", "source_site"] + LISTING_FIELDS
                  + [f for f in DETAIL_FIELDS if f not in LISTING_FIELDS
                     and f != "full_description"])
TENDER_SCHEMA = T.StructType(
    [T.StructField(c, S) for c in TENDER_COLUMNS]
    + [T.StructField("document_urls", T.ArrayType(DOC_REF_SCHEMA)),
       T.StructField("scraped_at", T.TimestampType())])

# Append-only lifecycle events of queue jobs and runs; the current state of an
# id is derived by ``operators.jobs.current_state``.
JOB_EVENT_SCHEMA = T.StructType([
    T.StructField("id", S),
    T.StructField("site_id", S),
    T.StructField("triggered_by", S),
    T.StructField("status", S),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("error", S),
])

# Enumerations named in the listing prompt.
STATUS_VALUES = ["Open", "Closing Soon", "Closed", "Awarded", "Unknown"]
TENDER_TYPE_VALUES = ["RFQ", "RFP", "RFI", "EOI", "Tender", "Unknown"]
