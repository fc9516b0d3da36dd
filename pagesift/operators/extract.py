"""Record extraction.

* Rule extractor (section rules, reference numbers, enum normalisation,
  closed/awarded filter) — built-in expressions only.
* Pluggable batch inference: prompt rows in, raw reply rows out, through one
  ``mapInPandas`` pass with a user-supplied ``fn(list[str]) -> list[str]``
  (no network client is shipped). Failed rows carry an error and never fail
  the job.
* ``extract_listings``: chunks → prompts → replies → parsed records →
  absolute URLs → fingerprints → first-seen per page.
"""

from __future__ import annotations

import re
from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonreply import SPAN, json_strict_valid, parse_list_reply, parse_object_reply, reply_span, valid_json
from ..functions.text import detail_prompt, file_prompt, fingerprint, listing_prompt, py_strip
from ..functions.urls import resolve_record_url
from ..schemas import DETAIL_SCHEMA, FILE_SCHEMA, LISTING_SCHEMA, STATUS_VALUES, TENDER_TYPE_VALUES
from ..session import stage
from .dedupe import first_seen

# Section headers to skip and to keep (only when a page labels
# its sections), and the statuses dropped from results.
EXCLUDED_SECTIONS = ["Result", "Keputusan", "Cancellation", "Pembatalan", "Successful Bidder",
                     "Berjaya", "Jadual Penyertaan"]
INCLUDED_SECTIONS = ["Quotation Proposal", "Tender Proposal", "Sebut Harga",
                     "Tawaran Perolehan", "Active Tenders", "Open Tenders"]
DROPPED_STATUSES = ["Closed", "Awarded"]

# Reference numbers such as IIUM/DEV/3/2026, PTPTN/2026/SH11, KDN/T/001/2026.
REFERENCE_RE = r"[A-Z]{2,}(?:/[A-Z0-9]+){2,}"
# The same matches for the JVM engine, starting only where an upper-case run
# starts and never backtracking into it, so long capital runs cost linear time.
# The segment group is possessive too: Java then matches it in a loop, so any
# number of segments fits the stack.
REFERENCE_RE_JVM = r"(?<![A-Z])[A-Z]{2,}+(?:/[A-Z0-9]++){2,}+"


def _alt(words: Sequence[str]) -> str:
    return "(?i)(" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


EXCLUDED_RE = _alt(EXCLUDED_SECTIONS)
INCLUDED_RE = _alt(INCLUDED_SECTIONS)


def reference_numbers(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(REFERENCE_RE_JVM), 0)


def is_excluded_section(header) -> Column:
    h = F.col(header) if isinstance(header, str) else header
    return F.coalesce(h.rlike(EXCLUDED_RE), F.lit(False))


def is_included_section(header) -> Column:
    h = F.col(header) if isinstance(header, str) else header
    return F.coalesce(h.rlike(INCLUDED_RE), F.lit(False))


def normalise_enum(c, values: Sequence[str]) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isin(*values), x).otherwise(F.lit("Unknown"))


def normalise_status(c) -> Column:
    return normalise_enum(c, STATUS_VALUES)


def normalise_tender_type(c) -> Column:
    return normalise_enum(c, TENDER_TYPE_VALUES)


def drop_closed(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(~F.coalesce(F.col(status).isin(*DROPPED_STATUSES), F.lit(False)))


def status_from_text(line) -> Column:
    x = F.col(line) if isinstance(line, str) else line
    return (F.when(x.rlike(r"(?i)closing\s+soon"), F.lit("Closing Soon"))
             .when(x.rlike(r"(?i)\bawarded\b"), F.lit("Awarded"))
             .when(x.rlike(r"(?i)\bclosed\b"), F.lit("Closed"))
             .when(x.rlike(r"(?i)\bopen\b"), F.lit("Open"))
             .otherwise(F.lit("Unknown")))


def tender_type_from_text(line) -> Column:
    x = F.col(line) if isinstance(line, str) else line
    m = F.upper(F.regexp_extract(x, r"(?i)\b(RFQ|RFP|RFI|EOI)\b", 1))
    return (F.when(m != "", m)
             .when(x.rlike(r"(?i)\btender\b"), F.lit("Tender"))
             .otherwise(F.lit("Unknown")))


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-blank line of ``text``: line_no (0-based position in
    the text) and the stripped line."""
    out = df.select("*", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "_line"))
    return (out.withColumn("line", py_strip("_line")).drop("_line", text)
               .where(F.col("line") != ""))


def rule_extract(texts: DataFrame, unit: Sequence[str] = ("page_id",), text: str = "text") -> DataFrame:
    """Rule-based listing extraction over whole texts.

    A line that names an excluded or included section and holds no reference
    number is a section header; every other line is in the section of the
    closest header above it. A record is a line with a reference number that is
    not in an excluded section and — when the text labels any included
    section — is in one. Status and type come from keywords; closed/awarded
    records are dropped.
    """
    ln = lines(texts, text).withColumn("_refs", reference_numbers("line"))
    is_hdr = (F.size("_refs") == 0) & (is_excluded_section("line") | is_included_section("line"))
    # Sections follow from headers alone: only these and lines with a reference
    # are exchanged.
    ln = ln.withColumn("_hdr", F.when(is_hdr, F.col("line"))).where((F.size("_refs") > 0) | F.col("_hdr").isNotNull())
    w = Window.partitionBy(*unit).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    wu = Window.partitionBy(*unit)
    ln = (ln.withColumn("section", F.last("_hdr", ignorenulls=True).over(w))
            .withColumn("_labelled", F.max(F.when(is_hdr & is_included_section("line"), 1)
                                           .otherwise(0)).over(wu)))
    rec = (ln.where(F.size("_refs") > 0)
             .where(~is_excluded_section("section"))
             .where((F.col("_labelled") == 0) | is_included_section("section"))
             .select(*unit, F.col("line_no").cast("long").alias("pos"), "section",
                     F.col("line").alias("title"),
                     F.try_element_at("_refs", F.lit(1)).alias("reference"),
                     status_from_text("line").alias("status"),
                     tender_type_from_text("line").alias("tender_type")))
    return drop_closed(rec)


# ------------------------------------------------------------ batch inference

def infer(prompts: DataFrame, fn: Callable[[list], list], prompt: str = "prompt",
          keep: Sequence[str] = (), attempts: int = 1,
          accept: Callable[[str], bool] | None = None, batch_size: int = 64) -> DataFrame:
    """Run ``fn`` over prompt batches: (keep..., reply, attempts, error).

    ``fn`` maps a list of at most ``batch_size`` prompts to a list of
    replies. A reply counts only if ``accept(reply)`` holds; rows are retried
    up to ``attempts`` times; a row that still fails gets a null reply and the
    last error. Python runs per Arrow batch, in parallel across partitions;
    a failing call only affects the prompts it was given.
    """
    keep = list(keep)
    in_schema = prompts.select(*keep).schema
    out_schema = T.StructType(list(in_schema.fields) + [
        T.StructField("reply", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("error", T.StringType())])
    ok = accept or (lambda r: r is not None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[prompt].tolist()
            n = len(texts)
            replies, errors, tries = [None] * n, [None] * n, [0] * n
            todo = list(range(n))
            for attempt in range(1, attempts + 1):
                if not todo:
                    break
                got = []
                for lo in range(0, len(todo), max(1, batch_size)):
                    part = todo[lo:lo + max(1, batch_size)]
                    try:
                        rep = list(fn([texts[i] for i in part]))
                        if len(rep) != len(part):
                            raise ValueError("reply count differs from prompt count")
                    except Exception as e:  # failed call: mark its rows, retry them
                        rep = [None] * len(part)
                        for i in part:
                            errors[i] = f"{type(e).__name__}: {e}"
                    got.extend(rep)
                left = []
                for i, r in zip(todo, got):
                    tries[i] = attempt
                    try:
                        good = r is not None and ok(r)
                    except Exception:
                        good = False
                    if good:
                        replies[i], errors[i] = r, None
                    else:
                        if errors[i] is None or r is not None:
                            errors[i] = "rejected reply"
                        left.append(i)
                todo = left
            out = pdf[keep].copy()
            out["reply"] = replies
            out["attempts"] = pd.Series(tries, dtype="int32")
            out["error"] = errors
            yield out

    return prompts.select(*keep, prompt).mapInPandas(run, out_schema)


def strict_json(reply: str) -> bool:
    """Python-side acceptance used by listing retries: the greedy span is a
    single JSON value."""
    m = re.search(SPAN, reply)
    return bool(m) and valid_json(m.group(0))


def parse_listing_replies(replies: DataFrame, reply: str = "reply",
                          schema: T.StructType = LISTING_SCHEMA) -> DataFrame:
    """Add ``records`` (array of structs; [] unless the reply is exactly one
    JSON array) and ``ok``."""
    r = replies.withColumn("_span", reply_span(F.coalesce(F.col(reply), F.lit(""))))
    r = r.withColumn("ok", json_strict_valid(F.col("_span")))
    kind = F.when(~F.col("ok"), F.lit("invalid")).when(F.col("_span").startswith("["),
                                                       F.lit("array")).otherwise(F.lit("object"))
    return r.withColumn("records", parse_list_reply(F.col("_span"), kind, schema)).drop("_span")


def parse_object_replies(replies: DataFrame, schema: T.StructType, reply: str = "reply") -> DataFrame:
    r = replies.withColumn("_span", reply_span(F.coalesce(F.col(reply), F.lit(""))))
    r = r.withColumn("ok", json_strict_valid(F.col("_span")))
    kind = F.when(~F.col("ok"), F.lit("invalid")).when(F.col("_span").startswith("{"),
                                                       F.lit("object")).otherwise(F.lit("array"))
    return r.withColumn("record", parse_object_reply(F.col("_span"), kind, schema)).drop("_span")


def extract_listings(chunks: DataFrame, fn: Callable[[list], list], hint: str | Column | None = None,
                     page_id: str = "page_id", page_url: str = "page_url",
                     attempts: int = 2, keep_failed: bool = False) -> DataFrame:
    """Chunks (page_id, page_url, chunk_no, chunk) → one row per first-seen
    record of each page: (page_id, page_url, chunk_no, pos, fingerprint,
    listing fields, attempts, error). ``hint`` is a text for all rows or a column
    of the chunks (a site's own hint). Status and type become their known
    values and closed/awarded records are dropped. With ``keep_failed`` every
    chunk without an accepted reply is a row too, with its ``error`` and nulls
    for the record."""
    h = F.lit(hint) if isinstance(hint, str) else hint
    prompts = chunks.select(page_id, page_url, "chunk_no",
                            listing_prompt(F.col(page_url), F.col("chunk"), h).alias("prompt"))
    replies = infer(prompts, fn, keep=[page_id, page_url, "chunk_no"], attempts=attempts,
                    accept=strict_json)
    parsed = parse_listing_replies(replies)
    if keep_failed:  # read twice below; the model is asked once
        parsed = stage(parsed, "replies")
    whole = [page_id, page_url, "chunk_no", "attempts", "error"]
    rec = parsed.select(*whole, F.posexplode_outer("records").alias("pos", "r"))
    failed = rec.where(F.col("error").isNotNull()).select(*whole)
    rec = rec.where(F.col("r").isNotNull()).select(*whole, "pos", "r.*")
    rec = rec.withColumn("url", resolve_record_url(F.col("url"), F.col(page_url)))
    rec = drop_closed(rec.withColumn("status", normalise_status("status"))
                         .withColumn("tender_type", normalise_tender_type("tender_type")))
    rec = rec.withColumn("fingerprint", fingerprint(F.col("reference"), F.col("title")))
    out = first_seen(rec, [page_id, "fingerprint"], ["chunk_no", "pos"])
    return out.unionByName(failed, allowMissingColumns=True) if keep_failed else out


def extract_objects(docs: DataFrame, fn: Callable[[list], list], key: Sequence[str],
                    url: str = "url", text: str = "text", kind: str = "detail",
                    cap_chars: int | None = None) -> DataFrame:
    """Detail pages (``kind='detail'``) or assembled document texts
    (``kind='file'``, one row per document) → one record per row through the
    model: one call, no retry; a reply that is not exactly one JSON object gives
    an empty record. The text goes into the prompt whole, or its first
    ``cap_chars`` characters. Rows whose text is blank make no call and no
    record. Returns (key..., record fields..., error)."""
    schema = DETAIL_SCHEMA if kind == "detail" else FILE_SCHEMA
    build = detail_prompt if kind == "detail" else file_prompt
    p = docs.where(py_strip(F.col(text)) != "").select(
        *key, build(F.col(url), F.col(text), cap_chars=cap_chars).alias("prompt"))
    parsed = parse_object_replies(infer(p, fn, keep=list(key), attempts=1), schema)
    return parsed.select(*key, *[F.col("record")[f].alias(f) for f in schema.fieldNames()],
                         "error")
