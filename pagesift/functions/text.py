"""Text column functions: Python-equal strip, empty-as-null, fingerprints,
chunking, contact strings, prompt rendering and date formats.

All are built-in Spark expressions (JVM side, whole-stage codegen); no UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters Python's str.strip() removes (str.isspace()), as a regex class
# valid in both Java regex and RE2, and as a plain character set for trim.
PY_WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
PY_WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Default chunking parameters; text caps and key sizes that a
# caller may ask for (none of the cuts is made by default).
CHUNK_SIZE = 12000
CHUNK_OVERLAP = 1000
DETAIL_TEXT_CAP = 15000
TITLE_KEY_CHARS = 60
KEY_DIGITS = 16


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes tabs, newlines, NBSP and other Unicode
    spaces at both ends (plain ``trim`` only removes ASCII spaces). A trim
    with an explicit character set only looks at the two ends of the text."""
    return F.trim(_c(c), F.lit(PY_WS_CHARS))


def ne(c) -> Column:
    """Empty string → null, so '' and null behave alike (truthiness)."""
    return F.nullif(_c(c), F.lit(""))


def fingerprint(reference, title, title_chars: int | None = None, digits: int = 64) -> Column:
    """Record key: sha256 of 'ref title' after strip+lower, empty parts
    dropped. Site is not part of the key. ``title_chars`` and ``digits`` cut the
    title and the key short (records that differ behind the cut share a key)."""
    ref = ne(F.lower(py_strip(_c(reference))))
    ttl = F.lower(py_strip(_c(title)))
    ttl = ne(ttl if title_chars is None else F.substring(ttl, 1, title_chars))
    return F.substring(F.sha2(F.concat_ws(" ", ref, ttl), 256), 1, digits)


# Fixed value: the key every record without reference and title shares
# (sha256 of the empty string).
KEYLESS_FINGERPRINT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def is_keyless(reference, title) -> Column:
    """True when a record has neither reference nor title after strip; all
    such records share ``KEYLESS_FINGERPRINT``, so only one is ever stored."""
    return (ne(py_strip(_c(reference))).isNull() & ne(py_strip(_c(title))).isNull())


def key_fallback(existing_fp, reference, title) -> Column:
    """Keep a fingerprint a record already carries, else compute it."""
    return F.coalesce(ne(_c(existing_fp)), fingerprint(reference, title))


def contact_string(name, email, phone) -> Column:
    """Non-empty contact parts joined by ' | ' (null when none)."""
    return ne(F.concat_ws(" | ", ne(_c(name)), ne(_c(email)), ne(_c(phone))))


def chunk_starts(length: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of 0-based chunk start offsets: [0] when length <= size (also
    for empty text), else 0, size-overlap, ... while start < length."""
    if overlap >= size or size <= 0 or overlap < 0:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    return F.when(length <= F.lit(size), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), length - 1, F.lit(step)))


def chunk(df: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE,
          overlap: int = CHUNK_OVERLAP, keep_text: bool = False) -> DataFrame:
    """One row per chunk: adds chunk_no (0-based), chunk_start and chunk.

    Each chunk is at most ``size`` characters (code points); consecutive
    chunks overlap by ``overlap`` characters. The offsets array is built from
    the length only, so no text is copied until ``substring`` cuts the chunk.
    """
    t = F.col(text_col)
    out = (df.select("*", F.posexplode(chunk_starts(F.length(t), size, overlap))
                     .alias("chunk_no", "chunk_start"))
             .withColumn("chunk", F.substring(t, F.col("chunk_start") + 1, size)))
    return out if keep_text else out.drop(text_col)


def cap(c, n: int | None) -> Column:
    """First n characters (all if n is None)."""
    return _c(c) if n is None else F.substring(_c(c), 1, n)


# Fixed value: the hint section format placed into a prompt when a site has a hint.
HINT_SECTION = ("\nSITE-SPECIFIC HINT: ", "\n")

LISTING_TEMPLATE = (
    "Extract every procurement notice from the page text below as a JSON array of "
    "objects with the keys title, reference, issuer, category, deadline, briefing_date, "
    "budget, status, description, url, location, contact, tender_type (null if unknown).\n"
    "Site: {site}\n{hint}\nPage text:\n{text}\n")
DETAIL_TEMPLATE = (
    "Extract the details of this notice page as one JSON object with the keys "
    "full_description, requirements, submission_method, contact_name, contact_email, "
    "contact_phone, briefing_date, additional_info, tender_type (null if not found).\n"
    "Source URL: {url}\nPage text:\n{text}\n")
FILE_TEMPLATE = (
    "Extract the key facts of this notice document as one JSON object with the keys "
    "full_description, requirements, submission_method, contact_name, contact_email, "
    "contact_phone, deadline, budget, additional_info (null if not found).\n"
    "Source URL: {url}\nDocument text:\n{text}\n")


def hint_section(hint) -> Column:
    """'' when there is no hint, else the fixed hint section."""
    h = ne(_c(hint))
    return F.when(h.isNull(), F.lit("")).otherwise(
        F.concat(F.lit(HINT_SECTION[0]), h, F.lit(HINT_SECTION[1])))


def render(template: str, **slots) -> Column:
    """Fill ``{slot}`` placeholders of a template with columns via ``concat``.

    The template is split once on the driver; the per-row work is a single
    JVM-side concat. Null slot values render as ''.
    """
    import string
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(F.coalesce(_c(slots[field]).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def listing_prompt(site, text, hint=None, template: str = LISTING_TEMPLATE) -> Column:
    return render(template, site=site, text=text,
                  hint=hint_section(hint) if hint is not None else F.lit(""))


def detail_prompt(url, text, template: str = DETAIL_TEMPLATE, cap_chars: int | None = None) -> Column:
    return render(template, url=url, text=cap(text, cap_chars))


def file_prompt(url, text, template: str = FILE_TEMPLATE, cap_chars: int | None = None) -> Column:
    return render(template, url=url, text=cap(text, cap_chars))


def subject_date(ts) -> Column:
    """ISO date used in report subjects (session time zone must be UTC)."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def body_date(ts) -> Column:
    """'02 December 2026' style date used in report bodies."""
    return F.date_format(_c(ts), "dd MMMM yyyy")


def html_escape(c) -> Column:
    """Escape & < > for HTML report cells."""
    x = F.replace(_c(c), F.lit("&"), F.lit("&amp;"))
    x = F.replace(x, F.lit("<"), F.lit("&lt;"))
    return F.replace(x, F.lit(">"), F.lit("&gt;"))
