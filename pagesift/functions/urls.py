"""URL column functions: RFC-3986 join, file names, mime types and page-URL
generation for the url-parameter pagination strategy.

URL join has native branches (absolute, protocol-relative and root-relative
hrefs without dot segments); only the remaining rows go through an
Arrow-batched pandas UDF over ``urllib.parse.urljoin`` (others are passed to
it as null and return immediately).
"""

from __future__ import annotations

import mimetypes
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def origin(url) -> Column:
    """scheme://host[:port] of an absolute URL ('' when not absolute)."""
    return F.regexp_extract(_c(url), _ORIGIN, 1)


_DOTS = r"(^|/)\.\.?(/|$|[?#])"


def _native_join(base: Column, href: Column) -> Column:
    """RFC-3986 join for every case that needs no dot-segment removal:
    absolute, protocol-relative, root-relative, query-only, fragment-only
    and plain relative paths against an http(s)-style base. Null otherwise
    (other schemes, '.'/'..' segments), which the UDF then resolves."""
    o = origin(base)
    no_dots = ~href.rlike(_DOTS)
    is_abs = href.rlike(r"^https?://")  # urljoin lower-cases other spellings
    has_scheme = href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    proto_rel = href.startswith("//") & (o != "")
    root_rel = href.rlike(r"^/([^/]|$)") & (o != "") & no_dots
    base_nofrag = F.substring_index(base, "#", 1)
    base_noq = F.substring_index(base_nofrag, "?", 1)
    path = F.substring(base_noq, F.length(o) + 1, 1 << 30)
    directory = F.when(F.instr(path, "/") > 0,
                       F.concat(o, F.regexp_extract(path, r"^(.*/)", 1))) \
        .otherwise(F.concat(o, F.lit("/")))
    rel = ((o != "") & ~has_scheme & ~href.startswith("/") & ~href.startswith("?")
           & ~href.startswith("#") & no_dots & ~path.rlike(_DOTS))
    return (F.when(href == "", base)
            .when(is_abs & no_dots, href)
            .when(proto_rel & no_dots,
                  F.concat(F.regexp_extract(base, _SCHEME, 1), F.lit(":"), href))
            .when(root_rel, F.concat(o, href))
            .when(href.startswith("?") & (o != ""), F.concat(base_noq, href))
            .when(href.startswith("#") & (o != ""), F.concat(base_nofrag, href))
            .when(rel, F.concat(directory, href)))


def _join_py(base, href):
    if base is None or href is None:
        return None
    try:
        return urljoin(base, href)
    except Exception:
        return None


@F.pandas_udf(T.StringType())
def urljoin_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([_join_py(b, h) for b, h in zip(base, href)], dtype=object)


# Not to be pushed below a filter's projection and so evaluated twice.
urljoin_udf = urljoin_udf.asNondeterministic()


def resolve_url(base, href) -> Column:
    """``urljoin(base, href)``: native where possible, UDF for the rest."""
    b, h = _c(base), _c(href)
    nat = _native_join(b, h)
    slow = urljoin_udf(F.when(nat.isNull(), b), F.when(nat.isNull(), h))
    return F.when(h.isNull() | b.isNull(), F.lit(None).cast("string")) \
        .otherwise(F.coalesce(nat, slow))


def resolve_record_url(url, page_url) -> Column:
    """Record URL fix-up: non-empty and not starting 'http' → join with the
    page URL; anything else unchanged."""
    u = _c(url)
    return F.when(u.isNull() | (u == "") | u.startswith("http"), u) \
        .otherwise(resolve_url(page_url, u))


def file_name(url) -> Column:
    """Last '/' segment before any '?'; '' → 'document'; no '.' → + '.pdf'."""
    seg = F.substring_index(F.substring_index(_c(url), "/", -1), "?", 1)
    name = F.when(seg == "", F.lit("document")).otherwise(seg)
    return F.when(F.instr(name, ".") > 0, name).otherwise(F.concat(name, F.lit(".pdf")))


# Types of documents that the standard library's own table lacks
# before Python 3.14.
OFFICE_TYPES = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".odt": "application/vnd.oasis.opendocument.text",
    ".7z": "application/x-7z-compressed",
    ".rar": "application/vnd.rar",
}
# That table (about 150 extensions), without the files a machine may add to it.
_STANDARD = mimetypes.MimeTypes(filenames=())
MIME_TYPES = OFFICE_TYPES | _STANDARD.types_map[True]
DEFAULT_MIME = "application/octet-stream"


def _literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(entries.items()) for x in kv])


def file_ext(name) -> Column:
    """The last '.' of a name and what follows; '' if only dots come before it."""
    return F.regexp_extract(_c(name), r"[^./][^/]*(\.[^./]*)\z", 1)


def mime_type(name) -> Column:
    """Type by extension, whatever its case: .tgz and the like count as .tar.gz, the
    ending of a compression (.gz, .bz2, .xz, .br, .Z; in that case only) is looked
    through; application/octet-stream if the extension is unknown or missing, and for null."""
    def without(n: Column, ext: Column) -> Column:
        return F.left(n, F.length(n) - F.length(ext))

    n = _c(name)
    ext = file_ext(n)
    n = F.concat(without(n, ext), F.coalesce(F.try_element_at(_literal_map(_STANDARD.suffix_map), F.lower(ext)), ext))
    ext = file_ext(n)
    n = F.when(ext.isin(*sorted(_STANDARD.encodings_map)), without(n, ext)).otherwise(n)
    found = F.try_element_at(_literal_map(MIME_TYPES), F.lower(file_ext(n)))
    return F.coalesce(found, F.lit(DEFAULT_MIME))


def with_page_param(base, param, value) -> Column:
    """URL for one page of the url-parameter strategy.

    If ``param=`` occurs in the URL every ``param=<digits>`` is replaced
    (unanchored, so ``mypage=7`` changes too; the param is matched
    literally); otherwise ``param=value`` is appended with '?' or '&',
    before any '#fragment'.
    """
    b, p = _c(base), _c(param)
    v = _c(value).cast("string")
    pattern = F.concat(F.lit(r"\Q"), p, F.lit(r"\E=\d+"))
    # '$' and '\' are special in Java replacement strings
    repl = F.regexp_replace(F.concat(p, F.lit("="), v), r"([\\$])", r"\\$1")
    replaced = F.regexp_replace(b, pattern, repl)
    pre = F.substring_index(b, "#", 1)
    frag = F.when(F.instr(b, "#") > 0,
                  F.concat(F.lit("#"), F.substring(b, F.instr(b, "#") + 1, 1 << 30))) \
        .otherwise(F.lit(""))
    sep = F.when(F.instr(pre, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    appended = F.concat(pre, sep, p, F.lit("="), v, frag)
    has = F.instr(b, F.concat(p, F.lit("="))) > 0
    return F.when(has, replaced).otherwise(appended)


def document_kind(path) -> Column:
    """Document dispatch by extension of the lowered path: 'pdf' for .pdf,
    'docx' for .docx or .doc, null for anything else (no record)."""
    p = F.lower(_c(path))
    return (F.when(p.endswith(".pdf"), F.lit("pdf"))
             .when(p.endswith(".docx") | p.endswith(".doc"), F.lit("docx")))
