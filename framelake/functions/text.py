"""Text expressions: tokens, query terms, LIKE escaping, names and display formats."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with one mark, and the letters they are made of, by their Unicode decomposition.
_MADE = {chr(c): d for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) == 2 and d[0].isascii() and d[0].islower()}
MARKED, PLAIN = "".join(_MADE), "".join(d[0] for d in _MADE.values())
#: Marks that stand by themselves.
COMBINING = r"[\x{300}-\x{36F}]"
TOKEN = r"[\p{L}\p{N}]+"
#: Characters and words that have a meaning in a full-text query.
QUERY_MARKS = r'["()*+:<>{}^~\-]'
QUERY_WORDS = r"(?i)^(NEAR|AND|OR|NOT)$"


def folded_tokens(text: Column) -> Column:
    """Index tokens: lower case, marks folded or dropped, runs of letters and digits."""
    return F.regexp_extract_all(F.translate(F.regexp_replace(F.lower(text), COMBINING, ""), MARKED, PLAIN), F.lit(TOKEN), F.lit(0))


CJK = r"[\x{4E00}-\x{9FFF}]"


def index_tokens(text: Column) -> Column:
    """What texts are indexed by and queries are asked by: folded tokens, runs of CJK as their bigrams."""
    return folded_tokens(F.when(text.rlike(CJK), segmented(text)).otherwise(text))


def segmented(text: Column) -> Column:
    """ASCII text: white space collapsed. Other text: runs of CJK become overlapping bigrams, as no dictionary is at hand."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cjk = F.regexp_replace(flat, r"([\x{4E00}-\x{9FFF}])(?=([\x{4E00}-\x{9FFF}]))", "$1$2 ")
    return F.when(flat.rlike(r"^[\x00-\x7F]*$"), flat).otherwise(F.trim(F.regexp_replace(F.regexp_replace(cjk, r"(?<=[\x{4E00}-\x{9FFF}] )[\x{4E00}-\x{9FFF}](?![\x{4E00}-\x{9FFF}])", ""), r"\s+", " ")))


def query_terms(raw: Column) -> Column:
    """Terms of a user's query: marks deleted, operator words and empty terms dropped."""
    parts = F.split(segmented(F.coalesce(raw, F.lit(""))), r"\s+")
    cleaned = F.transform(parts, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, QUERY_MARKS, ""), QUERY_WORDS, "")))
    return F.filter(cleaned, lambda t: F.length(t) > 0)


def fts_query(raw: Column) -> Column:
    """Quoted terms joined by OR; empty when no term is left (then no search is made)."""
    return F.array_join(F.transform(query_terms(raw), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def like_pattern(query: str) -> str:
    """%query% with LIKE's own characters escaped by !."""
    return "%" + re.sub(r"([!%_])", r"!\1", query) + "%"


def contains_like(columns: list[Column], query: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.ilike(c, F.lit(like_pattern(query)), F.lit("!")), F.lit(False))
    return out


def normalise_query(q: Column) -> Column:
    return F.trim(F.regexp_replace(q, r"\s+", " "))


#: Fixed value: what the text encoder expects before a query.
QUERY_PREFIX = "task: search query | text: "


def prefixed(text: Column, prefix: str = QUERY_PREFIX) -> Column:
    s = F.trim(text)
    return F.when(s.startswith("task:"), s).otherwise(F.concat(F.lit(prefix), s))


def base_name(path: Column) -> Column:
    """Last path component; the path itself when that is empty."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(F.length(last) > 0, last).otherwise(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))


def duration_text(ms: Column) -> Column:
    """m:ss, from one hour on h:mm:ss; 0:00 for nothing or less."""
    total = F.floor(ms / 1000)
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), F.lpad((total % 60).cast("string"), 2, "0")
    long = F.concat_ws(":", h.cast("string"), F.lpad(m.cast("string"), 2, "0"), s)
    return F.when(ms.isNull() | (ms <= 0), "0:00").when(h > 0, long).otherwise(F.concat_ws(":", m.cast("string"), s))


def size_text(size: Column) -> Column:
    """B, KB, MB or GB with at most one decimal."""
    i = F.when(size < 1024, 0).when(size < 1024**2, 1).when(size < 1024**3, 2).otherwise(3)
    number = F.call_function("format_number", F.floor(size / F.pow(F.lit(1024.0), i) * 10 + 0.5) / 10, F.lit("0.#"))
    return F.when(size.isNull() | (size == 0), "0 B").otherwise(F.concat_ws(" ", number, F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), i + 1)))


def span_text(ms: Column) -> Column:
    """Seconds, minutes or hours; the unit's letter stands for its localised name."""
    whole = lambda x: F.floor(x + 0.5).cast("string")
    return (
        F.when(ms < 60_000, F.concat(F.greatest(F.lit(1), F.floor(ms / 1000 + 0.5)).cast("string"), F.lit(" s")))
        .when(ms < 3_600_000, F.concat(whole(ms / 60_000), F.lit(" min")))
        .otherwise(F.concat(F.call_function("format_number", ms / 3_600_000, F.lit("0.0")), F.lit(" h")))
    )


def parsed_duration(text: Column) -> Column:
    """Milliseconds from 'Duration: HH:MM:SS.xx' in a probe's output; null without one, and for zero."""
    pattern = r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    seconds = part(1).try_cast("long") * 3600 + part(2).try_cast("long") * 60 + part(3).try_cast("double")
    return F.when(text.rlike(pattern), F.nullif(F.round(seconds * 1000).cast("long"), F.lit(0).cast("long")))


def parsed_size(text: Column) -> Column:
    """width and height of the first video stream; a rotation by 90 or 270 degrees swaps them."""
    size = r"Video:.*?(\d{2,5})x(\d{2,5})"
    w, h = F.regexp_extract(text, size, 1).try_cast("long"), F.regexp_extract(text, size, 2).try_cast("long")
    turned = text.rlike(r"rotat\w*\s*(?:of|:)\s*-?(90|270)")
    return F.when(w.isNotNull(), F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height")))


def backup_name(ts: Column) -> Column:
    """library.db.bak.<UTC time without separators>; the session's time zone must be UTC."""
    return F.concat(F.lit("library.db.bak."), F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"))
