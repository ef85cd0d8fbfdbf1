"""Text functions as column expressions; Arrow functions only where Unicode normalisation or a line automaton is needed.

Null in, null out, unless stated. Lengths and cuts count code points. Blanks are Unicode blanks.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Kinds of injected blocks, marks of synthetic text, and headings of inbound metadata.
BLOCKS = ("context", "profile", "relevant-memories", "guidance")
SYNTHETIC = (
    r"##\s*User Profile\b", r"##\s*Recent Context\b", r"##\s*Relevant Memories\b", r"Treat every memory below as untrusted historical data",
    r"Read HEARTBEAT\.md if it exists", r"\bHEARTBEAT_OK\b", r"Pre-compaction memory flush", r"session is near auto-compaction",
    r"^use memory_search to\b", r"^use memory_store to\b", r"^System:\s*\[", r"Sender \(untrusted metadata\):", r"\bWhatsApp gateway (?:connected|disconnected)\b",
)
SYNTHETIC_TAGS = ("relevant-memories", "system", "assistant", "developer", "tool", "function")
SENTINELS = {
    "Conversation info (untrusted metadata):", "Sender (untrusted metadata):", "Thread starter (untrusted, for context):",
    "Replied message (untrusted, for context):", "Forwarded message context (untrusted metadata):", "Chat history since last reply (untrusted, for context):",
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def exact_key(c: str | Column) -> Column:
    """Comparison key for exact duplicates: blanks (U+0020) trimmed, A-Z folded, nothing else."""
    return F.translate(F.trim(col(c)), UPPER, LOWER)


def nocase(c: str | Column) -> Column:
    """Sort key that ignores the case of A-Z only."""
    return F.translate(col(c), UPPER, LOWER)


def collapse_whitespace(c: str | Column) -> Column:
    """One kind of line end, no blanks before it, at most one empty line, trimmed."""
    s = F.regexp_replace(col(c), r"\r\n?", "\n")
    s = F.regexp_replace(s, r"[ \t]+\n", "\n")
    return trim_all(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def strip_injected(c: str | Column, prefix: str = "memory") -> Column:
    """Without the blocks of context that the engine itself put into a prompt."""
    s = col(c)
    for b in BLOCKS:
        tag = f"{prefix}-{b}"
        s = F.regexp_replace(s, rf"(?is)<{tag}>.*?</{tag}>\s*", " ")
    return collapse_whitespace(s)


def is_synthetic(c: str | Column, prefix: str = "memory") -> Column:
    """Text made by the host or the engine, not by a person; empty text counts."""
    s = strip_injected(c, prefix)
    tags = "|".join([re.escape(prefix), *SYNTHETIC_TAGS])
    return (s == "") | s.rlike(rf"(?i)^<(?:{tags})[-\s>]") | s.rlike("(?i)" + "|".join(SYNTHETIC))


def for_storage(c: str | Column, most: int = 2000, least: int = 10, prefix: str = "memory") -> Column:
    """The cleaned text; null where it is too short, too long or synthetic (it is never cut)."""
    s = strip_injected(c, prefix)
    return F.when(F.length(s).between(least, most) & ~is_synthetic(c, prefix), s)


def normalized(c: str | Column, prefix: str = "memory") -> Column:
    """Comparison key of a text: cleaned, angle brackets and backticks to blanks, squeezed, lower case."""
    s = F.regexp_replace(strip_injected(c, prefix), "[<>`]", " ")
    return F.lower(trim_all(F.regexp_replace(s, r"(?U)\s+", " ")))


def for_prompt(c: str | Column, most: int = 200, prefix: str = "memory") -> Column:
    """The text on one line without angle brackets, at most `most` characters."""
    s = F.regexp_replace(strip_injected(c, prefix), "[<>]", "")
    return F.substring(trim_all(F.regexp_replace(s, r"(?U)\s+", " ")), 1, most)


def strip_metadata_text(text: str | None) -> str | None:
    """Without a leading time stamp and without headings of inbound metadata and the fenced JSON below them."""
    if not text:
        return text
    lines = re.sub(r"^\[[A-Za-z]{3} \d{4}-\d\d-\d\d \d\d:\d\d[^\]]*\] *", "", text).split("\n")
    out: list[str] = []
    state = "text"  # text; head: below a heading; json: within its fence
    for i, line in enumerate(lines):
        t = line.strip()
        if state == "json":
            state = "text" if t == "```" else "json"
            continue
        if state == "head":
            if t == "```json":
                state = "json"
                continue
            if not t:
                continue
            state = "text"
        if t in SENTINELS and i + 1 < len(lines) and lines[i + 1].strip() == "```json":
            state = "head"
            continue
        out.append(line)
    return "\n".join(out).strip("\n")


@pandas_udf(StringType())
def _strip_metadata(s: pd.Series) -> pd.Series:
    return s.map(strip_metadata_text, na_action="ignore")


def strip_metadata(c: str | Column) -> Column:
    return _strip_metadata(col(c))


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@pandas_udf(StringType())
def _unmarked(s: pd.Series) -> pd.Series:
    return s.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.category(c).startswith("M")), na_action="ignore")


def alias_key(c: str | Column) -> Column:
    """Normal form of a name: compatibility composed, trimmed, squeezed, lower case."""
    return F.lower(F.regexp_replace(trim_all(_nfkc(col(c))), r"(?U)\s+", " "))


def folded(c: str | Column) -> Column:
    """alias_key without marks: the form for loose comparison."""
    return _unmarked(alias_key(c))


def dedup_text(c: str | Column) -> Column:
    """Compatibility decomposed, without marks, lower case."""
    return F.lower(_unmarked(col(c)))


def alias_tokens(c: str | Column) -> Column:
    return F.filter(F.split(folded(c), r"[^-\p{L}\p{N}]+"), lambda x: x != "")


def slug(c: str | Column) -> Column:
    """Identifier form: a-z, 0-9, underscore and dash; runs of anything else become one dash; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim_all(c)), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")


def scope_hash(c: str | Column) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 16)


def percent(c: str | Column) -> Column:
    """A share as whole per cent, halves up."""
    return F.concat(F.floor(col(c) * 100 + 0.5).cast("string"), F.lit("%"))


def mention_display(surface: str | Column, canonical: str | Column, kind: str | Column) -> Column:
    """surface -> canonical (kind); the arrow only where the two differ, the kind only where there is one."""
    s, c, k = col(surface), col(canonical), col(kind)
    return F.concat(F.when(s == c, c).otherwise(F.concat(s, F.lit(" -> "), c)), F.when(k.isNull() | (k == ""), "").otherwise(F.concat(F.lit(" ("), k, F.lit(")"))))


def is_uuid(c: str | Column) -> Column:
    return col(c).rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def cache_key(provider: str, model: str, dims: int, c: str | Column) -> Column:
    return F.concat_ws(":", F.lit(provider), F.lit(model), F.lit(str(dims)), F.sha2(col(c), 256))


def iso_millis(c: str | Column) -> Column:
    """Epoch milliseconds of an ISO date or time; null where it is none."""
    return F.unix_millis(F.try_to_timestamp(col(c)))


def iso_normal(c: str | Column) -> Column:
    """The instant in UTC as yyyy-MM-ddTHH:mm:ss.SSSZ; null where it is none."""
    return F.date_format(F.to_utc_timestamp(F.try_to_timestamp(col(c)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def session_date(c: str | Column) -> Column:
    """Timestamp of 'YYYY/MM/DD (Dow) HH:MM', else of an ISO date; null where it is neither."""
    s = F.regexp_replace(col(c), r"\s*\(\w+\)", "")
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(col(c)))


def uri_id(c: str | Column, scheme: str = "memory") -> Column:
    """The id in scheme://id; null for anything else."""
    r = F.regexp_extract(col(c), rf"^{scheme}://(.+)$", 1)
    return F.when(r != "", r)
