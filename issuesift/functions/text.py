"""Scalar text functions (F1-F3, F6, F7, F10, F12) as JVM-side column expressions.

Python's ``str.split()``/``strip()`` treat a wider set of characters as
whitespace than Java's ``\\s``; ``PY_WS`` lists that set so results match the
reference character for character. ``length``/``substring`` count code
points in Spark, as ``len`` and slicing do in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters Python's str.split()/str.strip() treat as whitespace
# (code points 9-13, 28-32, 133, 160, 5760, 8192-8202, 8232, 8233, 8239, 8287, 12288).
PY_WS_CODES = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
PY_WS_CHARS = "".join(chr(c) for c in PY_WS_CODES)


def _regex_class(codes: list[int]) -> str:
    """A Java regex character class for ``codes``, consecutive codes as ranges."""
    codes = sorted(set(codes))
    parts, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        lo, hi = codes[i], codes[j]
        parts.append(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}")
        i = j + 1
    return "[" + "".join(parts) + "]"


# the same set as a Java regex character class
PY_WS = _regex_class(PY_WS_CODES)
# sanitising turns control characters (other than NUL) into spaces and then
# collapses whitespace runs; one class of both does it in a single pass
_WS_OR_CONTROL = _regex_class(PY_WS_CODES + list(range(1, 32)))

# Reaction names and their emoji, in the order the API lists them.
EMOJI = [
    ("THUMBS_UP", "👍"),
    ("THUMBS_DOWN", "👎"),
    ("LAUGH", "😄"),
    ("HOORAY", "🎉"),
    ("CONFUSED", "😕"),
    ("HEART", "❤️"),
    ("ROCKET", "🚀"),
    ("EYES", "👀"),
]

# Truncation limits and markers.
SANITIZE_LIMIT = 50_000
TRUNC_SUFFIX = "... [truncated]"
EMBED_BODY_LIMIT = 15_000
EMBED_COMMENTS_LIMIT = 8_000
EMBED_CUT_MARKER = "[... more comments truncated]"
CONV_BODY_LIMIT = 20_000
CONV_COMMENT_LIMIT = 5_000
CONV_COMMENTS_LIMIT = 25_000
CONV_CUT_MARKER = "[... more comments truncated for conversation]"
FALLBACK_MIN_LEN = 20_000
FALLBACK_TITLE_MAX = 1_000
SHORT_TITLE_MAX = 50
SHORT_TITLE_KEEP = 47


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """``str.strip()``: trims the Python whitespace set (linear, no regex)."""
    return F.trim(_c(c), F.lit(PY_WS_CHARS))


def is_blank(c: str | Column) -> Column:
    """True for null or whitespace-only text (``not s or not s.strip()``)."""
    x = _c(c)
    return x.isNull() | (F.length(py_strip(x)) == 0)


def truncate(c: str | Column, n: int, suffix: str = TRUNC_SUFFIX) -> Column:
    """first ``n`` characters plus a suffix when longer than ``n``."""
    x = _c(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(suffix))).otherwise(x)


def sanitize(c: str | Column, limit: int = SANITIZE_LIMIT) -> Column:
    """drop NUL/BOM, other control characters (not tab/LF/CR) to spaces,
    collapse whitespace runs to one space and trim, cut at ``limit`` + ``...``."""
    x = F.replace(F.replace(_c(c), F.lit("\x00"), F.lit("")), F.lit("\ufeff"), F.lit(""))  # drop NUL, BOM
    # controls become spaces and whitespace runs one space: both in one regex pass
    x = F.regexp_replace(x, f"{_WS_OR_CONTROL}+", " ")
    x = F.trim(x)                                              # only single spaces remain at the ends
    return truncate(x, limit, "...")


def emoji_map() -> Column:
    return F.create_map(*[F.lit(v) for kv in EMOJI for v in kv])


def emoji_order(content: Column) -> Column:
    """Position of a reaction name in the API order; unknown names sort after."""
    arr = F.array(*[F.lit(k) for k, _ in EMOJI])
    pos = F.array_position(arr, F.coalesce(content, F.lit("")))
    return F.when(pos > 0, pos).otherwise(F.lit(len(EMOJI) + 1))


def emoji_text(groups: str | Column) -> Column:
    """`` [👍 3, 👀 1]`` for groups with a positive count; unknown names kept."""
    g = _c(groups)
    kept = F.filter(g, lambda x: F.coalesce(x["count"], F.lit(0)) > 0)
    m = emoji_map()
    parts = F.transform(kept, lambda x: F.concat(
        F.coalesce(F.try_element_at(m, F.coalesce(x["content"], F.lit(""))), F.coalesce(x["content"], F.lit(""))),
        F.lit(" "), x["count"].cast("string")))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0,
                  F.concat(F.lit(" ["), F.array_join(parts, ", "), F.lit("]"))).otherwise(F.lit(""))


def counted_groups(df: DataFrame, c: str) -> Column:
    """Reaction groups as ``content, count``, from that form or from the API's
    ``content, users.totalCount`` that normalised items carry."""
    kind = df.schema[c].dataType
    names = getattr(getattr(kind, "elementType", None), "names", [])
    if "users" not in names:
        return F.col(c)
    return F.transform(c, lambda g: F.struct(
        g["content"].alias("content"), F.coalesce(g["users"]["totalCount"], F.lit(0).cast("bigint")).alias("count")))


def cache_key(content: str | Column, model: str) -> Column:
    """``model:sha256(content)`` of the unsanitised content."""
    return F.concat(F.lit(model + ":"), F.sha2(_c(content), 256))


def title_fallback(content: str | Column) -> Column:
    """for content whose sanitised form exceeds 20,000 characters, the
    sanitised first line when it is non-empty and shorter than 1,000."""
    x = _c(content)
    first = sanitize(F.split_part(x, F.lit("\n"), F.lit(1)))
    ok = (F.length(first) > 0) & (F.length(first) < FALLBACK_TITLE_MAX)
    return F.when((F.length(sanitize(x)) > FALLBACK_MIN_LEN) & ok, first)


def short_title(c: str | Column) -> Column:
    """titles over 50 characters become 47 characters + ``...``."""
    x = _c(c)
    return F.when(F.length(x) > SHORT_TITLE_MAX,
                  F.concat(F.substring(x, 1, SHORT_TITLE_KEEP), F.lit("..."))).otherwise(x)


def issue_refs(c: str | Column) -> Column:
    """``#123`` references not preceded by a word character or ``/``."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit("(?<![\\w/])#(\\d+)"), F.lit(1)),
                       lambda s: s.cast("bigint"))
