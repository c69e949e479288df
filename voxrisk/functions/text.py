"""Text measures and cleaning as Column expressions.

``\\w`` and ``\\s`` mean different things to different regex engines, so the two
classes are spelled out: letters, digits and underscore of any script, and every
Unicode blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: patterns ----------------------------------------------------

WORD = r"\p{L}\p{N}_"
BLANK = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}"
)
HTML_TAG = "<[^>]+>"
URL = f"https?://[^{BLANK}]+"
MENTION = f"@[{WORD}]+"
AT_ANY = f"@[^{BLANK}]+"
BRACKET_EMOJI = rf"\[[{WORD}]+\]"
UNICODE_EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}]"
WIDE_EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}"
    r"\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}"
    r"\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}]"
)
REPEATED_PUNCT = "[!！?？]{3,}"
REPEATED_BRACKET_EMOJI = rf"\[[{WORD}]+\]{{3,}}"
REPEATED_UNICODE_EMOJI = r"[\x{1F600}-\x{1F64F}]{3,}"
TOKEN_BREAK = f"[{BLANK}" + r"\.,!?;:'\"()（），。！？；：、]+"
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CJK_PAIR = r"(?=([\x{4e00}-\x{9fff}]{2}))"
LATIN_RUN = r"[a-zA-Z\x{c0}-\x{24f}0-9]+"
IP_PREFIX = "IP属地："

PUNCTUATION = ".,!?;:'\"()（），。！？；：、"


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _spaced(text: Column, characters: str) -> Column:
    """Each of the characters as a plain space. A pattern that then looks for spaces only
    is several times faster than one that tests every character against the whole list."""
    return F.translate(text, characters, " " * len(characters))


def strip(text: Column) -> Column:
    """Drop leading and trailing blanks of any kind."""
    return F.btrim(text, F.lit(BLANK_CHARS))


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, "")


def html_chars_removed(text: Column) -> Column:
    """Characters (not tags) that ``strip_html`` drops."""
    return F.length(text) - F.length(strip_html(text))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_urls(text: Column) -> Column:
    return count_matches(text, URL)


def count_mentions(text: Column) -> Column:
    return count_matches(text, MENTION)


def has_at(text: Column) -> Column:
    return text.rlike(AT_ANY)


def count_at(text: Column) -> Column:
    return count_matches(text, AT_ANY)


def count_bracket_emoji(text: Column) -> Column:
    return count_matches(text, BRACKET_EMOJI)


def count_unicode_emoji(text: Column) -> Column:
    return count_matches(text, UNICODE_EMOJI)


def normalize_whitespace(text: Column) -> Column:
    """Runs of blanks become one space; after that a plain trim is enough."""
    return F.trim(F.regexp_replace(_spaced(text, BLANK_CHARS), "  +", " "))


def clean_content(text: Column) -> Column:
    """Markup removed, blanks collapsed; null becomes the empty string."""
    return normalize_whitespace(strip_html(blank_if_null(text)))


def content_metadata(text: Column) -> Column:
    """Counts taken after markup is removed and before blanks are collapsed."""
    bare = strip_html(blank_if_null(text))
    emoji, urls, mentions = count_bracket_emoji(bare), count_urls(bare), count_mentions(bare)
    return F.struct(
        F.length(normalize_whitespace(bare)).alias("length"),
        (emoji > 0).alias("has_emoji"),
        (urls > 0).alias("has_url"),
        (mentions > 0).alias("has_mention"),
        emoji.alias("emoji_count"),
        urls.alias("url_count"),
        mentions.alias("mention_count"),
    )


def repeated_punct(text: Column) -> Column:
    return text.rlike(REPEATED_PUNCT)


def repeated_emoji(text: Column, profile: str = "v2") -> Column:
    return text.rlike(REPEATED_BRACKET_EMOJI if profile == "v2" else REPEATED_UNICODE_EMOJI)


def all_upper(text: Column, min_length: int = 10) -> Column:
    """At least one upper-case letter, none in lower or title case, long enough."""
    return (
        text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]") & (F.length(text) > min_length)
    )


def strip_ip_prefix(ip: Column, missing: str | None = None) -> Column:
    """``IP属地：安徽`` -> ``安徽``; empty becomes null, or ``missing`` when given."""
    bare = F.replace(F.nullif(ip, F.lit("")), F.lit(IP_PREFIX), F.lit(""))
    return bare if missing is None else F.coalesce(bare, F.lit(missing))


def short_hash_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(text), 1, 12))


def text_key(text: Column) -> Column:
    """Compact stand-in for a text in distinct counts.

    Short texts stand for themselves, longer ones for their SHA-256, so a shuffle
    carries at most 71 characters per row and different texts keep different keys.
    """
    return F.when(F.length(text) <= 64, text).otherwise(F.concat(F.lit("sha256:"), F.sha2(text, 256)))


def tokens(text: Column) -> Column:
    """Words between blanks and punctuation, two or more characters long."""
    return F.regexp_extract_all(_spaced(text, BLANK_CHARS + PUNCTUATION), F.lit("[^ ]{2,}"), F.lit(0))


def cjk_tokens(text: Column) -> Column:
    """Overlapping character pairs of every CJK run, then the Latin words."""
    return F.concat(
        F.regexp_extract_all(text, F.lit(CJK_PAIR), F.lit(1)),
        F.filter(F.regexp_extract_all(text, F.lit(LATIN_RUN), F.lit(0)), lambda w: F.length(w) > 1),
    )


def first_keywords(text: Column, stopwords, limit: int = 10) -> Column:
    """The first ``limit`` tokens of a text that are no stopwords."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    kept = F.filter(tokens(text), lambda w: ~F.array_contains(stop, w))
    return F.slice(kept, 1, limit)


def parse_human_count(text: Column) -> Column:
    """``1.2w`` -> 12000, ``3m`` -> 3000000; 0 when there is no number."""
    low = F.lower(text)
    number = F.regexp_extract(low, r"(\d+\.?\d*)([wm]?)", 1)
    unit = F.regexp_extract(low, r"(\d+\.?\d*)([wm]?)", 2)
    scale = F.when(unit == "w", F.lit(10000)).when(unit == "m", F.lit(1000000)).otherwise(F.lit(1))
    value = F.nullif(number, F.lit("")).cast("double")
    return F.coalesce((value * scale).cast("bigint"), F.lit(0).cast("bigint"))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, null when absent."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def bv_id(url: Column) -> Column:
    return found(url, "BV[a-zA-Z0-9]+")


def post_id(url: Column) -> Column:
    return found(url, r"/p/(\d+)", 1)


def video_id(url: Column) -> Column:
    return found(url, r"(?:video/|modal_id=)(\d+)", 1)


def share_link(text: Column) -> Column:
    return F.regexp_replace(found(text, r"https?://v\.douyin\.com/[\p{L}\p{N}_-]+/?"), "/+$", "")


def canonical_video_url(url: Column) -> Column:
    """Short share link if the text holds one, else the canonical address of the
    video id, else the input."""
    by_id = F.concat(F.lit("https://www.douyin.com/video/"), video_id(url))
    return F.coalesce(share_link(url), by_id, url)


def time_prefix(text: Column) -> Column:
    return found(text, r"^(0?\d|1\d|2[0-3]):[0-5]\d")


def date_prefix(text: Column) -> Column:
    return found(text, r"^\d{4}-\d{2}-\d{2}")


def shift_date(text: Column, days: int) -> Column:
    """Leading date of the text moved by ``days``, as text."""
    day = F.try_to_timestamp(date_prefix(text), F.lit("yyyy-MM-dd")).cast("date")
    return F.date_format(F.date_add(day, days), "yyyy-MM-dd")


def html_text(html: Column) -> Column:
    """Visible text: script and style bodies and comments go, then the tags."""
    body = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    return normalize_whitespace(F.regexp_replace(body, HTML_TAG, " "))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def html_images(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<img\s[^>]*src="([^"]*)"'), F.lit(1))


def percent(ratio: Column, digits: int = 1) -> Column:
    """``0.1234`` -> ``12.3%``."""
    return F.concat(F.format_string(f"%.{digits}f", F.bround(ratio * 100, digits)), F.lit("%"))


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(value, digits))
