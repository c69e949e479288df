"""SQL fragments shared by the oracle statements."""

from __future__ import annotations

from collections.abc import Sequence

from voxrisk.catalog.registry import q
from voxrisk.functions import text as tx
from voxrisk.views import ACTIVITY_SQL, COMMENTS_SQL, LATIN_V1, LATIN_V2

COMMENTS = f"WITH {COMMENTS_SQL}"
ACTIVITY = f"WITH {ACTIVITY_SQL}"


def n_matches(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def strip_html(text: str) -> str:
    return f"regexp_replace({text}, '<[^>]+>', '', 'g')"


def collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, {q('[' + tx.BLANK + ']+')}, ' ', 'g'))"


def clean(text: str) -> str:
    return collapse(strip_html(text))


def strip(text: str) -> str:
    return f"regexp_replace({text}, {q('^[' + tx.BLANK + ']+|[' + tx.BLANK + ']+$')}, '', 'g')"


def hits(text: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def any_hit(text: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def tokens(text: str) -> str:
    """List of tokens of two or more characters."""
    return f"list_filter(regexp_split_to_array({text}, {q(tx.TOKEN_BREAK)}), lambda w: length(w) >= 2)"


def stop(words: Sequence[str]) -> str:
    return ", ".join(q(w) for w in words)


def percent(x: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', round_even(CAST({x} AS DOUBLE) * 100, {digits})) || '%'"


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', round_even({x}, {digits}))"


LABEL = "CASE WHEN score < 0.35 THEN 'negative' WHEN score > 0.65 THEN 'positive' ELSE 'neutral' END"

_CATEGORIES = list(dict.fromkeys(c for _, c in LATIN_V2.sensitive))
N_CATEGORIES = "(" + " + ".join(
    f"CASE WHEN {any_hit('content', [w for w, c in LATIN_V2.sensitive if c == cat])} THEN 1 ELSE 0 END" for cat in _CATEGORIES
) + ")"

SENTIMENT_V2 = f"""
hit2 AS (
  SELECT *, {hits('lower(content)', LATIN_V2.positive)} AS pos, {hits('lower(content)', LATIN_V2.negative)} AS neg,
    {hits('content', [w for w, _ in LATIN_V2.sensitive])} AS n_sens, {N_CATEGORIES} AS n_cat
  FROM comments WHERE content <> ''),
sent2 AS (
  SELECT *, {LABEL} AS sentiment, least((pos + neg) / 5.0, 1.0) AS confidence
  FROM (SELECT *, CASE WHEN pos + neg = 0 THEN 0.5 ELSE CAST(pos AS DOUBLE) / (pos + neg) END AS score FROM hit2)),
part2 AS (
  SELECT *,
    CASE WHEN sentiment <> 'negative' THEN 0 WHEN score < 0.2 THEN 40 WHEN score < 0.35 THEN 30 ELSE 20 END AS p_sent,
    CASE WHEN n_sens > 0 THEN least(least(n_cat * 15, 40) + least(n_sens * 8, 30), 40) ELSE 0 END AS p_sens,
    CASE WHEN length(content) < 5 THEN 10 ELSE 0 END
      + CASE WHEN regexp_matches(content, {q(tx.REPEATED_PUNCT)}) THEN 5 ELSE 0 END
      + CASE WHEN regexp_matches(content, {q(tx.REPEATED_BRACKET_EMOJI)}) THEN 5 ELSE 0 END AS p_text
  FROM sent2),
scored2 AS (
  SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high'
    WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS risk_level
  FROM (SELECT *, least(p_sent + p_sens + p_text, 100) AS risk_score FROM part2))"""

SENTIMENT_V1 = f"""
hit1 AS (
  SELECT *, {hits('lower(content)', LATIN_V1.positive)} AS pos, {hits('lower(content)', LATIN_V1.negative)} AS neg,
    {hits('content', [w for w, _ in LATIN_V1.sensitive])} AS n_sens
  FROM comments),
sent1 AS (
  SELECT *, {LABEL} AS sentiment
  FROM (SELECT *, CASE WHEN pos + neg = 0 THEN 0.5 ELSE CAST(pos AS DOUBLE) / (pos + neg) END AS score FROM hit1)),
scored1 AS (
  SELECT *, CASE WHEN risk_score < 30 THEN 'low' WHEN risk_score < 60 THEN 'medium' ELSE 'high' END AS risk_level
  FROM (SELECT *, least(
      CASE WHEN score < 0.2 THEN 30 WHEN score < 0.35 THEN 20 WHEN score < 0.5 THEN 10 ELSE 0 END
      + least(n_sens * 10, 40)
      + CASE WHEN length(content) < 5 THEN 15 WHEN length(content) > 500 THEN 5 ELSE 0 END
      + CASE WHEN regexp_matches(content, {q(tx.REPEATED_PUNCT)}) THEN 5 ELSE 0 END
      + CASE WHEN regexp_matches(content, {q(tx.REPEATED_UNICODE_EMOJI)}) THEN 5 ELSE 0 END
      + CASE WHEN regexp_matches(content, '\\p{{Lu}}') AND NOT regexp_matches(content, '[\\p{{Ll}}\\p{{Lt}}]')
          AND length(content) > 10 THEN 5 ELSE 0 END, 100) AS risk_score FROM sent1))"""

SCORED_V2 = f"{COMMENTS}, {SENTIMENT_V2}"
SCORED_V1 = f"{COMMENTS}, {SENTIMENT_V1}"

USER_KEY = "coalesce(nullif(user_id, ''), nullif(user_name, ''), 'unknown')"
REGION = f"nullif({strip('ip_location')}, '')"
