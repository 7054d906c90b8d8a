"""SQL fragments shared by the oracles: common table expressions and formula text."""
from __future__ import annotations

from docsift.functions.stopwords import ENGLISH

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)

TOK = """tok AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+['']*[A-Za-z]*')) AS word
  FROM documents)"""
NOSTOP = TOK + f""",
nostop AS (SELECT doc_id, word FROM tok WHERE lower(word) NOT IN ({STOP}))"""
WC = NOSTOP + """,
wc AS (SELECT doc_id, word, count(*) AS cnt FROM nostop GROUP BY doc_id, word)"""
KEPT = WC + """,
freq AS (SELECT word, count(*) AS df, cast(sum(cnt) AS BIGINT) AS cf FROM wc GROUP BY word),
kept AS (SELECT * FROM freq WHERE df >= 2 AND df / (SELECT count(*) FROM documents) <= 0.8)"""
VOCAB = KEPT + """,
vocab AS (SELECT cast(row_number() OVER (ORDER BY md5('0:' || word), word) - 1 AS INTEGER) AS word_id, word, df, cf
  FROM kept)"""
DT = VOCAB + """,
dt AS (SELECT doc_id, word_id, cnt FROM wc JOIN vocab USING (word))"""


def rnd(expr: str, digits: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def digamma(x: str) -> str:
    """Digamma as text: six shifts, then the asymptotic series."""
    y = f"({x} + 6.0)"
    shifts = " - ".join(f"1.0 / ({x} + {i}.0)" for i in range(6))
    return (
        f"(ln({y}) - 0.5 / {y} - 1.0 / (12.0 * pow({y}, 2)) + 1.0 / (120.0 * pow({y}, 4))"
        f" - 1.0 / (252.0 * pow({y}, 6)) + 1.0 / (240.0 * pow({y}, 8)) - 1.0 / (132.0 * pow({y}, 10)) - {shifts})"
    )
