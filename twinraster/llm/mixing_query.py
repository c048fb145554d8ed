"""op10: all documents with the probability that mixes them to the target margins, and the draw."""
from __future__ import annotations

from . import register
from .common import table
from .mixing import REST, SWEEPS, TARGETS, mix_sources

SEED = 11


def _sql() -> str:
    """The same raking as plain SQL: per sweep and margin, weight times target over the margin's present sum."""
    margins = list(TARGETS)
    column = {"topic": "CASE WHEN tokens < 100 THEN 'note' WHEN tokens < 400 THEN 'article' WHEN tokens < 2000 THEN 'essay' ELSE 'book' END"}
    named = {m: ", ".join(f"'{v}'" for v in TARGETS[m] if v != REST) for m in margins}
    of = {m: f"CASE WHEN {column.get(m, m)} IN ({named[m]}) THEN {column.get(m, m)} ELSE '{REST}' END" for m in margins}
    share = {m: "CASE m_" + m + " " + " ".join(f"WHEN '{v}' THEN {s!r}" for v, s in TARGETS[m].items()) + " ELSE 0.0 END" for m in margins}
    keys = ", ".join(f"m_{m}" for m in margins)
    parts = [
        "t AS (SELECT doc_id, source, lang, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents)",
        "d AS (SELECT doc_id, tokens, " + ", ".join(f"{of[m]} AS m_{m}" for m in margins) + " FROM t)",
        f"c AS (SELECT {keys}, CAST(sum(tokens) AS DOUBLE) AS n FROM d GROUP BY ALL)",
        "w_0 AS MATERIALIZED (SELECT *, n / sum(n) OVER () AS w FROM c)",
    ]
    step = 0
    for _ in range(SWEEPS):
        for m in margins:
            held = f"(SELECT sum(s) FROM (SELECT m_{m}, {share[m]} AS s FROM w_{step} GROUP BY m_{m} HAVING sum(w) > 0))"
            parts.append(
                f"w_{step + 1} AS MATERIALIZED (SELECT {keys}, n, CASE WHEN sum(w) OVER (PARTITION BY m_{m}) > 0 "
                f"THEN w * ({share[m]}) / {held} / sum(w) OVER (PARTITION BY m_{m}) ELSE 0.0 END AS w FROM w_{step})")
            step += 1
    parts.append(f"p AS (SELECT {keys}, CASE WHEN n > 0 THEN round((w / n) / max(CASE WHEN n > 0 THEN w / n ELSE 0.0 END) OVER (), 9) ELSE 1.0 END AS keep_probability FROM w_{step})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, tokens, keep_probability,
       CAST(('0x' || substr(md5('{SEED}|' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 < keep_probability AS sampled
FROM d JOIN p USING ({keys})"""


@register("op10_mixing", _sql())
def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mix_sources(docs, TARGETS, seed=SEED).select("doc_id", "tokens", "keep_probability", "sampled")
