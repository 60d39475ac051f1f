"""Span-based redaction (NER backend output form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spans as SP
from ..sources import domain as D
from ..sources.tables import table
from .registry import register

SPANS_CTE = """wd AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word,
                     unnest(generate_series(1, len(string_split(text, ' ')))) AS pos FROM documents),
wo AS (SELECT doc_id, pos, word,
              coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
              regexp_full_match(word, '[A-Z][a-z]+') AS cap FROM wd),
wn AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS nw,
              lead(cap) OVER (PARTITION BY doc_id ORDER BY pos) AS ncap FROM wo),
sp AS (SELECT doc_id, start, start + length(word) AS e, 'PERSON' AS entity_type, word AS value FROM wn WHERE cap
       UNION ALL
       SELECT doc_id, start, start + length(word) + 1 + length(nw), 'ORG', word || ' ' || nw FROM wn WHERE cap AND ncap),
so AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY start, e - start DESC, entity_type
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM sp),
cl AS (SELECT *, sum(CASE WHEN pm IS NULL OR start >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id
              ORDER BY start, e - start DESC, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM so),
un AS (SELECT doc_id, c, min(start) AS start, max(e) AS e, first(entity_type ORDER BY start, e - start DESC, entity_type) AS entity_type
       FROM cl GROUP BY doc_id, c),
kept AS (SELECT un.*, substring(d.text, un.start + 1, un.e - un.start) AS value FROM un JOIN documents d USING (doc_id)),
num AS (SELECT doc_id, value, ty AS entity_type, row_number() OVER (PARTITION BY doc_id, ty ORDER BY f) AS no
        FROM (SELECT doc_id, value, min(start) AS f, arg_min(entity_type, start) AS ty FROM kept GROUP BY doc_id, value)),
tok AS (SELECT k.doc_id, k.start, k.e, printf('[%s_%04d]', n.entity_type, n.no) AS token
        FROM kept k JOIN num n ON n.doc_id = k.doc_id AND n.value = k.value),
pc AS (SELECT t.doc_id, t.start, t.e,
              substring(d.text, coalesce(lag(t.e) OVER (PARTITION BY t.doc_id ORDER BY t.start), 0) + 1,
                        t.start - coalesce(lag(t.e) OVER (PARTITION BY t.doc_id ORDER BY t.start), 0)) || t.token AS piece
       FROM tok t JOIN documents d ON d.doc_id = t.doc_id),
body AS (SELECT doc_id, string_agg(piece, '' ORDER BY start) AS b, max(e) AS last_end, count(*) AS n FROM pc GROUP BY doc_id),
st AS (SELECT doc_id, count(*) FILTER (WHERE entity_type = 'PERSON') AS n_person,
              count(*) FILTER (WHERE entity_type = 'ORG') AS n_org FROM num GROUP BY doc_id)"""


@register("redact_by_spans", "2.3", f"""WITH {SPANS_CTE}
SELECT d.doc_id, CASE WHEN b.doc_id IS NULL THEN d.text ELSE b.b || substring(d.text, b.last_end + 1) END AS redacted_text,
       coalesce(b.n, 0)::INTEGER AS n_spans, coalesce(st.n_person, 0)::INTEGER AS n_person,
       coalesce(st.n_org, 0)::INTEGER AS n_org
FROM documents d LEFT JOIN body b ON b.doc_id = d.doc_id LEFT JOIN st ON st.doc_id = d.doc_id""")
def redact_by_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = SP.redact_by_spans(docs, D.ner_spans(spark, sf_dir))
    return r.select("doc_id", "redacted_text", "n_spans",
                    F.coalesce(F.col("stats")["PERSON"], F.lit(0)).alias("n_person"),
                    F.coalesce(F.col("stats")["ORG"], F.lit(0)).alias("n_org"))
