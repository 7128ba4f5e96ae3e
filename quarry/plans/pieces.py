"""Pieces of SQL that several modules' queries share."""

from __future__ import annotations

KNN = """ev AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), ep AS (SELECT a.vec_id AS s, b.vec_id AS d, list_dot_product(a.v, b.v) AS score FROM ev a JOIN ev b ON a.vec_id <> b.vec_id),
  et AS (SELECT * FROM ep WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY s ORDER BY round(score, 9) DESC, d) <= 10),
  kn AS (SELECT least(s, d) AS a, greatest(s, d) AS b, max(score) AS score FROM et GROUP BY 1, 2), sim AS (SELECT a AS src, b AS dst, score FROM kn UNION ALL SELECT b, a, score FROM kn)"""


def hits_sql(groups, words: str = "w") -> str:
    one = lambda a: "(" + " AND ".join(f"list_contains({words}, '{x}')" for x in a.split()) + ")"
    return "(" + " + ".join("(" + " OR ".join(one(a) for a in g) + ")::INT" for g in groups) + ")"
