"""DuckDB SQL of the probe queries: the normal equations by conjugate gradients.

The Spark side solves them by an eigendecomposition; here a recursive query goes
from residual to residual, for every penalty at once.
"""

from __future__ import annotations

STEPS = 600


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}]+')"


def text_ctes(train: str, scored: str, size: int = 1024) -> str:
    """``x`` (id, i, x): weighted bucket counts of ``scored`` (id, text), document
    frequencies from ``train`` (id, text, y)."""
    return f"""
      occ AS (SELECT id, unnest({words('text')}) AS w FROM {scored}),
      tf AS (SELECT id, CAST('0x' || left(md5(w), 8) AS BIGINT) % {size} AS i, CAST(count(*) AS DOUBLE) AS c FROM occ GROUP BY ALL),
      docs_n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {train}),
      df AS (SELECT i, count(*) AS df FROM tf SEMI JOIN {train} USING (id) GROUP BY i),
      x AS MATERIALIZED (SELECT id, i, c * ln((n + 1) / (coalesce(df, 0) + 1)) AS x FROM tf LEFT JOIN df USING (i) CROSS JOIN docs_n)"""


VECTORS = """
      x AS (SELECT vec_id AS id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


def fit_ctes(train: str, size: int, penalties: tuple[float, ...]) -> str:
    """``fit`` (penalty, i, w) and ``base`` (penalty, c) from ``x`` and ``train`` (id, y)."""
    return f"""
      tx AS MATERIALIZED (SELECT x.*, t.y FROM x JOIN {train} t USING (id)),
      size_n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(y) AS y FROM {train}),
      places AS (SELECT unnest(range(0, {size})) AS i),
      means AS MATERIALIZED (SELECT i, coalesce(sum(x), 0) / any_value(n) AS m, coalesce(sum(x * tx.y), 0) / any_value(n) AS xy
        FROM places CROSS JOIN size_n LEFT JOIN tx USING (i) GROUP BY i),
      pull AS MATERIALIZED (SELECT list(xy - m * size_n.y ORDER BY i) AS b FROM means CROSS JOIN size_n),
      pairs AS (SELECT a.i AS i, c.i AS j, sum(a.x * c.x) AS s FROM tx a JOIN tx c USING (id) GROUP BY ALL),
      lines AS MATERIALIZED (SELECT i, list(coalesce(s, 0) / n - means.m * other.m ORDER BY j) AS line FROM means
        CROSS JOIN (SELECT i AS j, m FROM means) other CROSS JOIN size_n LEFT JOIN pairs USING (i, j) GROUP BY i),
      cg AS (
        SELECT 0 AS k, penalty, list_transform(b, lambda v: CAST(0 AS DOUBLE)) AS w, b AS r, b AS p, list_dot_product(b, b) AS rr
        FROM pull CROSS JOIN (SELECT unnest([{', '.join(map(repr, penalties))}]::DOUBLE[]) AS penalty)
        UNION ALL
        SELECT k + 1, penalty, w, r, list_transform(list_zip(r, p), lambda z: z[1] + beta * z[2]), rr2
        FROM (SELECT *, list_dot_product(r, r) AS rr2, list_dot_product(r, r) / rr AS beta
          FROM (SELECT k, penalty, rr, p, list_transform(list_zip(w, p), lambda z: z[1] + alpha * z[2]) AS w,
              list_transform(list_zip(r, sp, p), lambda z: z[1] - alpha * (z[2] + penalty * z[3])) AS r
            FROM (SELECT *, rr / (list_dot_product(p, sp) + penalty * list_dot_product(p, p)) AS alpha
              FROM (SELECT penalty, any_value(k) AS k, any_value(w) AS w, any_value(r) AS r, any_value(p) AS p, any_value(rr) AS rr,
                  list(list_dot_product(line, p) ORDER BY i) AS sp
                FROM cg CROSS JOIN lines WHERE k < {STEPS} AND rr > 1e-22 GROUP BY penalty))))),
      solved AS MATERIALIZED (SELECT penalty, w FROM cg QUALIFY row_number() OVER (PARTITION BY penalty ORDER BY k DESC) = 1),
      fit AS (SELECT penalty, unnest(range(0, {size})) AS i, unnest(w) AS w FROM solved),
      base AS (SELECT penalty, any_value(size_n.y) - sum(m * w) AS c FROM fit JOIN means USING (i) CROSS JOIN size_n GROUP BY penalty)"""


def output_ctes(ids: str) -> str:
    """``output`` (penalty, id, logit) for the rows of ``ids`` (id)."""
    return f"""
      output AS (SELECT penalty, d.id, any_value(c) + coalesce(sum(x.x * w), 0) AS logit
        FROM {ids} d CROSS JOIN base LEFT JOIN x USING (id) LEFT JOIN fit USING (penalty, i) GROUP BY ALL)"""


REPORT = """
      preds AS (SELECT penalty, CAST(t.y AS INTEGER) AS label, CAST(logit > 0.5 AS INTEGER) AS pred FROM output JOIN test t USING (id)),
      cells AS (SELECT DISTINCT penalty, unnest([label, pred]) AS c FROM preds),
      hits AS (SELECT penalty, c, count(*) FILTER (label = c AND pred = c) AS tp, count(*) FILTER (label = c) AS support,
        count(*) FILTER (pred = c) AS predicted FROM preds JOIN cells USING (penalty) GROUP BY ALL),
      f AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r,
        CASE WHEN 2 * tp > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1 FROM hits),
      macro AS (SELECT penalty, avg(p) AS precision, avg(r) AS recall, avg(f1) AS f1_macro, sum(tp) / sum(support) AS accuracy FROM f GROUP BY penalty)"""


def statements(order, held_out) -> dict[str, str]:
    """``order`` and ``held_out`` are the seeded hashes of ``duck_sql``."""
    labelled = "labelled AS (SELECT doc_id AS id, text, CAST(quality AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id))"
    vectors = "v AS (SELECT vec_id AS id, CAST(label < 5 AS DOUBLE) AS y FROM embeddings)"
    split = f"train AS (SELECT * FROM s WHERE NOT ({held_out('id')})), test AS (SELECT * FROM s WHERE {held_out('id')})"
    sample = f"s AS (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY y ORDER BY {order('id')}, id) <= 500)"
    gradients = ", ".join(f"CAST({p!r} AS DOUBLE)" for p in (0.0, 0.01, 0.1))
    return {
        "text_features": f"""WITH {labelled}, {text_ctes('labelled', 'labelled')}
            SELECT id AS doc_id, CAST(count(x.x) FILTER (x.x > 0) AS INTEGER) AS n_features, round(coalesce(sum(x.x), 0), 3) AS weight
            FROM labelled LEFT JOIN x USING (id) GROUP BY id""",
        "linear_probe": f"""WITH RECURSIVE {vectors}, {VECTORS}, {fit_ctes('v', 64, (0.0,))}, {output_ctes('v')}
            SELECT id AS vec_id, round(logit, 4) AS logit FROM output""",
        "best_probe": f"""WITH RECURSIVE {vectors}, s AS (FROM v), {split}, {VECTORS}, {fit_ctes('train', 64, (0.0, 0.01, 0.1))},
            {output_ctes('test')}, {REPORT} SELECT penalty AS reg, round(precision, 6) AS precision, round(recall, 6) AS recall,
            round(f1_macro, 6) AS f1_macro, round(accuracy, 6) AS accuracy FROM macro""",
        "train_quality": f"""WITH RECURSIVE {labelled}, {sample}, {split}, {text_ctes('train', 's')}, {fit_ctes('train', 1024, (0.01, 0.1, 1.0))},
            {output_ctes('test')}, {REPORT}, chosen AS (SELECT penalty FROM macro ORDER BY round(f1_macro, 9) DESC, penalty LIMIT 1),
            g AS (SELECT f.* FROM f SEMI JOIN chosen USING (penalty)),
            rep AS (SELECT CAST(c AS VARCHAR) AS name, p, r, f1, support FROM g
              UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM g
              UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM g
              UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM g)
            SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep""",
        "score_corpus": f"""WITH RECURSIVE {labelled}, d AS (SELECT doc_id AS id, text FROM documents), {text_ctes('labelled', 'd')},
            {fit_ctes('labelled', 1024, (0.01,))}, {output_ctes('d')} SELECT id AS doc_id, round(1 / (1 + exp(-logit)), 4) AS score FROM output""",
        "grid_gradient": f"""SELECT penalty AS reg, CAST(i AS INTEGER) AS feature, CAST(0 AS DOUBLE) AS gradient, (SELECT count(*) FROM embeddings) AS n
            FROM range(0, 65) t(i), (SELECT unnest([{gradients}]) AS penalty)""",
    }
