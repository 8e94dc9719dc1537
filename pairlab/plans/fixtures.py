"""Views of the driver's tables in the shape of a catalogue: one SQL text each, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (inputs, SQL with {input} places).
VIEWS = {
    "items": (("part",), """
SELECT CAST(p_partkey AS BIGINT) AS id,
       concat(p_name, ' ', CAST(p_size AS STRING), ' mod', CAST(p_partkey % 37 AS STRING)) AS name,
       p_type AS category,
       CASE WHEN p_partkey % 50 = 0 THEN 'not json'
            ELSE concat('{{"Brand":"', p_brand, '","Size":"', CAST(p_size AS STRING),
                        '","Colour":["', split_part(p_name, ' ', 1), '","', split_part(p_name, ' ', 2),
                        '"],"Article":"A', CAST(p_partkey % 41 AS STRING), '"}}') END AS attributes
FROM {part}"""),
    "pairs": (("items",), """
SELECT a.id AS id1, b.id AS id2, a.category AS category,
       CAST(CASE WHEN (a.id * 31 + b.id * 17) % 5 = 0 THEN 1 ELSE 0 END AS INT) AS target
FROM {items} a JOIN {items} b
  ON a.category = b.category AND floor(a.id / 24) = floor(b.id / 24) AND a.id < b.id
WHERE (a.id * 7 + b.id * 13) % 3 <> 0"""),
    "folded": (("pairs",), """
SELECT id1, id2, category, target, CAST(floor(id1 / 24) AS BIGINT) % 4 AS fold FROM {pairs}"""),
    "scores": (("pairs",), """
SELECT m.model, p.id1, p.id2,
       CAST(CAST((p.id1 * m.c1 + p.id2 * m.c2 + 300 * p.target) % 1000 AS DOUBLE) / 1000.0 AS DOUBLE) AS predict
FROM {pairs} p CROSS JOIN (SELECT 'm1' AS model, 7919 AS c1, 104729 AS c2 UNION ALL
                           SELECT 'm2', 6607, 15013 UNION ALL SELECT 'm3', 433, 7703) m"""),
    "scored": (("folded", "scores"), """
SELECT s.model, f.fold, f.category, f.id1, f.id2, f.target, s.predict
FROM {folded} f JOIN {scores} s ON f.id1 = s.id1 AND f.id2 = s.id2"""),
    "journal": (("events",), """
SELECT CAST(user_id AS BIGINT) AS id1, CAST(user_id + 1 + event_id % 7 AS BIGINT) AS id2,
       CAST(CASE WHEN value < 20 THEN -1 WHEN value < 200 THEN 0 ELSE 1 END AS INT) AS audited_label,
       CAST(event_id % 2 AS INT) AS original_target, event_type AS mode, event_id AS judged_at
FROM {events}"""),
    "verdicts": (("pairs",), """
SELECT p.id1, p.id2, CAST(CASE WHEN r.k = 1 THEN p.target WHEN (p.id1 + p.id2) % 3 = 0 THEN -1 ELSE 1 - p.target END AS INT) AS audited_label,
       p.target AS original_target, CASE WHEN p.id1 % 3 = 0 THEN 'random' WHEN p.id1 % 3 = 1 THEN 'fn' ELSE 'fp' END AS mode,
       p.category AS category, CAST(p.id1 * 10 + r.k AS BIGINT) AS judged_at
FROM {pairs} p CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) r WHERE (p.id1 + p.id2) % 11 = 0"""),
}


class Tables:
    """The views of one folder as DataFrames, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                inputs, sql = VIEWS[name]
                self.made[name] = self.spark.sql(sql, **{x: getattr(self, x) for x in inputs})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]


def with_views(sql: str) -> str:
    """sql after WITH clauses for every view."""
    ctes = ", ".join(f"{name} AS ({text.format(**{x: x for x in inputs})})" for name, (inputs, text) in VIEWS.items())
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH "):
        body = body[len("WITH RECURSIVE ") if recursive else len("WITH ") :]
        return f"WITH {'RECURSIVE ' * recursive}{ctes}, {body}"
    return f"WITH {ctes} {body}"
