"""Ranking-metric queries: recorded runs are the lists, favourites-like interactions the relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm.operators import evaluation as ev
from tonearm.plans.registry import query, r6

NUM = "CAST(substring(track_id, 7) AS BIGINT)"
# each run is one ranked list; what the user interacted with is relevant
VIEWS = {
    "recs": "SELECT r.id AS anchor_id, i.track_id, min(i.rank) AS rank FROM runs r JOIN items i ON i.run_id = r.id GROUP BY 1, 2",
    "rel": "SELECT DISTINCT r.id AS anchor_id, x.track_id FROM runs r JOIN interactions x ON x.user_id = r.user_id WHERE x.event_type = 'liked'",
    "n_rel": "SELECT anchor_id, count(*) AS n FROM rel GROUP BY anchor_id",
    "marked": """SELECT c.anchor_id, c.track_id, c.rank, CASE WHEN l.track_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS hit FROM recs c
      LEFT JOIN rel l ON l.anchor_id = c.anchor_id AND l.track_id = c.track_id WHERE c.rank <= 5""",
    "metrics": """SELECT m.anchor_id, sum(hit) / 5 AS "precision", CASE WHEN coalesce(any_value(n.n), 0) > 0 THEN sum(hit) / any_value(n.n) ELSE 0 END AS recall,
      CASE WHEN coalesce(any_value(n.n), 0) > 0 THEN sum(hit / log2(rank + 1)) / list_sum(list_transform(range(1, least(any_value(n.n), 5) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0 END AS ndcg
      FROM marked m LEFT JOIN n_rel n ON n.anchor_id = m.anchor_id GROUP BY m.anchor_id""",
    "vecs": "SELECT 'apple-' || vec_id AS track_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings",
    "div": """SELECT a.anchor_id, CASE WHEN count(DISTINCT a.track_id) < 2 THEN 0.0 ELSE round(1 - sum(CASE WHEN a.track_id <> b.track_id THEN list_cosine_similarity(x.v, y.v) ELSE 0 END)
      / (count(DISTINCT a.track_id) * (count(DISTINCT a.track_id) - 1)), 4) END AS diversity
      FROM recs a JOIN recs b ON a.anchor_id = b.anchor_id AND a.rank <= 5 AND b.rank <= 5 JOIN vecs x ON x.track_id = a.track_id JOIN vecs y ON y.track_id = b.track_id GROUP BY a.anchor_id""",
    "rel_sets": f"""SELECT a.track_id AS anchor_id, b.track_id, row_number() OVER (PARTITION BY a.track_id ORDER BY b.pos) AS rank
      FROM (SELECT *, {NUM} AS pos FROM tracks) a JOIN (SELECT *, {NUM} AS pos FROM tracks) b
      ON (a.provider_genre = b.provider_genre OR a.theme_pool = b.theme_pool) AND a.track_id <> b.track_id QUALIFY rank <= 50""",
}


def recs(c):
    return (c.runs.select(F.col("id").alias("anchor_id")).join(c.items.withColumnRenamed("run_id", "anchor_id"), "anchor_id")
            .groupBy("anchor_id", "track_id").agg(F.min("rank").alias("rank")))


def rel(c):
    liked = c.interactions.filter("event_type = 'liked'").select("user_id", "track_id").distinct()
    return c.runs.select(F.col("id").alias("anchor_id"), "user_id").join(liked, "user_id").select("anchor_id", "track_id")


def vectors(c):
    return c.raw("embeddings").select(F.concat(F.lit("apple-"), "vec_id").alias("track_id"),
                                      F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def _metric(name):
    @query(f"q_{name}", views=VIEWS, sql=f'SELECT anchor_id, round("{name}", 6) + 0.0 AS "{name}" FROM metrics')
    def run(c):
        return ev.list_metrics(recs(c), rel(c), 5).select("anchor_id", r6(name))


for _n in ("precision", "recall", "ndcg"):
    _metric(_n)


@query("q_coverage", views=VIEWS, sql="""
SELECT count(DISTINCT track_id) AS recommended, (SELECT count(*) FROM tracks) AS catalogue,
 round(count(DISTINCT track_id) / (SELECT count(*) FROM tracks)::DOUBLE, 6) AS coverage FROM recs""")
def q_coverage(c):
    return ev.coverage(recs(c), c.tracks).select("recommended", "catalogue", r6("coverage"))


@query("q_diversity", views=VIEWS, sql="SELECT anchor_id, round(diversity, 3) + 0.0 AS diversity FROM div")
def q_diversity(c):
    """Compared to three decimals: the operator itself rounds to four."""
    return ev.diversity(recs(c).filter("rank <= 5"), vectors(c), 64).select("anchor_id", (F.round("diversity", 3) + F.lit(0.0)).alias("diversity"))


def catalogue_labels(c):
    return c.tracks.select("track_id", F.col("provider_genre").alias("genre"), F.col("theme_pool").alias("theme"),
                           F.expr(NUM).alias("position"))


@query("q_relevance", views=VIEWS, sql="SELECT anchor_id, track_id, CAST(rank AS BIGINT) AS rank FROM rel_sets")
def q_relevance(c):
    t = catalogue_labels(c)
    return ev.relevance(t, t).select("anchor_id", "track_id", F.col("rank").cast("bigint").alias("rank"))


@query("q_evaluate", views=VIEWS, sql="""
SELECT round(avg("precision"), 4) AS "precision", round(avg(recall), 4) AS recall, round(avg(ndcg), 4) AS ndcg, round(avg(diversity), 4) AS diversity, count(*) AS n_evaluated,
 round((SELECT count(DISTINCT track_id) FROM recs WHERE rank <= 5) / (SELECT count(*) FROM tracks)::DOUBLE, 4) AS coverage
FROM metrics LEFT JOIN div USING (anchor_id)""")
def q_evaluate(c):
    return ev.evaluate(recs(c), rel(c), c.tracks, vectors(c), 64, 5).select(
        "precision", "recall", "ndcg", "diversity", "n_evaluated", "coverage")
