"""Search queries; the query batch is derived from the catalogue's own titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm.functions import taxonomy as tax, text as tx
from tonearm.operators import search as se
from tonearm.plans import oracle as o
from tonearm.plans.registry import query, r6, r6s

N = o.norm_search
TOK = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
EDIT = """CASE WHEN left({0}, 180) = left({1}, 180) THEN 1.0 WHEN {0} = '' OR {1} = '' THEN 0.0
  ELSE greatest(0.0, 1 - levenshtein(left({0}, 180), left({1}, 180)) / greatest(len(left({0}, 180)), len(left({1}, 180)))::DOUBLE) END::DOUBLE"""


def cover(q, c):
    match = f"({{t}} = u OR (len({{t}}) >= 4 AND len(u) >= 4 AND {EDIT.format('{t}', 'u')} >= CASE WHEN greatest(len({{t}}), len(u)) <= 5 THEN 0.8 ELSE 0.72 END))".replace("{t}", "t")
    return f"CASE WHEN len({q}) = 0 THEN 0.0 ELSE len(list_filter({q}, lambda t: len(list_filter({c}, lambda u: {match})) > 0)) / len({q})::DOUBLE END"


def relevance_sql(source: str) -> str:
    """``source`` exposes keep columns and q, t, a (normalised), analysed, playable."""
    b = lambda cond, p: f"CASE WHEN {cond} THEN {p} ELSE 0 END::DOUBLE"
    return f"""SELECT *, cov * 40 + tcov * 10 + acov * 6 + {b('combined = q OR reversed = q', 80)} + {b('t = q', 65)} + {b('contains(combined, q) OR contains(reversed, q)', 30)}
  + {b('contains(q, t) AND len(t) >= 3', 22)} + {b('starts_with(combined, q) OR starts_with(reversed, q)', 12)} + {EDIT.format('q', 'combined')} * 14 + {EDIT.format('q', 't')} * 6
  - CASE WHEN cov < 1 THEN (1 - cov) * 18 ELSE 0 END + {b('analysed', 0.35)} + {b('playable', 0.15)} AS relevance
 FROM (SELECT *, {cover('qt', 'list_concat(tt, aw)')} AS cov, {cover('qt', 'tt')} AS tcov, {cover('qt', 'aw')} AS acov FROM (
  SELECT *, trim(t || ' ' || a) AS combined, trim(a || ' ' || t) AS reversed, {TOK.format('q')} AS qt, {TOK.format('t')} AS tt, {TOK.format('a')} AS aw FROM ({source})))"""


Q1 = "small artist 1"


@query("q_search_terms", sql="SELECT track_id, title, artist FROM tracks WHERE " + " AND ".join(
    f"contains(lower(title || ' ' || artist || ' ' || album), '{t}')" for t in Q1.split()))
def q_search_terms(c):
    return se.search_terms(c.tracks, Q1).select("track_id", "title", "artist")


@query("q_filter_category", sql="""
SELECT 'signature' AS fields, track_id FROM tracks WHERE track_id IN (SELECT track_id FROM fp WHERE contains(acoustic_signature, 'driving'))
UNION ALL SELECT 'any', track_id FROM tracks WHERE contains(lower(provider_genre), 'rock') OR contains(lower(provider_subgenre), 'rock')
  OR track_id IN (SELECT track_id FROM fp WHERE contains(texture, 'rock') OR contains(acoustic_signature, 'rock'))""")
def q_filter_category(c):
    a = se.filter_category(c.tracks, c.fingerprints, "Driving").select(F.lit("signature").alias("fields"), "track_id")
    return a.union(se.filter_category(c.tracks, c.fingerprints, " rock", "any").select(F.lit("any"), "track_id"))


@query("q_page", views={"pg": "SELECT * FROM tracks QUALIFY row_number() OVER (PARTITION BY trim(lower(title)), trim(lower(artist)) ORDER BY track_id) = 1"},
       sql="SELECT track_id, title, (SELECT count(*) FROM pg) AS total FROM (SELECT * FROM pg ORDER BY title, track_id LIMIT 100 OFFSET 200)")
def q_page(c):
    """Third page of one hundred (paging is the feature)."""
    return se.page(c.tracks, 3, 100).select("track_id", "title", "total")


@query("q_normalize_search", sql=f"SELECT track_id, {N('title')} AS title_n, {N(chr(39) + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39) + ' || artist')} AS search_text FROM tracks")
def q_normalize_search(c):
    return c.tracks.select("track_id", tx.normalize_search("title").alias("title_n"), tx.search_text("title", "artist").alias("search_text"))


@query("q_normalize_folded", sql=f"SELECT doc_id, len({o.norm_folded('text')}) AS n, md5({o.norm_folded('text')}) AS digest FROM documents")
def q_normalize_folded(c):
    """Whole document texts (accented French, German, Spanish) folded and compared by digest."""
    folded = tx.normalize_search_folded("text")
    return c.raw("documents").select("doc_id", F.length(folded).cast("bigint").alias("n"), F.md5(folded).alias("digest"))


# search batch: every distinct product name in several spellings
QUERY_SQL = """SELECT p_name || '#' || kind AS query_id, CASE kind WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || ' by ' || artist
  WHEN 2 THEN substring(p_name, 1, 1) || substring(p_name, 3, 1) || substring(p_name, 2, 1) || substring(p_name, 4)
  WHEN 3 THEN substring(p_name, 1, 2) || substring(p_name, 4) ELSE substring(p_name, 2, 2) END AS query
 FROM (SELECT p_name, 'artist ' || min(regexp_extract(p_brand, '([0-9]+)', 1)) AS artist FROM part GROUP BY p_name) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS kind)"""


def batch(c):
    return c._sql(QUERY_SQL.replace("unnest([0, 1, 2, 3, 4])", "explode(array(0, 1, 2, 3, 4))"), part=c.raw("part"))


GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
ORDERED = GRAMS.replace("list_distinct(", "(", 1)
FUZZY = {
    "sq": f"SELECT query_id, q, {GRAMS.format('q')} AS qg FROM (SELECT query_id, {N('query')} AS q FROM ({QUERY_SQL})) WHERE q <> ''",
    "st": f"SELECT track_id, title_n, txt, {GRAMS.format('txt')} AS tg, {ORDERED.format('txt')} AS og FROM (SELECT track_id, {N('title')} AS title_n, {N('title || chr(32) || artist')} AS txt FROM tracks)",
    "sp": """SELECT *, contains(txt, q) AS inside, ov / (len(qg) + len(tg) - ov)::DOUBLE AS sim FROM (
      SELECT query_id, q, qg, track_id, title_n, txt, tg, og, len(list_intersect(qg, tg)) AS ov FROM sq CROSS JOIN st)""",
    "sw": """SELECT *, CASE WHEN ov = 0 THEN 0.0 ELSE list_max(list_transform(range(1, len(og) + 1), lambda i: CASE WHEN list_contains(qg, og[i]) THEN list_max(list_transform(range(i, len(og) + 1), lambda j:
      CASE WHEN list_contains(qg, og[j]) THEN len(list_intersect(list_distinct(og[i:j]), qg)) / (len(qg) + len(list_distinct(og[i:j])) - len(list_intersect(list_distinct(og[i:j]), qg)))::DOUBLE ELSE 0.0 END)) ELSE 0.0 END)) END AS ws
      FROM sp WHERE inside OR sim >= 0.16 OR ov / len(qg)::DOUBLE >= 0.28""",
    "sf": """SELECT *, CASE WHEN title_n = q THEN 10.0 ELSE 0.0 END::DOUBLE + CASE WHEN txt = q THEN 8.0 ELSE 0.0 END::DOUBLE + CASE WHEN starts_with(title_n, q) THEN 4.0 ELSE 0.0 END::DOUBLE
      + CASE WHEN inside THEN 2.0 ELSE 0.0 END::DOUBLE + 3.5::DOUBLE * sim + 2.5::DOUBLE * ws AS score FROM sw WHERE inside OR sim >= 0.16 OR ws >= 0.28""",
}


@query("q_search_fuzzy", views=FUZZY, sql="""
SELECT query_id, track_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, track_id) AS BIGINT) AS rank FROM sf QUALIFY rank <= 80""")
def q_search_fuzzy(c):
    return se.search_fuzzy(c.tracks, batch(c), 80, c.text_index).select("query_id", "track_id", r6("score"), F.col("rank").cast("bigint").alias("rank"))


@query("q_word_similarity", views=FUZZY, sql="SELECT query_id, track_id, round(sim, 6) AS similarity, round(ws, 6) AS word_similarity FROM sf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, track_id) <= 200")
def q_word_similarity(c):
    return se.search_fuzzy(c.tracks, batch(c), 200, c.text_index).select("query_id", "track_id", r6("similarity"), r6("word_similarity"))


PAIR = "run_pairs rp JOIN tracks a ON a.track_id = rp.anchor_id JOIN tracks b ON b.track_id = rp.track_id"


def title_pairs(c):
    n = c.tracks.select("track_id", "preview_url", tx.normalize_search_folded("title").alias("t"), tx.normalize_search_folded("artist").alias("a"))
    q = n.select(F.col("track_id").alias("anchor_id"), F.col("t").alias("q"))
    fp = c.fingerprints.select("track_id", F.lit(True).alias("analysed"))
    return c.run_pairs.join(q, "anchor_id").join(n, "track_id").join(fp, "track_id", "left").fillna(False, ["analysed"])


@query("q_edit_similarity", sql=f"SELECT anchor_id, track_id, round({EDIT.format('q', 't')}, 6) AS similarity FROM (SELECT rp.*, {N('a.title')} AS q, {N('b.title')} AS t FROM {PAIR})")
def q_edit_similarity(c):
    return title_pairs(c).select("anchor_id", "track_id", r6(tx.edit_similarity("q", "t"), "similarity"))


@query("q_token_coverage", sql=f"SELECT anchor_id, track_id, round({cover('qt', 'ct')}, 6) AS coverage FROM (SELECT rp.*, {TOK.format(N('a.title'))} AS qt, list_concat({TOK.format(N('b.title'))}, {TOK.format(N('b.artist'))}) AS ct FROM {PAIR})")
def q_token_coverage(c):
    return title_pairs(c).select("anchor_id", "track_id", r6(tx.token_coverage(tx.tokens("q"), F.concat(tx.tokens("t"), tx.tokens("a"))), "coverage"))


PAIR_TEXT = f"SELECT rp.*, {N('a.title')} AS q, {N('b.title')} AS t, {N('b.artist')} AS a, b.track_id IN (SELECT track_id FROM fp) AS analysed, b.preview_url IS NOT NULL AS playable FROM {PAIR}"


@query("q_search_relevance", sql=f"SELECT anchor_id, track_id, round(relevance, 6) + 0.0 AS relevance FROM ({relevance_sql(PAIR_TEXT)})")
def q_search_relevance(c):
    scored = tx.add_relevance(title_pairs(c), "q", "t", "a", "analysed", F.col("preview_url").isNotNull())
    return scored.select("anchor_id", "track_id", r6("relevance"))


WORDS = {"vocab_words": f"SELECT DISTINCT unnest({TOK.format(N('title || chr(32) || artist'))}) AS word FROM tracks",
  "qw": f"SELECT query_id, unnest(string_split({N('query')}, ' ')) AS word, generate_subscripts(string_split({N('query')}, ' '), 1) AS pos FROM ({QUERY_SQL})",
  "qs": """SELECT query_id, pos, word, unnest(list_distinct(list_transform(range(1, len(word)), lambda i: substring(word, 1, i - 1) || substring(word, i + 1, 1) || substring(word, i, 1) || substring(word, i + 2)))) AS known
    FROM qw WHERE len(word) >= 4 AND word NOT IN (SELECT word FROM vocab_words)""",
  "qf": "SELECT query_id, pos, min(known) AS fix FROM qs WHERE known IN (SELECT word FROM vocab_words) GROUP BY query_id, pos HAVING count(*) = 1",
  "qc": "SELECT w.query_id, string_agg(coalesce(f.fix, w.word), ' ' ORDER BY w.pos) AS corrected FROM qw w LEFT JOIN qf f ON f.query_id = w.query_id AND f.pos = w.pos GROUP BY w.query_id"}


@query("q_transpositions", views=WORDS, sql="SELECT query_id, corrected FROM qc")
def q_transpositions(c):
    return se.correct_transpositions(batch(c), se.vocabulary(c.tracks)).select("query_id", "corrected")


_base = f"SELECT b.query_id, b.v AS q, b.corrected, t.track_id, {N('t.title')} AS t, {N('t.artist')} AS a, t.track_id IN (SELECT track_id FROM fp) AS analysed, t.preview_url IS NOT NULL AS playable, {o.identity('t.title', 't.artist')} AS ident FROM lq b CROSS JOIN tracks t"
LOCAL = {**WORDS, "lq": f"SELECT query_id, q AS v, corrected FROM (SELECT x.query_id, {N('x.query')} AS q, qc.corrected FROM ({QUERY_SQL}) x JOIN qc ON qc.query_id = x.query_id) UNION SELECT query_id, corrected, corrected FROM qc",
  "ls": f"SELECT query_id, track_id, any_value(ident) AS ident, any_value(analysed) AS analysed, any_value(corrected) AS corrected, max(relevance) AS score FROM ({relevance_sql(_base)}) GROUP BY query_id, track_id HAVING max(relevance) >= 24",
  "lu": "SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY query_id, ident ORDER BY round(score, 6) DESC, analysed DESC, track_id) = 1"}


@query("q_search_local", views=LOCAL, sql="""
SELECT query_id, track_id, round(score, 6) AS score, CAST(position AS BIGINT) AS position, total, round(best_score, 6) AS best_score, corrected FROM (SELECT *,
 row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, analysed DESC, track_id) AS position, count(*) OVER (PARTITION BY query_id) AS total, max(score) OVER (PARTITION BY query_id) AS best_score FROM lu) WHERE position <= 20""")
def q_search_local(c):
    """First page of the local relevance search for the whole query batch."""
    return se.search_local(c.tracks, c.fingerprints, batch(c)).select(
        "query_id", "track_id", r6("score"), F.col("position").cast("bigint").alias("position"), "total", r6("best_score"), "corrected")


BROWSE = {"browse": f"""SELECT * FROM (SELECT track_id, track_id IN (SELECT track_id FROM fp) AS analysed, {o.identity('title', 'artist')} AS ident FROM tracks
  WHERE contains(lower(coalesce(provider_genre, '')), 'rock') OR contains(lower(coalesce(provider_subgenre, '')), 'rock')
   OR track_id IN (SELECT track_id FROM fp WHERE contains(lower(texture), 'rock') OR contains(lower(acoustic_signature), 'rock')))
  QUALIFY row_number() OVER (PARTITION BY ident ORDER BY analysed DESC, track_id) = 1"""}


@query("q_search_browse", views=BROWSE, sql="""
SELECT track_id, CAST(1 AS DOUBLE) AS score, CAST(position AS BIGINT) AS position, total FROM (SELECT *, row_number() OVER (ORDER BY analysed DESC, track_id) AS position,
 count(*) OVER () AS total FROM browse) WHERE position BETWEEN 21 AND 40""")
def q_search_browse(c):
    """Second page of all recordings of a genre."""
    return se.search_browse(c.tracks, c.fingerprints, "Rock", number=2)


GENRE_LOCAL = {**LOCAL, "in_genre": BROWSE["browse"].split("QUALIFY")[0].replace("SELECT * FROM (", "SELECT track_id FROM (", 1),
  "gu": "SELECT * FROM ls WHERE track_id IN (SELECT track_id FROM in_genre) QUALIFY row_number() OVER (PARTITION BY query_id, ident ORDER BY round(score, 6) DESC, analysed DESC, track_id) = 1"}


@query("q_search_genre", views=GENRE_LOCAL, sql="""
SELECT query_id, track_id, round(score, 6) AS score, CAST(position AS BIGINT) AS position, total, corrected FROM (SELECT *,
 row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, analysed DESC, track_id) AS position, count(*) OVER (PARTITION BY query_id) AS total FROM gu) WHERE position <= 20""")
def q_search_genre(c):
    """First page of the relevance search inside one genre."""
    return se.search_local(c.tracks, c.fingerprints, batch(c), genre="Rock").select(
        "query_id", "track_id", r6("score"), F.col("position").cast("bigint").alias("position"), "total", "corrected")


_ms = f"""SELECT query_id, src, position, track_id, ident, q, {N('title')} AS t, {N('artist')} AS a, analysed, playable FROM ms_rows"""
MERGE = {"ms_rows": f"""SELECT r.id AS query_id, s.src, i.rank AS position, CASE s.src WHEN 0 THEN i.track_id ELSE 'ext-' || substring(i.track_id, 7) END AS track_id,
   CASE s.src WHEN 0 THEN b.title ELSE upper(b.title) END AS title, b.artist, {N('a.title')} AS q, s.src = 0 AND b.track_id IN (SELECT track_id FROM fp) AS analysed,
   s.src = 1 OR b.preview_url IS NOT NULL AS playable, {o.identity('b.title', 'b.artist')} AS ident
   FROM runs r JOIN items i ON i.run_id = r.id JOIN tracks a ON a.track_id = r.anchor_track_id JOIN tracks b ON b.track_id = i.track_id CROSS JOIN (SELECT unnest([0, 1]) AS src) s""",
  "ms_best": f"SELECT *, min((src, position)) OVER (PARTITION BY query_id, ident) AS place FROM ({_ms}) QUALIFY row_number() OVER (PARTITION BY query_id, ident ORDER BY analysed DESC, playable DESC, src, position) = 1"}


@query("q_merge_search", views=MERGE, sql=f"""
SELECT query_id, track_id, round(relevance, 6) + 0.0 AS relevance, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 6) DESC, place) AS rank
 FROM ({relevance_sql('SELECT * FROM ms_best')})) WHERE rank <= 20""")
def q_merge_search(c):
    """Each run read as a search: its items are local results, their store copies the provider results."""
    t = c.tracks.select("track_id", "title", "artist", "preview_url")
    fp = c.fingerprints.select("track_id", F.lit(True).alias("analysed"))
    runs = c.runs.select(F.col("id").alias("run_id"), F.col("id").alias("query_id"), F.col("anchor_track_id").alias("aid"))
    named = runs.join(t.select(F.col("track_id").alias("aid"), F.col("title").alias("query")), "aid")
    rows = c.items.join(named, "run_id").join(t, "track_id").join(fp, "track_id", "left").fillna(False, ["analysed"])
    local = rows.select("query_id", "query", F.col("rank").alias("position"), "track_id", "title", "artist", "analysed", "preview_url")
    external = local.withColumns({"track_id": F.concat(F.lit("ext-"), F.expr("substring(track_id, 7)")), "title": F.upper("title"),
                                  "analysed": F.lit(False), "preview_url": F.lit("https://store.test/x.m4a")})
    return se.merge_search(local, external).select("query_id", "track_id", r6("relevance"), F.col("rank").cast("bigint").alias("rank"))


@query("q_merge_providers", views={"mp": f"""SELECT r.id AS query_id, CASE i.rank % 3 WHEN 0 THEN 'GB' WHEN 1 THEN 'IN' ELSE 'US' END AS storefront, i.rank AS position, i.track_id,
  {o.identity('t.title', 't.artist')} AS ident FROM runs r JOIN items i ON i.run_id = r.id JOIN tracks t ON t.track_id = i.track_id"""}, sql="""
SELECT query_id, track_id, storefront, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE storefront WHEN 'IN' THEN 0 WHEN 'US' THEN 1 ELSE 2 END, position) AS BIGINT) AS rank FROM (
 SELECT * FROM mp QUALIFY row_number() OVER (PARTITION BY query_id, ident ORDER BY CASE storefront WHEN 'IN' THEN 0 WHEN 'US' THEN 1 ELSE 2 END, position) = 1) QUALIFY rank <= 25""")
def q_merge_providers(c):
    store = F.when(F.col("rank") % 3 == 0, "GB").when(F.col("rank") % 3 == 1, "IN").otherwise("US")
    rows = c.items.join(c.tracks.select("track_id", "title", "artist"), "track_id").select(
        F.col("run_id").alias("query_id"), store.alias("storefront"), F.col("rank").alias("position"), "track_id", "title", "artist")
    return se.merge_providers(rows, ["IN", "US", "GB"]).select("query_id", "track_id", "storefront", F.col("rank").cast("bigint").alias("rank"))


@query("q_track_view", sql="""
SELECT t.track_id, t.title, coalesce(t.source, 'Catalogue') AS source, f.acoustic_signature AS subgenre, round(f.bpm, 6) AS bpm,
 round(CASE WHEN f.track_id IS NOT NULL THEN least(1, greatest(0, (l.sentiment + 1) / 2)) END, 6) AS valence,
 f.key || ' ' || f.mode AS musical_key, CASE WHEN f.track_id IS NULL THEN 'pending' ELSE 'complete' END AS analysis_status,
 f.track_id IS NOT NULL AND coalesce(l.confidence, 0) > 0 AS lyrics_available, CASE WHEN f.track_id IS NULL THEN '' ELSE coalesce(array_to_string(l.themes, ','), '') END AS lyric_themes,
 CASE WHEN f.track_id IS NOT NULL THEN l.language END AS lyric_language FROM tracks t LEFT JOIN fp f ON f.track_id = t.track_id LEFT JOIN lyr l ON l.track_id = t.track_id""")
def q_track_view(c):
    v = se.track_view(c.tracks, c.fingerprints, c.lyric_features)
    return v.select("track_id", "title", "source", "subgenre", r6("bpm"), r6("valence"), "musical_key", "analysis_status", "lyrics_available",
                    F.array_join("lyric_themes", ",").alias("lyric_themes"), "lyric_language")


@query("q_facets", sql="""
SELECT DISTINCT 'genre' AS facet, texture AS value FROM fp UNION ALL SELECT DISTINCT 'subgenre', acoustic_signature FROM fp
UNION ALL SELECT DISTINCT 'genre_family', family FROM families UNION ALL SELECT DISTINCT 'taxonomy', style FROM families""")
def q_facets(c):
    return se.facets(c.fingerprints, tax.families())
