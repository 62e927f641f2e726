"""Catalogue search: filters, fuzzy search, relevance, merging, facets.

Batch searches take a table of queries.  Candidates always come from equi-joins on
pieces of text (an inverted index), never from pairing every query with every track;
the exact score is computed on the candidates only, and the bounds below prove that
no row that could qualify is left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tonearm.functions import text as tx
from tonearm.functions.taxonomy import families as default_families
from tonearm.limits import MAX_PAGE, MAX_SEARCH, within
from tonearm.operators.catalogue import first_by, ranked
from tonearm.session import materialize

# fixed values: fuzzy search weights and thresholds, local search threshold, letters of a query that the search box takes
SIMILARITY_FLOOR, WORD_FLOOR, RELEVANCE_FLOOR = 0.16, 0.28, 24.0
QUERY_LETTERS = 200
PAGE = 20


def search_terms(tracks: DataFrame, query: str) -> DataFrame:
    """Every blank-separated term occurs in title, artist or album (case-insensitive)."""
    haystack = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "artist", "album")]))
    keep = F.lit(True)
    for term in query.split():
        keep = keep & F.contains(haystack, F.lit(term.lower()))
    return tracks.filter(keep)


def filter_category(tracks: DataFrame, fingerprints: DataFrame, category: str, fields: str = "signature") -> DataFrame:
    """signature: the acoustic signature contains the text; any: one of four genre fields does."""
    wanted = F.lit(category.strip().lower())
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), wanted)
    if fields == "signature":
        hits = fingerprints.filter(has("acoustic_signature")).select("track_id")
        return tracks.join(hits, "track_id", "left_semi")
    # two narrow sources instead of one OR over a join
    by_track = tracks.filter(has("provider_genre") | has("provider_subgenre")).select("track_id")
    by_sound = fingerprints.filter(has("profile.texture") | has("acoustic_signature")).select("track_id")
    return tracks.join(by_track.union(by_sound).distinct(), "track_id", "left_semi")


def page(df: DataFrame, number: int = 1, size: int = PAGE, order=("title", "track_id")) -> DataFrame:
    """One page of distinct recordings with the total beside each row."""
    size = within(size, MAX_PAGE, "size")
    keyed = df.withColumn("_edition", tx.identity("title", "artist", "exact"))
    once = first_by(keyed, ["_edition"], ["track_id"]).drop("_edition")
    total = once.agg(F.count("*").alias("total"))
    rows = once.orderBy(*order).offset((within(number, 1 << 31, "number") - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total))  # a single row


def _texts(tracks: DataFrame) -> DataFrame:
    return tracks.select("track_id", tx.normalize_search("title").alias("title_n"), tx.search_text("title", "artist").alias("text"))


def _pieces(value: Column, sizes: list[int]) -> Column:
    """Distinct substrings of the words of ``value`` with the given lengths."""
    def cut(word, n):
        return F.when(F.length(word) >= n, F.transform(
            F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    def all_of(n):
        return F.flatten(F.transform(tx.tokens(value), lambda w: cut(w, n)))

    parts = [all_of(n) for n in sizes]
    return F.array_distinct(F.concat(*parts))


def contains_candidates(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, track_id) pairs that may have the query inside the text.

    Whatever contains the query contains the first three letters of its longest word.
    """
    longest = F.element_at(F.sort_array(F.transform(tx.tokens("q"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), 1)["w"]
    probes = queries.filter(F.col("q") != "").select("query_id", F.substring(longest, 1, 3).alias("piece"))
    index = texts.select("track_id", F.explode(_pieces(F.col("text"), [1, 2, 3])).alias("piece"))
    return index.join(probes, "piece").select("query_id", "track_id")


class TextIndex(NamedTuple):
    """A stored inverted index of the distinct texts of a catalogue (see ``text_index``)."""

    texts: DataFrame  # text_id, title_n, text, grams (numbers, the rarest first)
    grams: DataFrame  # gram, number (0 is the rarest)
    members: DataFrame  # text_id, track_id


def text_index(tracks: DataFrame) -> TextIndex:
    """Trigrams of the distinct texts, numbered from the rarest to the most frequent.

    Many tracks can share a text; it is indexed, matched and scored once.
    """
    named = _texts(tracks)
    once = materialize(named.select("title_n", "text").distinct().withColumn("text_id", F.monotonically_increasing_id()))
    held = once.select("text_id", F.explode(tx.trigrams("text")).alias("gram"))
    counted = held.groupBy("gram").agg(F.count("*").alias("df"))
    grams = materialize(ranked(counted, F.col("df"), F.col("gram"), name="number").select("gram", F.col("number").cast("int").alias("number")))
    numbers = held.join(grams, "gram").groupBy("text_id").agg(F.array_sort(F.collect_list("number")).alias("grams"))  # the trigrams of one text
    texts = materialize(once.join(numbers, "text_id", "left").withColumn("grams", F.coalesce("grams", F.array().cast("array<int>"))))
    members = materialize(named.join(once, ["title_n", "text"]).select("text_id", "track_id"))
    return TextIndex(texts, grams, members)


def _needed(n_query: Column, n_text: Column) -> Column:
    """Shared trigrams without which neither similarity reaches its floor."""
    ratio = SIMILARITY_FLOOR / (1 + SIMILARITY_FLOOR)  # shared / united >= floor
    return F.greatest(F.lit(1), F.least(F.ceil(n_query * WORD_FLOOR - 1e-9), F.ceil((n_query + n_text) * ratio - 1e-9)))


def prefix_pairs(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, text_id) pairs that can share enough trigrams.

    Sets in one order of rarity that share s members share one among the first
    n - s + 1 of each, so only these prefixes meet; the most frequent trigrams are in
    hardly any prefix.  What can still be shared after the last match in the prefixes
    is bounded by what is left of either set.
    """
    n_query, n_text = F.col("n_query"), F.size("grams")
    # unknown trigrams are rarer than all known ones and match nothing
    probes = asked.select("query_id", "n_query", F.posexplode("q_grams").alias("place", "number"), (n_query - F.size("q_grams")).alias("unknown"))
    probes = probes.withColumn("place", F.col("place") + F.col("unknown") + 1).filter(
        F.col("place") <= n_query - F.ceil(n_query * SIMILARITY_FLOOR - 1e-9) + 1)
    postings = texts.select("text_id", n_text.alias("n_text"), F.posexplode("grams").alias("at", "number")).withColumn("at", F.col("at") + 1)
    need = _needed(n_query, F.col("n_text"))
    met = probes.join(postings, "number").filter((F.col("place") <= n_query - need + 1) & (F.col("at") <= F.col("n_text") - need + 1))
    counted = met.groupBy("query_id", "text_id", "n_query", "n_text").agg(
        F.count("*").alias("shared"), F.max("place").alias("place"), F.max("at").alias("at"))
    left = F.least(n_query - F.col("place"), F.col("n_text") - F.col("at"))
    return counted.filter(F.col("shared") + left >= need).select("query_id", "text_id")


def search_fuzzy(tracks: DataFrame, queries: DataFrame, limit: int = 80, index: TextIndex | None = None) -> DataFrame:
    """Trigram search of a query batch: (query_id, track_id, similarity, word_similarity, score, rank).

    queries(query_id, query).  A row qualifies when the text contains the query, or the
    trigram similarity is >= .16, or the word similarity is >= .28.  ``index`` is a stored
    ``text_index`` of the tracks.  Texts and arrays are fetched for pairs that pass the
    prefix, length and position filters; the word similarity is computed only where a bound
    on the score reaches what ``limit`` rows of the query have for certain.
    """
    limit = within(limit, MAX_SEARCH, "limit")
    index = index or text_index(tracks)
    asked = queries.select("query_id", tx.normalize_search("query").alias("q")).filter(F.col("q") != "")
    known = asked.select("query_id", F.explode(tx.trigrams("q")).alias("gram")).join(index.grams, "gram", "left").groupBy("query_id").agg(
        F.count("*").alias("n_query"), F.array_sort(F.collect_list("number")).alias("q_grams"))  # the trigrams of one query
    asked = materialize(asked.join(known, "query_id"))

    inside = contains_candidates(asked, index.texts.select(F.col("text_id").alias("track_id"), "text"))
    pairs = prefix_pairs(asked, index.texts).union(inside).distinct()
    joined = pairs.join(asked, "query_id").join(index.texts, "text_id")
    joined = joined.withColumn("shared", F.size(F.array_intersect("grams", "q_grams")))
    similarity = F.col("shared") / (F.size("grams") + F.col("n_query") - F.col("shared"))
    joined = joined.withColumns({"similarity": similarity, "inside": F.contains("text", "q"), "bound": F.col("shared") / F.col("n_query")})
    # word similarity never exceeds the share of query trigrams found
    sure = F.col("inside") | (F.col("similarity") >= SIMILARITY_FLOOR)
    bonus = lambda cond, points: F.when(cond, F.lit(points)).otherwise(F.lit(0.0))
    fixed = (bonus(F.col("title_n") == F.col("q"), 10.0) + bonus(F.col("text") == F.col("q"), 8.0)
             + bonus(F.startswith("title_n", "q"), 4.0) + bonus(F.col("inside"), 2.0) + 3.5 * F.col("similarity"))
    found = materialize(joined.filter(sure | (F.col("bound") >= WORD_FLOOR)).select(
        "query_id", "text_id", "similarity", "inside", sure.alias("sure"), fixed.alias("fixed"), (fixed + 2.5 * F.col("bound")).alias("most")))

    # the whole text is a run, so a sure row has at least its similarity as word similarity
    least = F.col("fixed") + 2.5 * F.col("similarity")
    order = W.partitionBy("query_id").orderBy(F.desc("least"), "text_id")
    best = found.filter("sure").select("query_id", "text_id", least.alias("least")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    cut = best.filter(F.col("n") == limit).select("query_id", F.col("least").alias("cut"))
    open_ = found.join(cut, "query_id", "left").filter(F.col("cut").isNull() | (F.col("most") >= F.col("cut") - 2e-6))
    wanted = asked.select("query_id", tx.trigrams("q").alias("q_run"))
    runs = index.texts.select("text_id", tx.ordered_trigrams("text").alias("run"))
    scored = open_.join(wanted, "query_id").join(runs, "text_id").withColumn("word_similarity", tx.word_similarity("q_run", "run"))
    scored = scored.filter(F.col("sure") | (F.col("word_similarity") >= WORD_FLOOR))

    # of the tracks of one text the first are enough
    first = W.partitionBy("text_id").orderBy("track_id")
    members = index.members.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= limit).drop("n")
    rows = scored.join(members, "text_id").select("query_id", "track_id", "similarity", "word_similarity",
                                                  (F.col("fixed") + 2.5 * F.col("word_similarity")).alias("score"))
    place = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "track_id")
    return rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit)


def vocabulary(tracks: DataFrame) -> DataFrame:
    """Distinct words of all titles and artists."""
    words = F.explode(tx.tokens(tx.normalize_search_folded(F.concat_ws(" ", "title", "artist"))))
    return tracks.select(words.alias("word")).distinct()


def correct_transpositions(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Replace unknown words of four or more letters when exactly one adjacent swap is known.

    queries(query_id, query) -> (query_id, query, corrected).
    """
    tokens = queries.select("query_id", F.posexplode(F.split(tx.normalize_search_folded("query"), " ")).alias("pos", "word"))
    known = words.select(F.col("word").alias("known"))
    marked = tokens.join(known, F.col("word") == F.col("known"), "left")
    unknown = marked.filter(F.col("known").isNull() & (F.length("word") >= 4)).select("query_id", "pos", "word")
    swap = lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.lit(1)),
                              F.substring("word", i, F.lit(1)), F.substring("word", i + 2, F.length("word")))
    swaps = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), swap))
    fixes = (unknown.select("query_id", "pos", F.explode(swaps).alias("known")).join(known, "known")
             .groupBy("query_id", "pos").agg(F.min("known").alias("fix"), F.count("*").alias("n")).filter("n = 1"))
    fixed = marked.join(fixes.select("query_id", "pos", "fix"), ["query_id", "pos"], "left")
    words_back = fixed.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("pos", F.coalesce("fix", "word").alias("w")))).alias("ws"))  # the words of one query
    return queries.join(words_back, "query_id", "left").withColumn(
        "corrected", F.array_join(F.transform("ws", lambda x: x["w"]), " ")).drop("ws")


def fuzzy_words(query_words: DataFrame, words: DataFrame) -> DataFrame:
    """(q_word, word) pairs that match exactly or by edit similarity.

    A word within d edits keeps one of d+1 consecutive pieces of the query word unchanged,
    so the pieces are joined and only those pairs are measured.
    """
    q = query_words.select(F.col("word").alias("q_word")).distinct()
    n = F.length("q_word")
    # edits allowed: at most 28 % of the longer word, and the longer word has at most n/.72 letters
    d = F.floor(n * 0.28 / 0.72 + 1e-9).cast("int")
    parts = F.transform(F.sequence(F.lit(0), d), lambda i: F.substring(
        F.col("q_word"), (F.floor(i * n / (d + 1)) + 1).cast("int"),
        (F.floor((i + 1) * n / (d + 1)) - F.floor(i * n / (d + 1))).cast("int")))
    long_q = q.filter(n >= 4).select("q_word", F.explode(F.array_distinct(parts)).alias("piece"))
    sizes = [2, 3]  # piece lengths that occur for words of four letters and more
    index = words.filter(F.length("word") >= 4).select("word", F.explode(_pieces(F.col("word"), sizes)).alias("piece"))
    near = (index.join(long_q, "piece").select("q_word", "word").distinct()
            .filter(tx.token_match(F.col("q_word"), F.col("word"))))
    same = q.join(words, F.col("q_word") == F.col("word"), "left_semi").select("q_word", F.col("q_word").alias("word"))
    return near.union(same).distinct()


def search_candidates(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, track_id) pairs whose relevance can reach the local threshold.

    Without a containment bonus the score is at most 74 c + 2.5 for a token coverage c, so
    24 needs c >= .29; containment either way comes from piece and substring joins.
    texts(track_id, title_n, text); queries(query_id, q).
    """
    tokens = queries.select("query_id", F.explode(tx.tokens("q")).alias("q_word"))
    sizes = tokens.groupBy("query_id").agg(F.count("*").alias("n_tokens"))
    counts = tokens.groupBy("query_id", "q_word").agg(F.count("*").alias("times"))
    index = texts.select("track_id", F.explode(F.array_distinct(tx.tokens("text"))).alias("word"))
    matches = fuzzy_words(tokens.select(F.col("q_word").alias("word")), index.select("word").distinct())
    hit = (counts.join(matches, "q_word").join(index, "word").select("query_id", "track_id", "q_word", "times").distinct()
           .groupBy("query_id", "track_id").agg(F.sum("times").alias("hits")))
    covered = hit.join(sizes, "query_id").filter(F.col("hits") >= 0.29 * F.col("n_tokens")).select("query_id", "track_id")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("q") - 2)), lambda i: F.transform(
        F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("q") - i + 1)), lambda n: F.substring(F.col("q"), i, n))))
    inner = queries.select("query_id", F.explode(F.array_distinct(spans)).alias("title_n"))  # a query has at most 200 letters
    titled = texts.filter(F.length("title_n") >= 3).join(inner, "title_n").select("query_id", "track_id")
    return covered.union(contains_candidates(queries, texts)).union(titled).distinct()


def search_local(tracks: DataFrame, fingerprints: DataFrame, queries: DataFrame, number: int = 1,
                 size: int = PAGE, genre: str | None = None, query_letters: int = QUERY_LETTERS) -> DataFrame:
    """Relevance search of a query batch with typo correction, one recording once, paged.

    queries(query_id, query) -> query_id, track_id, score, position, total, best_score, corrected.
    ``genre``: only tracks with this text in a genre or sound field; spelling is corrected by all tracks.
    Empty queries return nothing here: ``search_browse`` lists everything.  Of a longer query the first
    ``query_letters`` letters are searched, as by definition of the search box.
    """
    cut = queries.select("query_id", F.substring(F.trim("query"), 1, query_letters).alias("query"))
    fixed = correct_transpositions(cut, vocabulary(tracks)).select(
        "query_id", tx.normalize_search_folded("query").alias("q"), "corrected").filter(F.col("q") != "")
    chosen = filter_category(tracks, fingerprints, genre, "any") if genre else tracks
    indexed = fingerprints.select(F.col("track_id"), F.lit(True).alias("indexed"))
    texts = chosen.filter(F.col("track_id").isNotNull()).select(
        "track_id", (F.coalesce("preview_url", F.lit("")) != "").alias("playable"), tx.normalize_search_folded("title").alias("title_n"),
        tx.normalize_search_folded("artist").alias("artist_n"), tx.recording_identity("title", "artist").alias("identity"))
    texts = texts.join(indexed, "track_id", "left").fillna(False, ["indexed"])
    # tracks that agree in these score alike and are one recording: only the first of them can be listed
    texts = texts.groupBy("title_n", "artist_n", "identity", "indexed", "playable").agg(F.min("track_id").alias("track_id"))
    texts = materialize(texts.withColumns({"text": F.trim(F.concat_ws(" ", "title_n", "artist_n")), "text_id": F.monotonically_increasing_id()}))
    # the two spellings are separate queries while candidates are looked up
    fixed = materialize(fixed)
    spelled = lambda n, c: fixed.select(F.concat_ws("\u0001", "query_id", F.lit(n)).alias("query_id"), F.col(c).alias("q"))
    both = spelled("0", "q").union(spelled("1", "corrected").join(
        fixed.filter("q <> corrected").select(F.concat_ws("\u0001", "query_id", F.lit("1")).alias("query_id")), "query_id", "left_semi"))
    # reversed order (artist first) can contain the query too; its words are the same
    found = search_candidates(both, texts.select(F.col("text_id").alias("track_id"), "title_n", "text"))
    pairs = found.select(F.substring_index("query_id", "\u0001", 1).alias("query_id"), F.col("track_id").alias("text_id")).distinct()
    rows = pairs.join(fixed, "query_id").join(texts, "text_id")
    add = lambda df, q, out: tx.add_relevance(df, q, "title_n", "artist_n", "indexed", F.col("playable"), out)
    plain = add(rows, "q", "score")
    other = add(rows.filter(F.col("q") != F.col("corrected")), "corrected", "score")
    scored = plain.unionByName(other).filter(F.col("score") >= RELEVANCE_FLOOR)
    best = [F.desc(F.round("score", 6)), F.desc("indexed"), F.asc("track_id")]
    once = scored.withColumn("n", F.row_number().over(W.partitionBy("query_id", "identity").orderBy(*best))).filter("n = 1")
    once = materialize(once.select("query_id", "track_id", "score", "indexed", "corrected"))
    totals = once.groupBy("query_id").agg(F.count("*").alias("total"), F.max("score").alias("best_score"))
    first = (within(number, 1 << 31, "number") - 1) * size
    ranked = once.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(*best))).filter(F.col("position") <= first + size)
    return ranked.filter(F.col("position") > first).join(totals, "query_id").select(
        "query_id", "track_id", "score", "position", "total", "best_score", "corrected")


def search_browse(tracks: DataFrame, fingerprints: DataFrame, genre: str | None = None, number: int = 1, size: int = PAGE) -> DataFrame:
    """The search without a query: every recording scores 1, analysed ones first.

    -> track_id, score, position, total of one page.
    """
    chosen = filter_category(tracks, fingerprints, genre, "any") if genre else tracks
    indexed = fingerprints.select("track_id", F.lit(True).alias("indexed"))
    rows = chosen.select("track_id", tx.recording_identity("title", "artist").alias("identity")).join(indexed, "track_id", "left")
    rows = rows.withColumn("place", F.struct(F.col("indexed").isNull().alias("pending"), "track_id"))
    once = rows.groupBy("identity").agg(F.min("place").alias("place"))
    first = (within(number, 1 << 31, "number") - 1) * within(size, MAX_PAGE, "size")
    page_rows = once.orderBy("place").offset(first).limit(size)
    position = F.row_number().over(W.orderBy("place")) + first  # over the rows of one page
    return (page_rows.select(F.col("place.track_id").alias("track_id"), F.lit(1.0).alias("score"), position.cast("bigint").alias("position"))
            .crossJoin(F.broadcast(once.agg(F.count("*").alias("total")))))  # a single row


def merge_search(local: DataFrame, external: DataFrame, size: int = PAGE) -> DataFrame:
    """Local and provider results of each query, one row per recording, ranked by relevance.

    Both: query_id, query, position, track_id, title, artist, analysed, preview_url.
    """
    rows = local.withColumn("source", F.lit(0)).unionByName(external.withColumn("source", F.lit(1)))
    rows = rows.withColumns({"identity": tx.recording_identity("title", "artist"),
                             "place": F.struct("source", "position"),
                             "playable": F.coalesce("preview_url", F.lit("")) != ""})
    rows = rows.withColumn("worse", F.struct(~F.col("analysed"), ~F.col("playable"), "source", "position"))
    packed = rows.groupBy("query_id", "identity").agg(
        F.min_by(F.struct("query", "track_id", "title", "artist", "analysed", "playable"), F.col("worse")).alias("r"),
        F.min("place").alias("place")).select("query_id", "place", "r.*")
    n = lambda c: tx.normalize_search_folded(c)
    scored = tx.add_relevance(packed.withColumns({"q": n("query"), "t": n("title"), "a": n("artist")}),
                              "q", "t", "a", "analysed", "playable")
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("relevance", 6)), "place")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select(
        "query_id", "track_id", "title", "artist", "relevance", "rank")


def merge_providers(results: DataFrame, priority: list[str], limit: int = 25) -> DataFrame:
    """First row per (query, recording) by storefront priority and position, at most ``limit`` per query.

    results(query_id, storefront, position, track_id, title, artist).
    """
    order = F.create_map(*[F.lit(x) for i, s in enumerate(priority) for x in (s, i)])
    keyed = results.withColumns({"priority": F.coalesce(F.element_at(order, F.col("storefront")), F.lit(len(priority))),
                                 "identity": tx.recording_identity("title", "artist")})
    once = first_by(keyed, ["query_id", "identity"], ["priority", "position"])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("priority", "position"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= limit)


def track_view(tracks: DataFrame, fingerprints: DataFrame, lyrics: DataFrame) -> DataFrame:
    """Public projection of a track with its acoustic and lyric summary.

    A point lookup is a filter on track_id; it reaches every scan.
    """
    f = fingerprints.select("track_id", "acoustic_signature", *[F.col(f"profile.{n}").alias(n) for n in (
        "bpm", "energy", "aggression", "brightness", "dynamic_range", "danceability", "onset_density", "percussive_ratio",
        "harmonic_ratio", "key", "mode", "texture")])
    l = lyrics.select("track_id", "sentiment", "confidence", "themes", "language")
    joined = tracks.join(f, "track_id", "left").join(l, "track_id", "left")
    analysed = F.col("acoustic_signature").isNotNull()
    from tonearm.functions.vectors import clip
    return joined.withColumns({
        "valence": F.when(F.col("sentiment").isNotNull() & analysed, clip((F.col("sentiment") + 1) / 2)),
        "timbre": F.col("texture"), "subgenre": F.col("acoustic_signature"),
        "musical_key": F.when(F.col("key").isNotNull(), F.trim(F.concat_ws(" ", "key", "mode"))),
        "source": F.coalesce("source", F.lit("Catalogue")),
        "analysis_status": F.when(analysed, "complete").otherwise("pending"),
        "lyrics_available": analysed & (F.coalesce("confidence", F.lit(0.0)) > 0),
        "lyric_themes": F.when(analysed, F.coalesce("themes", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
        "lyric_language": F.when(analysed, F.col("language"))}).drop("texture", "themes", "language", "sentiment", "confidence")


def facets(fingerprints: DataFrame, families=None) -> DataFrame:
    """Menu values as (facet, value) rows; reads two narrow columns of the fingerprints."""
    spark = fingerprints.sparkSession
    pairs = families or default_families()
    narrow = fingerprints.select(F.col("profile.texture").alias("texture"), "acoustic_signature")
    pick = lambda facet, c: narrow.select(F.lit(facet).alias("facet"), F.col(c).alias("value")).filter("value <> ''").distinct()
    rows = [("genre_family", f) for f in sorted({f for _, f in pairs})] + [("taxonomy", s) for s in sorted({s for s, _ in pairs})]
    return pick("genre", "texture").union(pick("subgenre", "acoustic_signature")).union(
        spark.createDataFrame(rows, "facet string, value string"))
