"""DuckDB twins of the building blocks, for checking the Spark queries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from murmur.functions.words import EDGE_RUNS, ENGLISH_STOP_WORDS, PUNCTUATION
from murmur.operators import sentiment as rules_of
from murmur.sources import fixtures
from murmur.specs import EntityPattern, Period

GAP = r"[\s\x0B\p{Z}]"

RATIOS = """ratios AS (
  SELECT (SELECT count(*) FROM events) // (SELECT count(*) FROM documents) AS per_post,
         (SELECT count(*) FROM events) // (8 * (SELECT max(conv_id) + 1 FROM conversations)) AS per_turn)"""

POSTS = f"""{RATIOS}, posts AS (
  SELECT d.doc_id AS post_id, d.source AS subreddit, d.text AS title,
         CAST(floor(e.value) AS BIGINT) AS score, d.n_chars % 200 AS num_comments, e.user_id AS author_id,
         CAST(floor(epoch(e.ts)) AS BIGINT) AS created_utc,
         CAST(year(e.ts) AS INTEGER) AS yyyy, CAST(month(e.ts) AS INTEGER) AS mm
  FROM documents d, ratios r, events e WHERE e.event_id = d.doc_id * r.per_post)"""

COMMENTS = f"""{RATIOS}, comments AS (
  SELECT c.conv_id * 8 + c.turn AS comment_id, concat('src', CAST(c.conv_id % 20 AS VARCHAR)) AS subreddit,
         c.text AS body, CAST(floor(e.value) AS BIGINT) AS score, e.user_id AS author_id,
         CAST(floor(epoch(e.ts)) AS BIGINT) AS created_utc,
         CAST(year(e.ts) AS INTEGER) AS yyyy, CAST(month(e.ts) AS INTEGER) AS mm
  FROM conversations c, ratios r, events e WHERE e.event_id = (c.conv_id * 8 + c.turn) * r.per_turn)"""


POSTS_BY_MONTH = f"""{POSTS}, moved AS (
  SELECT * REPLACE (created_utc + (post_id % 6) * 2592000 AS created_utc) FROM posts),
by_month AS (
  SELECT * REPLACE (CAST(year(TIMESTAMP '1970-01-01' + to_seconds(created_utc)) AS INTEGER) AS yyyy,
                    CAST(month(TIMESTAMP '1970-01-01' + to_seconds(created_utc)) AS INTEGER) AS mm) FROM moved)"""

#: Pairs (post_id, entity) by trying every piece, and every word, blank and word, of every text.
DICTIONARY_MENTIONS = r"""word_lists AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
singles AS (SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM word_lists) WHERE md5(word) < '2'),
pairs_of AS (SELECT DISTINCT p FROM (
    SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM word_lists) WHERE md5(p) < '02'),
dictionary AS (SELECT word AS entity, word AS term FROM singles UNION ALL SELECT split_part(p, ' ', 1), p FROM pairs_of),
piece_lists AS (SELECT post_id, regexp_extract_all(lower(title), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]') AS p FROM posts),
pieces AS (SELECT post_id, unnest(p) AS piece, unnest(p[2:]) AS second, unnest(p[3:]) AS third FROM piece_lists),
candidates AS (
  SELECT post_id, piece AS term FROM pieces WHERE piece IS NOT NULL
  UNION SELECT post_id, piece || ' ' || third FROM pieces WHERE second = ' ' AND third IS NOT NULL),
mentioned AS (SELECT DISTINCT post_id, entity FROM candidates JOIN dictionary USING (term))"""


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Iterable[str]) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def stamp(moment: datetime) -> str:
    return f"TIMESTAMP '{moment:%Y-%m-%d %H:%M:%S}'"


def mention(column: str, entity: EntityPattern) -> str:
    words = "|".join(entity.terms)
    return rf"regexp_matches({column}, '(?i)(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


def covers(column: str, period: Period) -> str:
    end = "<=" if period.end_inclusive else "<"
    return f"({column} >= {stamp(period.start)} AND {column} {end} {stamp(period.end)})"


def period_label(column: str) -> str:
    branches = " ".join(f"WHEN {covers(column, p)} THEN '{p.label}'" for p in fixtures.CALENDAR.periods)
    return f"CASE {branches} ELSE 'other' END"


def period_order(column: str = "event_period") -> str:
    branches = " ".join(f"WHEN '{label}' THEN {i}" for i, label in enumerate(fixtures.CALENDAR.labels))
    return f"CAST(CASE {column} {branches} END AS INTEGER)"


def event_name(labels: Mapping[str, str], column: str = "event_period") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


def tagged(source: str, column: str) -> str:
    """CTE ``tagged``: the source with time parts, period label and entity flags."""
    flags = ", ".join(f"{mention(column, e)} AS {e.flag}" for e in fixtures.ENTITIES)
    either = " OR ".join(e.flag for e in fixtures.ENTITIES)
    return f"""timed AS (
  SELECT *, TIMESTAMP '1970-01-01' + to_seconds(created_utc) AS created_dt FROM {source}),
flagged AS (
  SELECT *, CAST(hour(created_dt) AS INTEGER) AS hour_of_day,
         CAST(dayofweek(created_dt) + 1 AS INTEGER) AS day_of_week,
         CAST(month(created_dt) AS INTEGER) AS month_num, CAST(year(created_dt) AS INTEGER) AS year_num,
         {period_label('created_dt')} AS event_period, {flags}
  FROM timed),
tagged AS (SELECT *, {either} AS mentions_any FROM flagged)"""


TAGGED_POSTS = f"WITH {POSTS}, {tagged('posts', 'title')}"
TAGGED_COMMENTS = f"WITH {COMMENTS}, {tagged('comments', 'body')}"

SUMS = ", ".join(f"CAST(sum(CAST({e.flag} AS INTEGER)) AS BIGINT) AS {e.name}" for e in fixtures.ENTITIES)
ENGAGEMENT = "count(*) AS posts, avg(score) AS avg_score, avg(num_comments) AS avg_comments"

#: One row per (row, mentioned entity).
ENTITY_ROWS = "entity_rows AS (" + " UNION ALL ".join(
    f"SELECT *, '{e.name}' AS player FROM tagged WHERE {e.flag}" for e in fixtures.ENTITIES) + ")"


def scored(key: str, column: str) -> str:
    """CTE ``scored``: ``tagged`` with the sentiment of a text column."""
    r = fixtures.RULES
    boosters, dampeners, negations = listed(r.boosters), listed(r.dampeners), listed(r.negations)
    lexicon = ", ".join(f"({text(t)}, CAST({v} AS DOUBLE))" for t, v in fixtures.LEXICON.items())
    core = rf"[^\s\x0B\p{{Z}}{PUNCTUATION}]{{2,}}".replace("'", "''")
    runs = EDGE_RUNS.replace("'", "''")
    caps = "({0} = upper({0}) AND {0} <> lower({0}))"

    def phrase(*parts: str) -> str:
        return "concat_ws(' ', " + ", ".join(parts) + ")"

    def idiom(of: str) -> str:
        return f"CASE {of} " + " ".join(f"WHEN {text(k)} THEN {v}" for k, v in r.idioms.items()) + " END"

    phrases = [("word", "n1", "n2"), ("word", "n1"), ("b1", "word"), ("b2", "b1", "word"), ("b2", "b1"),
               ("b3", "b2", "b1"), ("b3", "b2")]
    replaced = ", ".join(idiom(phrase(*p)) for p in phrases)
    soft = listed([*r.dampeners, *r.boosters, *rules_of.DAMPENER_PAIRS])
    steps, previous = [], "v0"
    for d, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
        boost = f"""v + CASE WHEN p{d} IN {boosters} OR p{d} IN {dampeners} THEN CAST({damp} AS DOUBLE) * (
            CASE WHEN p{d} IN {boosters} THEN 0.293 ELSE -0.293 END * CASE WHEN v < 0 THEN -1.0 ELSE 1.0 END
            + CASE WHEN {caps.format(f'b{d}')} AND mixed THEN CASE WHEN v > 0 THEN 0.733 ELSE -0.733 END ELSE 0.0 END)
            ELSE 0.0 END"""
        never = {1: "", 2: f"WHEN p2 IS NOT NULL AND b2 = 'never' AND b1 IN ('so', 'this') THEN v * 1.5",
                 3: f"WHEN p3 IS NOT NULL AND ((b3 = 'never' AND b2 IN ('so', 'this')) OR b1 IN ('so', 'this')) THEN v * 1.25"}[d]
        steps.append(f"boost{d} AS (SELECT * REPLACE ({boost} AS v) FROM {previous})")
        steps.append(f"""neg{d} AS (SELECT * REPLACE (CASE {never}
            WHEN p{d} IS NOT NULL AND (p{d} IN {negations} OR contains(p{d}, 'n''t')) THEN v * -0.74 ELSE v END AS v)
            FROM boost{d})""")
        previous = f"neg{d}"
    return rf"""lexicon(token, valence) AS (VALUES {lexicon}),
split AS (
  SELECT {key} AS k, {column} AS t,
         list_transform(
           list_filter(string_split_regex({column}, '{GAP}+'), lambda x: length(x) > 1),
           lambda x: regexp_replace(x, '^(?:(?:{runs})({core})|({core})(?:{runs}))$', '\1\2')) AS words
  FROM tagged),
whole AS (
  SELECT k, words, length(t) - length(replace(t, '!', '')) AS bangs, length(t) - length(replace(t, '?', '')) AS asks,
         len(list_filter(words, lambda x: {caps.format('x')})) AS shouting,
         list_position(list_transform(words, lambda x: lower(x)), '{r.contrast}') - 1 AS turn
  FROM split),
token AS (
  SELECT k, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos, turn,
         shouting > 0 AND shouting < len(words) AS mixed
  FROM whole),
near AS (
  SELECT *, lag(word, 1) OVER w AS b1, lag(word, 2) OVER w AS b2, lag(word, 3) OVER w AS b3,
         lead(word, 1) OVER w AS n1, lead(word, 2) OVER w AS n2
  FROM token WINDOW w AS (PARTITION BY k ORDER BY pos)),
v0 AS (
  SELECT n.*,
         CASE WHEN lower(b1) NOT IN (SELECT token FROM lexicon) THEN lower(b1) END AS p1,
         CASE WHEN lower(b2) NOT IN (SELECT token FROM lexicon) THEN lower(b2) END AS p2,
         CASE WHEN lower(b3) NOT IN (SELECT token FROM lexicon) THEN lower(b3) END AS p3,
         l.valence + CASE WHEN {caps.format('word')} AND mixed
           THEN CASE WHEN l.valence > 0 THEN 0.733 ELSE -0.733 END ELSE 0.0 END AS v
  FROM near n JOIN lexicon l ON l.token = lower(n.word)
  WHERE NOT (lower(word) IN {boosters} OR lower(word) IN {dampeners}
             OR (lower(word) = 'kind' AND coalesce(lower(n1) = 'of', false)))),
{", ".join(steps)},
idiomatic AS (
  SELECT * REPLACE (CASE WHEN p3 IS NULL THEN v ELSE coalesce({replaced}, v)
    - CASE WHEN {phrase('b3', 'b2')} IN {soft} OR {phrase('b2', 'b1')} IN {soft} THEN 0.293 ELSE 0.0 END END AS v)
  FROM {previous}),
weighed AS (
  SELECT k, CASE WHEN p1 = 'least' AND (b2 IS NULL OR lower(b2) NOT IN ('at', 'very')) THEN v * -0.74 ELSE v END
    * CASE WHEN turn >= 0 AND pos < turn THEN 0.5 WHEN turn >= 0 AND pos > turn THEN 1.5 ELSE 1.0 END AS v
  FROM idiomatic),
sums AS (SELECT k, sum(v) AS s FROM weighed GROUP BY k),
summed AS (
  SELECT w.k, coalesce(s, 0.0) + sign(coalesce(s, 0.0)) * coalesce(least(bangs, 4) * 0.292
    + CASE WHEN asks <= 1 THEN 0.0 WHEN asks <= 3 THEN asks * 0.18 ELSE 0.96 END, 0.0) AS x
  FROM whole w LEFT JOIN sums USING (k)),
scored AS (
  SELECT tagged.*, round(CAST(x AS DOUBLE) / sqrt(CAST(x AS DOUBLE) * x + 15.0), 4) AS sentiment
  FROM tagged JOIN summed ON summed.k = tagged.{key})"""


SCORED_POSTS = f"{TAGGED_POSTS}, {scored('post_id', 'title')}"
SCORED_COMMENTS = f"{TAGGED_COMMENTS}, {scored('comment_id', 'body')}"


def terms(groups: Mapping[str, str]) -> str:
    """CTEs up to ``tfidf``: weights of the 500 most frequent terms in each group of posts."""
    members = " UNION ALL ".join(f"SELECT '{g}' AS grp, k, term FROM term_rows WHERE {c}" for g, c in groups.items())
    return rf"""lists AS (
  SELECT *, post_id AS k, list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]{{2,}}'),
    lambda x: x NOT IN {listed(ENGLISH_STOP_WORDS)}) AS words FROM tagged),
placed AS (
  SELECT k, event_period, {", ".join(e.flag for e in fixtures.ENTITIES)},
         unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM lists),
pairs AS (SELECT *, lead(word) OVER (PARTITION BY k ORDER BY pos) AS following FROM placed),
term_rows AS (
  SELECT * EXCLUDE (word, following, pos), word AS term FROM pairs
  UNION ALL
  SELECT * EXCLUDE (word, following, pos), word || ' ' || following FROM pairs WHERE following IS NOT NULL),
members AS ({members}),
counts AS (SELECT grp, term, count(*) AS tf FROM members GROUP BY grp, term),
vocabulary AS (
  SELECT term, sum(tf) AS total, count(*) AS df FROM counts GROUP BY term ORDER BY total DESC, term LIMIT 500),
weights AS (
  SELECT grp, term, tf, df, tf * (ln((1.0 + {len(groups)}) / (1 + df)) + 1) AS w FROM counts JOIN vocabulary USING (term)),
tfidf AS (SELECT grp AS "group", term, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY grp)) AS tfidf FROM weights)"""


PERIOD_GROUPS = {label: f"event_period = '{label}'" for label in fixtures.CALENDAR.labels}
ENTITY_GROUPS = {e.name: e.flag for e in fixtures.ENTITIES}
TOP_KEYWORDS = """SELECT "group", CAST(position AS INTEGER) AS position, term, round(tfidf, 4) AS tfidf FROM (
  SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(tfidf, 9) DESC, term) AS position FROM tfidf)
WHERE position <= 15"""

TOKENS = rf"""tokens AS (
  SELECT *, list_filter(string_split_regex(lower(body), '{GAP}+'),
    lambda x: x <> '' AND x NOT IN {listed([*ENGLISH_STOP_WORDS, *fixtures.STOP_WORDS])}) AS tokens
  FROM comments WHERE body IS NOT NULL),
token_rows AS (SELECT comment_id, unnest(tokens) AS term FROM tokens),
token_counts AS (
  SELECT term, count(*) AS tf, count(DISTINCT comment_id) AS df FROM token_rows GROUP BY term)"""

FEATURES = f"""features AS (
  SELECT post_id, hour_of_day, day_of_week, month_num,
         {", ".join(f"CAST({e.flag} AS INTEGER) AS {e.flag}" for e in fixtures.ENTITIES)},
         subreddit, event_period, score, num_comments
  FROM tagged
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in ["hour_of_day", *(e.flag for e in fixtures.ENTITIES), "subreddit", "event_period", "score", "num_comments"])}),
labelled AS (
  SELECT *, CAST(score >= (SELECT quantile_cont(score, 0.75) FROM features) AS INTEGER) AS high_engagement,
         substr(md5(CAST(post_id AS VARCHAR)), 1, 2) < 'cd' AS in_training
  FROM features),
forum_index AS (
  SELECT subreddit, row_number() OVER (ORDER BY count(*) DESC, subreddit) - 1 AS i
  FROM labelled WHERE in_training GROUP BY subreddit),
period_index AS (
  SELECT event_period, row_number() OVER (ORDER BY count(*) DESC, event_period) - 1 AS i
  FROM labelled WHERE in_training GROUP BY event_period)"""

PROFILE = f"""profile AS (
  SELECT subreddit, count(*) AS post_count, avg(score) AS avg_score, avg(num_comments) AS avg_comments,
         {", ".join(f"CAST(sum(CAST({e.flag} AS INTEGER)) AS BIGINT) AS {e.name}_mentions" for e in fixtures.ENTITIES)},
         avg(hour_of_day) AS avg_post_hour
  FROM tagged GROUP BY subreddit HAVING count(*) >= 50)"""
