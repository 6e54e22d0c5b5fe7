"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import compacted

    return compacted(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, learn_profiles

    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_profiles(docs))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import find_repeats

    return find_repeats(table(spark, sf_dir, "documents"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge, train

    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotations import reply_ordered

    return reply_ordered(table(spark, sf_dir, "conversations"))


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking where there is something to link: the conversations with each message made a reply that quotes earlier ones."""
    from .quotations import reply_ordered, with_quotes

    return reply_ordered(with_quotes(table(spark, sf_dir, "conversations")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similar_components

    return similar_components(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range join where there are links to find: the embeddings with noisy copies of each."""
    from .embedding_dedup import near_duplicates, with_noisy_copies

    return near_duplicates(with_noisy_copies(table(spark, sf_dir, "embeddings")))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_language_id, op3_substring_dedup, op4_line_quality, op5_quotation_linking, op6_toxicity, op7_jaccard_join, op8_best_fit_packing, op9_embedding_dedup, op10_source_mixing,
        op11_token_counts, op12_token_alignment, op13_collocations, quoted_replies, near_vectors,
    )
}

SQL: dict[str, str] = {}
SQL["op1_sharding"] = """
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         CASE WHEN doc_id IS NULL THEN -1000000000000 - ('0x' || substr(md5(coalesce(text, '')), 1, 4))::BIGINT ELSE (doc_id - ((doc_id % 64) + 64) % 64) // 64 END AS arrival
  FROM documents),
span AS (SELECT min(arrival) AS lo, max(arrival) + 1 - min(arrival) AS n FROM docs WHERE doc_id IS NOT NULL),
arrivals AS (
  SELECT arrival, sum(n_bytes)::BIGINT AS b, CASE WHEN arrival <= -1000000000000 THEN 0 ELSE (arrival - any_value(lo)) * 3 // any_value(n) END AS c FROM docs, span GROUP BY arrival),
state(i, c, arrival, b, shard) AS (
  SELECT 0, 0::BIGINT, arrival, b, arrival FROM arrivals WHERE c = 0
  UNION ALL
  (WITH sizes AS (SELECT shard, sum(b)::BIGINT AS bytes FROM state GROUP BY shard),
   tiers AS (SELECT *, CASE WHEN bytes < 65536 THEN 0 ELSE length(bin(bytes // 65536)) END AS tier FROM sizes WHERE bytes < 33554432),
   runs AS (SELECT *, (coalesce(sum(bytes) OVER (PARTITION BY tier ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) // 67108864 AS run FROM tiers),
   merged AS (SELECT shard, min(shard) OVER (PARTITION BY tier, run) AS new, count(*) OVER (PARTITION BY tier, run) AS n FROM runs),
   into_ AS (SELECT shard, new FROM merged WHERE n > 1),
   any_ AS (SELECT count(*) > 0 AS more FROM into_),
   now AS (SELECT max(i) + 1 AS i, max(c) AS c FROM state)
   SELECT now.i, CASE WHEN more THEN now.c ELSE now.c + 1 END, s.arrival, s.b, coalesce(into_.new, s.shard) FROM state s LEFT JOIN into_ USING (shard), any_, now WHERE more OR now.c < 2
   UNION ALL
   SELECT now.i, now.c + 1, a.arrival, a.b, a.arrival FROM arrivals a, any_, now WHERE NOT more AND now.c < 2 AND a.c = now.c + 1)),
final AS (SELECT * FROM state WHERE i = (SELECT max(i) FROM state)),
sized AS (SELECT shard, sum(b)::BIGINT AS b FROM final GROUP BY shard)
SELECT doc_id, n_bytes, arrival, CASE WHEN s.b < 65536 THEN 0 ELSE length(bin(s.b // 65536)) END::INT AS tier, shard
FROM docs JOIN final USING (arrival) JOIN sized s USING (shard)
"""
_QUOTATIONS = r"""
keyed AS (SELECT *, md5(concat_ws(chr(1), role, text)) AS key, row_number() OVER () AS k FROM msgs),
raw AS (SELECT k, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM keyed),
marked AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t>]*'), '[^>]', '', 'g')) AS level,
         lower(trim(regexp_replace(regexp_replace(line, '^[ \t>]*', ''), '[ \t\r]+', ' ', 'g'))) AS norm FROM raw),
opened AS (SELECT *, (level <> lag(level, 1, -1) OVER (PARTITION BY k ORDER BY i))::INT AS o FROM marked WHERE norm <> ''),
lines AS (SELECT *, sum(o) OVER (PARTITION BY k ORDER BY i) AS run FROM opened),
units AS (
  SELECT true AS whole, k, conv_id, turn, run, level, string_agg(norm, chr(10) ORDER BY i) AS norm, count(*) AS c FROM lines GROUP BY k, conv_id, turn, run, level
  UNION ALL SELECT false, k, conv_id, turn, run, level, norm, 1 FROM lines),
own AS (SELECT whole, conv_id, norm, min(turn) AS own_turn FROM units WHERE level = 0 AND turn IS NOT NULL GROUP BY ALL),
firsts AS (SELECT whole, norm, list(conv_id ORDER BY conv_id)[1:2] AS fc, list(own_turn ORDER BY conv_id)[1:2] AS ft FROM own WHERE conv_id IS NOT NULL GROUP BY ALL),
cand AS (
  SELECT q.*, o.own_turn, CASE WHEN f.fc[1] = q.conv_id THEN f.fc[2] ELSE f.fc[1] END AS oc, CASE WHEN f.fc[1] = q.conv_id THEN f.ft[2] ELSE f.ft[1] END AS ot
  FROM units q LEFT JOIN own o ON o.whole = q.whole AND o.conv_id = q.conv_id AND o.norm = q.norm LEFT JOIN firsts f ON f.whole = q.whole AND f.norm = q.norm WHERE q.level > 0),
sourced AS (SELECT *, CASE WHEN own_turn < turn THEN conv_id ELSE oc END AS sc, CASE WHEN own_turn < turn THEN own_turn ELSE ot END AS st FROM cand WHERE own_turn < turn OR oc IS NOT NULL),
found AS (SELECT * FROM (SELECT *, bool_or(whole) OVER (PARTITION BY k, run) AS linked FROM sourced) WHERE whole OR NOT linked),
votes AS (SELECT k, conv_id, level, sc, st, sum(c) AS c FROM found GROUP BY ALL),
reply AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level, c DESC, coalesce(sc = conv_id, false) DESC, st DESC, sc) AS r FROM votes) WHERE r = 1),
linked AS (SELECT k, count(*) FILTER (WHERE whole) AS n_passages, coalesce(sum(c) FILTER (WHERE NOT whole), 0) AS n_lines FROM found GROUP BY k),
counts AS (SELECT k, count(*) FILTER (WHERE level > 0) AS n_quoted, max(level) AS max_level FROM lines GROUP BY k),
clean AS (
  SELECT k, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (regexp_matches(line, '(?i)(wrote|writes|schrieb|écrit|escribió) ?: *\r?$') AND coalesce(nxt, 0) > 0)) AS t
  FROM (SELECT *, lead(level) OVER (PARTITION BY k ORDER BY i) AS nxt FROM marked) GROUP BY k),
joined AS (
  SELECT m.*, coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(max_level, 0)::INT AS max_level, coalesce(n_passages, 0)::BIGINT AS n_passages, coalesce(n_lines, 0)::BIGINT AS n_lines, r.sc, r.st, coalesce(t, '') AS clean_text,
         CASE WHEN r.sc = m.conv_id THEN m.turn END AS opens
  FROM keyed m LEFT JOIN counts USING (k) LEFT JOIN linked USING (k) LEFT JOIN reply r ON r.k = m.k LEFT JOIN clean ON clean.k = m.k),
threads AS (SELECT *, max(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS thread_start FROM joined),
parents AS (SELECT conv_id, opens, max(st) AS st FROM joined WHERE opens IS NOT NULL GROUP BY ALL)
SELECT t.conv_id, turn, role, n_quoted, max_level, n_passages, n_lines, t.sc AS reply_conv, t.st AS reply_turn, thread_start, p.st AS thread_parent,
       row_number() OVER (PARTITION BY t.conv_id ORDER BY p.st NULLS FIRST, thread_start NULLS FIRST, turn NULLS FIRST, key) AS position, clean_text
FROM threads t LEFT JOIN parents p ON p.conv_id = t.conv_id AND p.opens = t.thread_start
"""
SQL["op5_quotation_linking"] = "WITH msgs AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations)," + _QUOTATIONS
SQL["quoted_replies"] = r"""
WITH near AS (
  SELECT conv_id, turn, role, text, lag(text, 1) OVER w AS l1, lag(text, 2) OVER w AS l2, lag(text, 3) OVER w AS l3 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
back AS (SELECT *, CASE WHEN turn % 3 = 0 THEN l2 ELSE l1 END AS b, CASE WHEN turn % 2 = 0 THEN l3 END AS older FROM near),
msgs AS (
  SELECT DISTINCT conv_id, turn, role, concat_ws(chr(10), '>> ' || replace(older, chr(10), chr(10) || '>> '),
         '> ' || replace(CASE WHEN turn % 4 = 0 THEN regexp_replace(b, '^[^\n]*\n', '') ELSE b END, chr(10), chr(10) || '> '), text) AS text FROM back),""" + _QUOTATIONS
_NEAR = """good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, label FROM vectors
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(least.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(least.b, e.vec_id)) AS kept
FROM vectors e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id
"""
SQL["op9_embedding_dedup"] = "WITH RECURSIVE vectors AS (SELECT * FROM embeddings)," + _NEAR
SQL["near_vectors"] = """
WITH RECURSIVE plain AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / len(embedding) AS mean FROM embeddings),
vectors AS (
  SELECT vec_id * 5 + k AS vec_id, label,
         list_transform(v, lambda x, i: x + (((vec_id * 7919 + k * 104729 + (i - 1) * 15485863 + k * (i - 1) * 611953) % 2001)::DOUBLE / 1000.0::DOUBLE - 1.0::DOUBLE) * k * 0.3::DOUBLE * mean) AS embedding
  FROM plain, range(0, 5) t(k)),""" + _NEAR
SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM places, range(1, 5) t(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, p.f AS l, q.f AS r, (2000000::HUGEINT * c.a) // (p.f + q.f) AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(w[1:k], ' ') JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, m)) AS i FROM cand), range(2, 4) t(s)
  WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
