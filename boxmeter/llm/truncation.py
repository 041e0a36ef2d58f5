"""Text cut off by field limits (problem 9).

Method, in SQL throughout: count word trigrams inside texts against trigrams at
ends, join the last trigram of each text, and flag those that are frequent
inside but almost never terminal.  A trigram is terminal where a sentence or a
text ends.  The last word may itself be a piece of a word, so a trigram also
goes on inside where a longer word that begins with it stands in its place; and
where a trigram is too rare, its rates lean on the bigram's and the word's.
What carrying systems set behind a cut (dots, marks in brackets, signatures) is
taken off first and decides nothing.  An exact check follows for texts whose trigrams
are too rare to tell: a structure that is left open goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from boxmeter.session import cut

#: What may stand behind the last word, read backwards from the end of the text: blanks, dots, dots in brackets, replacement characters, a signature line.
TAIL_BACKWARDS = r"^(?:[\s\u00a0\ufffd…]++|\.{2,}+|[\])](?:\.{2,}+|…++)[\[(]|[^\n]*+(?<= --)\n)*+"
#: Blanks between two sentences or lines.  A line break behind a comma, a colon or an opening bracket, or before a closing bracket, ends nothing.
GAP = (
    r"(?=[\s\u00a0])(?:(?<=[.?!][\"')\]”»]{0,2})[\s\u00a0]++(?![\p{Ll}\p{N}])|(?<![,:{\[(\s\u00a0])[\s\u00a0]*\n[\s\u00a0]*+(?![})\]]))"
)
#: What stands for them among the tokens.
BREAK = "\x1e"
#: Words, numbers, closing marks, and any other character.
TOKEN = r"[\p{L}\p{M}]++|\p{N}++(?:[.,:]\p{N}++)*+|[.?!]++|[^\s\u00a0]"
#: Longer words are looked up by so many first letters, then compared whole.
LEAD = 4

# Every position of every sentence with its trigram and the word before it, and where it stands.
# Positions inside are counted; the last one of each text stays a row of its own.
_POSITIONS = """
WITH bodies AS (
  SELECT doc_id, xxhash64(text) AS text_hash, left(text, length(text) - length(regexp_extract(reverse(text), :tail, 0))) AS body
  FROM {docs} WHERE text IS NOT NULL AND doc_id IS NOT NULL
), tokens AS (
  SELECT doc_id, text_hash, regexp_extract_all(lower(regexp_replace(body, :gap, :break)), :token, 0) AS t,
         length(body) - length(replace(body, '{{', '')) > length(body) - length(replace(body, '}}', ''))
         OR length(body) - length(replace(body, '[', '')) > length(body) - length(replace(body, ']', ''))
         OR ((length(body) - length(replace(body, '```', ''))) div 3) % 2 = 1 AS open_structure
  FROM bodies
), words AS (
  SELECT doc_id, text_hash, open_structure, w,
         coalesce(get(t, i - 3), :break) AS p3, coalesce(get(t, i - 2), :break) AS p2, coalesce(get(t, i - 1), :break) AS p1, get(t, i + 1) AS n1, get(t, i + 2) AS n2
  FROM tokens LATERAL VIEW posexplode(t) AS i, w
), marked AS (
  SELECT *, n1 IS NULL OR n1 = :break AS n1_gap, n2 IS NULL OR n2 = :break AS n2_gap,
         coalesce(startswith(n1, '.') OR startswith(n1, '?') OR startswith(n1, '!'), false) AS n1_stop
  FROM words
  WHERE w <> :break
), placed AS (
  SELECT n1 IS NULL OR n1_stop AND n2 IS NULL AS final, n1_gap OR n1_stop AND n2_gap AS sentence_end,
         doc_id, text_hash, open_structure, n1 <=> '.' AS stop,
         n1_stop OR w IN ('"', "'", ')', ']', '\u201d', '\u00bb') AND (startswith(p1, '.') OR startswith(p1, '?') OR startswith(p1, '!')) AS ended,
         CASE WHEN p1 = :break OR p2 = :break OR p3 = :break THEN '^' WHEN p3 >= '0' AND p3 < ':' THEN '0' ELSE p3 END AS x,
         CASE WHEN p1 = :break OR p2 = :break THEN '^' WHEN p2 >= '0' AND p2 < ':' THEN '0' ELSE p2 END AS a,
         CASE WHEN p1 = :break THEN '^' WHEN p1 >= '0' AND p1 < ':' THEN '0' ELSE p1 END AS b,
         CASE WHEN w >= '0' AND w < ':' THEN '0' ELSE w END AS c
  FROM marked
  WHERE NOT (n1_gap AND (startswith(w, '.') OR startswith(w, '?') OR startswith(w, '!')))
)
SELECT x, a, b, c, CASE WHEN final THEN doc_id END AS doc_id,
       count_if(NOT final AND NOT sentence_end) AS n_in, count_if(NOT final AND sentence_end) AS n_sent, count_if(final) AS n_fin,
       max(CASE WHEN final THEN text_hash END) AS text_hash, bool_or(final AND ended) AS ended, bool_or(final AND stop) AS stop,
       bool_or(final AND open_structure) AS open_structure
FROM placed
GROUP BY x, a, b, c, CASE WHEN final THEN doc_id END
"""

_COUNTS = """
WITH g4 AS (
  SELECT x, a, b, c, sum(n_in) AS n_in, sum(n_sent) AS n_sent, sum(n_fin) AS n_fin FROM {positions} GROUP BY x, a, b, c
)
SELECT x, a, b, c, n_in, n_sent, n_fin FROM g4
"""

# The counts of the trigrams and their shorter forms at the ends of texts.
# Longer words that go on from a last word: both sides are met by their first letters, then compared whole.
_VERDICT = """
WITH g4 AS (
  SELECT * FROM {counts}
), g3 AS (
  SELECT a, b, c, sum(n_in) AS n_in, sum(n_sent) AS n_sent, sum(n_fin) AS n_fin FROM g4 GROUP BY a, b, c
), g2 AS (
  SELECT b, c, sum(n_in) AS n_in, sum(n_sent) AS n_sent, sum(n_fin) AS n_fin FROM g3 GROUP BY b, c
), g1 AS (
  SELECT c, sum(n_in) AS n_in, sum(n_sent) AS n_sent, sum(n_fin) AS n_fin FROM g2 GROUP BY c
), k3 AS (
  SELECT DISTINCT a, b, c, left(c, :lead) AS lead FROM g4 WHERE n_fin > 0 AND c RLIKE '^\\\\p{{L}}'
), k2 AS (
  SELECT DISTINCT b, c, lead FROM k3
), k1 AS (
  SELECT DISTINCT c, lead FROM k2
), p3 AS (
  SELECT k.a, k.b, k.c, sum(n) AS n_longer
  FROM k3 k JOIN (
    SELECT a, b, c, left(c, i) AS lead, n_in + n_sent AS n FROM g3 LATERAL VIEW explode(sequence(1, least(:lead, length(c)))) AS i
    WHERE length(c) > 1 AND n_in + n_sent > 0
  ) g ON k.a = g.a AND k.b = g.b AND k.lead = g.lead AND g.c <> k.c AND startswith(g.c, k.c)
  GROUP BY k.a, k.b, k.c
), p2 AS (
  SELECT k.b, k.c, sum(n) AS n_longer
  FROM k2 k JOIN (
    SELECT b, c, left(c, i) AS lead, n_in + n_sent AS n FROM g2 LATERAL VIEW explode(sequence(1, least(:lead, length(c)))) AS i
    WHERE length(c) > 1 AND n_in + n_sent > 0
  ) g ON k.b = g.b AND k.lead = g.lead AND g.c <> k.c AND startswith(g.c, k.c)
  GROUP BY k.b, k.c
), p1 AS (
  SELECT k.c, sum(n) AS n_longer
  FROM k1 k JOIN (
    SELECT c, left(c, i) AS lead, n_in + n_sent AS n FROM g1 LATERAL VIEW explode(sequence(1, least(:lead, length(c)))) AS i
    WHERE length(c) > 1 AND n_in + n_sent > 0
  ) g ON k.lead = g.lead AND g.c <> k.c AND startswith(g.c, k.c)
  GROUP BY k.c
)
SELECT g4.x, g4.a, g4.b, g4.c, g4.n_in AS in4, g4.n_sent AS sent4, g4.n_fin AS fin4,
       g3.n_in AS in3, g3.n_sent AS sent3, g3.n_fin AS fin3, g2.n_in AS in2, g2.n_sent AS sent2, g2.n_fin AS fin2,
       g1.n_in AS in1, g1.n_sent AS sent1, g1.n_fin AS fin1,
       coalesce(p3.n_longer, 0) AS longer3, coalesce(p2.n_longer, 0) AS longer2, coalesce(p1.n_longer, 0) AS longer1
FROM g4
JOIN g3 ON g4.a = g3.a AND g4.b = g3.b AND g4.c = g3.c
JOIN g2 ON g4.b = g2.b AND g4.c = g2.c
JOIN g1 ON g4.c = g1.c
LEFT JOIN p3 ON g4.a = p3.a AND g4.b = p3.b AND g4.c = p3.c
LEFT JOIN p2 ON g4.b = p2.b AND g4.c = p2.c
LEFT JOIN p1 ON g4.c = p1.c
WHERE g4.n_fin > 0
"""

# A text and its copies are no evidence about themselves, so they are taken off.
# Rates of a trigram lean on those of the bigram, and these on the word's, as far as the trigram is rare.
_RATES = """
WITH copies AS (
  SELECT text_hash, count(*) AS own FROM {finals} GROUP BY text_hash
), joined AS (
  SELECT f.doc_id, f.ended, f.stop, f.open_structure, f.x, f.a, f.b, f.c, c.own,
         v.in3, v.in2, v.in1, v.longer3, v.longer2, v.longer1, v.sent3, v.sent2, v.sent1,
         v.fin3 - c.own AS fin3, v.fin2 - c.own AS fin2, v.fin1 - c.own AS fin1,
         v.sent4 + v.fin4 - c.own AS end4, v.in4, v.sent3 + v.fin3 - c.own AS end3, v.sent2 + v.fin2 - c.own AS end2, v.sent1 + v.fin1 - c.own AS end1
  FROM {finals} f
  JOIN copies c ON f.text_hash = c.text_hash
  JOIN {verdict} v ON f.x = v.x AND f.a = v.a AND f.b = v.b AND f.c = v.c
), one AS (
  SELECT *, (end1 + 0.5D) / (in1 + end1 + 0.5D) AS r1,
         (in1 + sent1 + 0.1D * fin1 + 0.5D) / (in1 + sent1 + 0.1D * fin1 + longer1 + 0.5D) AS w1
  FROM joined
), two AS (
  SELECT *, (end2 + :lean * r1) / (in2 + end2 + :lean) AS r2,
         (in2 + sent2 + 0.1D * fin2 + :lean * w1) / (in2 + sent2 + 0.1D * fin2 + longer2 + :lean) AS w2
  FROM one
), three AS (
  SELECT *, (end3 + :lean * r2) / (in3 + end3 + :lean) AS r3,
         (in3 + sent3 + 0.1D * fin3 + :lean * w2) / (in3 + sent3 + 0.1D * fin3 + longer3 + :lean) AS w3
  FROM two
), four AS (  -- the check that follows: the word before the trigram
  SELECT *, (end4 + :lean * r3) / (in4 + end4 + :lean) AS r4 FROM three
)
SELECT *,
       CASE
         WHEN NOT ended AND w3 < 3 * :rare THEN 'word'
         WHEN (stop OR NOT ended) AND r3 < :rare AND r4 < :rare THEN 'trigram'
         WHEN open_structure THEN 'structure'
       END AS reason
FROM four
"""


def endings(docs: DataFrame, rare: float = 0.01, lean: float = 5.0) -> DataFrame:
    """(doc_id, reason, ...): how each text ends; reason is null where it ends as texts do.

    ``trigram``: its last trigram goes on inside texts and almost never ends
    one; ``word``: it goes on inside its last word, in the same trigram;
    ``structure``: neither tells, but a bracket or a fence is open.
    ``rare`` is the share of terminal ones below which a trigram is almost never
    terminal; ``lean`` how many occurrences of a trigram weigh as much as its
    bigram.  Null, empty and blank texts give no row.  doc_id is taken to be unique.
    """
    spark = docs.sparkSession
    positions = cut(spark.sql(_POSITIONS, {"tail": TAIL_BACKWARDS, "gap": GAP, "break": BREAK, "token": TOKEN}, docs=docs.select("doc_id", "text")))
    counts = cut(spark.sql(_COUNTS, positions=positions))
    verdict = spark.sql(_VERDICT, {"lead": LEAD}, counts=counts)
    return spark.sql(_RATES, {"rare": rare, "lean": lean}, finals=positions.filter("doc_id IS NOT NULL"), verdict=verdict)


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, reason) of the texts that were cut."""
    return endings(docs).filter("reason IS NOT NULL").select("doc_id", "reason")


def rates(docs: DataFrame, cut_docs: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, n_trigram, n_word, n_structure, cut_rate): how often each source truncates, and by which reason it shows; sources without case, outer blanks and ``-`` for ``_``, null as ''."""
    return docs.sparkSession.sql(
        """
        SELECT coalesce(lower(replace(trim(source), '-', '_')), '') AS source, count(*) AS n_texts,
               count(c.doc_id) AS n_cut, count_if(c.reason = 'trigram') AS n_trigram, count_if(c.reason = 'word') AS n_word, count_if(c.reason = 'structure') AS n_structure,
               count(c.doc_id) / count(*) AS cut_rate
        FROM (SELECT doc_id, source FROM {docs} WHERE text RLIKE '[^\\\\s\\u00a0]') d
        LEFT JOIN {cut} c ON d.doc_id = c.doc_id
        GROUP BY 1
        """,
        docs=docs, cut=cut_docs,
    )
