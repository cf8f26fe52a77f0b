"""The registered queries of the operators in this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prsignal.llm import (
    bpe,
    dialogue,
    exact,
    jaccard,
    langid,
    licenses,
    mixing,
    packing,
    phrases,
    quality,
    simhash,
    suffixes,
    urls,
)
from prsignal.llm.common import kept, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_byte_bpe(spark, sf_dir):
    """Ids of every whole text, and what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_simhash(spark, sf_dir):
    """Fingerprints of every whole text, its edited text, and their likeness.

    For ids divisible by 50 also how many other fingerprints differ in at most
    three bits, and by how many the nearest.
    """
    found = kept(simhash.edited_fingerprints(table(spark, sf_dir, "documents")))
    return simhash.neighbours(found, F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False)))


# The rules of the url query.
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


@query
def op3_url_rules(spark, sf_dir):
    """The verdict on every url."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


ORACLE_SQL["op3_url_rules"] = f"""
WITH rules AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host,
         substr(rule, position('/' IN rule)) AS rule_path
  FROM (VALUES {", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)}) AS t(rule, verdict)
), rests AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
                       THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosts
), found AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC, length(r.rule_host) DESC) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM found WHERE k = 1
"""


@query
def op4_language(spark, sf_dir):
    """The language of every whole text, learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = langid.remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, held_out=held_out)
    predicted = langid.predict(docs, model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op5_quality(spark, sf_dir):
    """The quality of every whole text, learned from labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = langid.remainder(F.col("doc_id"), 5) == 0
    scored = quality.scored(docs, labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op6_best_fit(spark, sf_dir):
    """Every piece of every document, and its place in a sequence of at most 2048 tokens."""
    tokenizer = Path(public_tokenizers.path("word_bpe_49k.json")).read_bytes()
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer)


@query
def op7_licenses(spark, sf_dir):
    """The licenses that notices in every whole text name, and how far their wording differs."""
    docs = table(spark, sf_dir, "documents")
    hits = licenses.scan(docs).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.count(F.lit(1)).alias("n_notices"),
        F.sum(F.size("differences")).alias("n_differences"),
    )
    return docs.select("doc_id").join(hits, "doc_id", "left").select(
        "doc_id",
        "licenses",
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("n_differences", F.lit(0)).cast("long").alias("n_differences"),
    )


@query
def op8_repeats(spark, sf_dir):
    """What is left of every text without the bytes of strings that start earlier too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return suffixes.without_repeats(docs).select(
        "rest.doc_id",
        "n_bytes",
        length.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("left", 256).alias("kept_sha256"),
    )


@query
def op9_exact_copies(spark, sf_dir):
    """Groups of equal texts."""
    return exact.copies(table(spark, sf_dir, "documents")).drop("row")


ORACLE_SQL["op9_exact_copies"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op10_ngram_jaccard(spark, sf_dir):
    """Components of documents whose sets of word trigrams are alike by 0.9."""
    docs = table(spark, sf_dir, "documents")
    found = jaccard.similar(docs, n=3, similarity=(90, 100))
    return found.select("doc_id", "n_shingles", F.col("least_id").alias("component_id"))


@query
def op11_collocations(spark, sf_dir):
    """The phrases of each language whose words keep company most."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_collocations"] = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws
  FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), sizes AS (
  SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY lang
), f AS (
  SELECT lang, phrase, k, count(*)::HUGEINT AS a
  FROM (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces), range(1, 6) AS t(k)
        WHERE i + k - 1 <= len(ws))
  GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, j, l.a AS l, r.a AS r, s.n, (1000 * c.a * s.n) // (l.a * r.a) AS score
  FROM f c, range(1, 5) AS t(j), f l, f r, sizes s
  WHERE j < c.k AND l.lang = c.lang AND r.lang = c.lang AND s.lang = c.lang
    AND l.phrase = array_to_string(string_split(c.phrase, ' ')[:j], ' ')
    AND r.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ')
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest c
  WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = c.lang AND q.k > c.k AND q.a >= c.a
    AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


@query
def op12_conversations(spark, sf_dir):
    """What is wrong with every damaged conversation, its cheapest repair and what that gives."""
    spoiled, copies = dialogue.damaged(table(spark, sf_dir, "conversations"))
    rows = dialogue.turns(spoiled, copies)
    return dialogue.summary(rows, dialogue.edits(rows))


def _transitions() -> str:
    """Ways to deal with a row as SQL values: state, initial (null: any), fault allowed, edits, cost, lines, next state.

    States are N (nothing yet), S, U and A, after system, user and assistant.
    """
    wanted = {"N": "U", "S": "U", "U": "A", "A": "U"}
    kept = {("N", "s"): "S", ("N", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    names = {"U": "user", "A": "assistant"}
    rows = []
    for start in wanted:
        state, lines = start, ""
        for n in range(3):
            edits = "I" * n
            rows.append((start, None, True, edits + "D", 5 * n + 2, lines, None, state))
            for (before, initial), to in kept.items():
                if before == state:
                    rows.append((start, initial, False, edits + "K", 5 * n, lines, "", to))
            to = wanted[state]
            rows.append((start, None, False, edits + "R", 5 * n + 1, lines, names[to], to))
            state, lines = to, lines + names[to] + ":\n"

    def literal(value) -> str:
        if value is None:
            return "NULL"
        return str(value) if isinstance(value, (int, bool)) else "'" + value.replace("\n", "' || chr(10) || '") + "'"

    return ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)


# CRC-32 of an ASCII text, bit by bit.
_CRC32 = """xor(4294967295::UBIGINT, list_reduce(
  list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda ch: ord(ch)::UBIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)))"""

ORACLE_SQL["op12_conversations"] = f"""
WITH RECURSIVE fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC32.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fates, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies(n)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended
  FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN ended = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
), ways (state, initial, always, edits, cost, inserted, role, next) AS (
  VALUES {_transitions()}
), paths AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 'N' AS state, 0 AS cost, '' AS audit, '' AS lines FROM conversations
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT p.conv_id, f.i, w.next AS state, p.audit || w.edits AS audit,
      p.cost + w.cost + CASE WHEN f.fault = 'truncated' AND NOT w.always THEN 5 ELSE 0 END AS cost,
      p.lines || w.inserted || coalesce(
        CASE WHEN w.role = '' THEN f.role ELSE w.role END || ':' || f.text || chr(10), '') AS lines
    FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
      JOIN ways w ON w.state = p.state AND (w.always OR f.fault NOT IN ('blank', 'duplicate'))
        AND (w.initial IS NULL OR w.initial = f.initial))
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
), facts AS (
  SELECT c.conv_id, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0)::BIGINT AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(f.i), 0) AS last
  FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  GROUP BY c.conv_id
), ends AS (
  SELECT p.conv_id, p.cost + e.cost AS cost, p.audit || e.edits AS audit, p.lines || e.inserted AS lines
  FROM paths p JOIN facts f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.last = p.i
    JOIN (VALUES ('N', 0, '', ''), ('A', 0, '', ''), ('U', 5, 'I', 'assistant:' || chr(10)),
      ('S', 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))) AS e(state, cost, edits, inserted)
      ON e.state = p.state
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + e.cost, p.audit || e.edits) = 1
)
SELECT f.conv_id, gaps, blank, duplicate, truncated, illegal, cost::BIGINT AS cost, audit,
  sha256(CASE WHEN lines = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
FROM facts f JOIN ends e ON e.conv_id IS NOT DISTINCT FROM f.conv_id
"""


@query
def op13_mixture(spark, sf_dir):
    """How many words a mix of all sources takes of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
