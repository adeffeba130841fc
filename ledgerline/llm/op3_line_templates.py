"""Operator 3: line deduplication with a tree of line templates.

Lines are parsed as in a log-template tree of fixed depth: the first level is
the number of words, the next ``DEPTH`` levels are the leading words, where a
word with a digit is the variable ``<*>``. The lines of a leaf share one
template: at each place the word that most documents have there, or nothing
where it has no majority. The leading words, equal by construction, say
nothing about likeness, nor does a ``<*>`` that line and template have at the
same place; of the other places, a line that agrees with the template at
``SIMILAR`` or more belongs to it, provided that most places after the leading
words have a majority word. Any other line is a template of its own, with its
words with digits as ``<*>``. A template that recurs in
``MIN_DOCS`` documents or more is boilerplate: all of its lines go, but for
the first (smallest id, then line), so that no content is lost altogether. Unlike
lines of a template agree by chance in a large corpus: with ``n`` fixed words it
has to be in ``SHORT_SHARE ** n`` of the rows with a text, too, as short lines have.

Lines of fewer than ``MIN_WORDS`` words are parsed in the same tree, but each
masked line is a template of its own, so only repeats that are equal but for words with
digits go (``Page 1``, ``Page 2``); a short line without another word keeps its digits. As short prose recurs by
chance, the more so the shorter it is, a short line of ``n`` words has to be in
``SHORT_DOCS`` documents and in ``SHORT_SHARE ** n`` of the rows with a text:
a tenth for one word, a hundredth for two, a thousandth for three.

Lines in leaves with fewer than ``MIN_DOCS`` documents, short lines below their
own bound and lines without a word are never looked at further. Documents are counted
after removing repeats within a task, so a line that a third of all documents
hold is one row per task; only lines of frequent leaves, and of these each
different line once, are split into words. Everything is DataFrame functions.

Defined results: null and empty texts stay as they are; a document of which
all lines go has an empty text; rows with equal id and text count as one
document and get equal results; null ids come last among firsts; an empty
table stays empty; other columns pass through, ``n_chars`` is renewed where
the text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, spare, stage

DEPTH = 3
MIN_WORDS = 4
MIN_DOCS = 5
SHORT_DOCS = 20
SHORT_SHARE = 0.1  # for each word of a short line
SIMILAR = 0.6
OTHER_SPACE = r"[\x09-\x0D]"  # white space but for the space itself
ANY = "<*>"


def _split(line: Column) -> Column:
    # splitting at one plain character is far cheaper than at a pattern
    spaced = F.when(line.rlike(OTHER_SPACE), F.regexp_replace(line, OTHER_SPACE, " ")).otherwise(line)
    return F.array_remove(F.split(spaced, " "), "")


def _words(line: Column) -> Column:
    """Words of a line, those with a digit as the variable."""
    words = _split(line)
    return F.when(line.rlike("[0-9]"), F.transform(words, lambda w: F.when(w.rlike("[0-9]"), ANY).otherwise(w))) \
            .otherwise(words)


def parsed_lines(docs: DataFrame, id_col: str, text_col: str, depth: int, min_words: int) -> DataFrame:
    """(doc, doc_id, line_no, words, leaf, short) of the lines with words;
    ``doc`` stands for id and text together, ``short`` is the number of words
    of a line with fewer than ``min_words``, else 0."""
    me = F.xxhash64(F.col(id_col), F.col(text_col))
    lines = docs.filter(F.col(text_col).isNotNull()) \
                .select(me.alias("doc"), F.col(id_col).alias("doc_id"),
                        F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    words = lines.select("doc", "doc_id", "line_no", "line", _words(F.col("line")).alias("words")) \
                 .filter(F.size("words") > 0)
    size = F.size("words")
    short = F.when(size < min_words, size).otherwise(0)
    # a short line of variables only keeps its digits
    bare = (short > 0) & F.forall("words", lambda w: w == ANY)
    words = words.select("doc", "doc_id", "line_no", short.alias("short"),
                         F.when(bare, _split(F.col("line"))).otherwise(F.col("words")).alias("words"))
    # all words of a short line lead: its leaf is the line
    leaf = F.xxhash64(F.size("words"), F.when(F.col("short") > 0, F.col("words"))
                      .otherwise(F.slice("words", 1, depth)))
    return words.select("doc", "doc_id", "line_no", "words", leaf.alias("leaf"), "short")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                  min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS, similar: float = SIMILAR,
                  short_docs: int = SHORT_DOCS, short_share: float = SHORT_SHARE) -> DataFrame:
    """(doc, gone): numbers of the lines, from 0, that go from a document."""
    lines = parsed_lines(docs, id_col, text_col, depth, min_words)
    texts = docs.filter(F.col(text_col).isNotNull()).count()
    enough = F.when(F.col("short") == 0, min_docs) \
              .otherwise(F.greatest(F.lit(short_docs), texts * F.pow(F.lit(short_share), F.col("short"))))
    frequent = stage(lines.select("leaf", "short", "doc").distinct().groupBy("leaf", "short").count()
                     .filter(F.col("count") >= enough).select("leaf"), "template-leaves")
    there = stage(lines.join(frequent, "leaf").select(
        "leaf", F.xxhash64("words").alias("line"), "doc", "doc_id", "line_no", "words"), "template-lines")
    # each different line of a leaf once, with the number of its documents
    held = there.select("leaf", "line", "doc").distinct().groupBy("leaf", "line") \
                .agg(F.count(F.lit(1)).alias("docs"))
    words = there.groupBy("leaf", "line").agg(F.any_value("words").alias("words"))
    lines_once = stage(held.join(words, ["leaf", "line"]), "template-distinct")
    after = F.slice("words", depth + 1, F.size("words"))  # the leading words agree in any case
    votes = lines_once.select("leaf", "docs", F.posexplode(after).alias("place", "word")) \
                      .groupBy("leaf", "place", "word").agg(F.sum("docs").alias("votes"))
    # the word of most votes, then the least word: least of (-votes, word)
    leading = votes.groupBy("leaf", "place").agg(
        F.min(F.struct((-F.col("votes")).alias("less"), "word")).alias("lead"), F.sum("votes").alias("all"))
    # staged, so that Spark can split a leaf with very many lines in the join
    template = stage(leading.withColumn("word", F.when(-2 * F.col("lead.less") > F.col("all"), F.col("lead.word")))
                     .groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("t")), "template-words")
    known = F.size(F.filter("t", lambda t: t["word"] != ANY))
    places = F.filter(F.zip_with(after, "t", lambda w, t: F.struct(w.alias("w"), t["word"].alias("t"))),
                      lambda p: ~((p["w"] == ANY) & p["t"].eqNullSafe(ANY)))
    agree = F.size(F.filter(places, lambda p: (p["w"] == p["t"]) & (p["t"] != ANY)))
    of_leaf = (2 * known > F.size("t")) & (agree >= similar * F.size(places))
    # lines of leading words only have no template but their own
    fixed = known + F.size(F.filter(F.slice("words", 1, depth), lambda w: w != ANY))
    named = stage(lines_once.join(template, "leaf", "left").select(
        "leaf", "line", F.when(of_leaf, F.lit(0)).otherwise(F.col("line")).alias("own"),
        F.when(of_leaf, fixed).alias("fixed")), "template-names")
    rows = there.join(named, ["leaf", "line"]).select("leaf", "own", "fixed", "doc", "doc_id", "line_no")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc", "line_no")
    per_doc = rows.groupBy("leaf", "own", "fixed", "doc").agg(F.min(order).alias("first"))
    many = F.greatest(F.lit(min_docs), F.coalesce(texts * F.pow(F.lit(short_share), F.col("fixed")), F.lit(0)))
    recurring = stage(per_doc.groupBy("leaf", "own", "fixed").agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first"))
                      .filter(F.col("docs") >= many).select("leaf", "own", "first"), "template-recurring")
    gone = rows.join(recurring, ["leaf", "own"]) \
               .filter((F.col("doc") != F.col("first.doc")) | (F.col("line_no") != F.col("first.line_no")))
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out, plus
    ``lines_gone``, their number."""
    docs = docs.drop("lines_gone") if "lines_gone" in docs.columns else docs
    doc, gone_lines, mine, left = spare(docs.columns, "template_doc", "template_gone", "template_me", "template_text")
    gone = stage(dropped_lines(docs, id_col, text_col, **how), "template-gone") \
        .select(F.col("doc").alias(doc), F.col("gone").alias(gone_lines))
    me = F.xxhash64(F.col(id_col), F.col(text_col))
    # `gone` grows with the documents: never broadcast
    marked = docs.withColumn(mine, me).join(gone.hint("merge"), F.col(mine) == F.col(doc), "left")
    rest = F.array_join(F.filter(F.split(F.col(text_col), "\n"),
                                 lambda line, i: ~F.array_contains(gone_lines, i)), "\n")
    marked = marked.withColumn(left, F.when(F.col(gone_lines).isNull(), F.col(text_col)).otherwise(rest))
    columns = [F.col(left).alias(c) if c == text_col else
               F.when(F.col(gone_lines).isNull(), F.col(c)).otherwise(F.length(left)).alias(c)
               if c == "n_chars" else F.col(c) for c in docs.columns]
    return marked.select(*columns, F.coalesce(F.size(gone_lines), F.lit(0)).alias("lines_gone"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_chars", "lines_gone")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without boilerplate lines."""
    return drop_lines(docs).select(*docs.columns)


SQL = rf"""
WITH split_lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT doc_id, text, line_no, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS plain
  FROM split_lines),
masked AS (
  SELECT *, list_transform(plain, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{ANY}' ELSE w END) AS hidden,
         len(plain) AS n, len(plain) < {MIN_WORDS} AS short
  FROM worded WHERE len(plain) > 0),
parsed AS (
  SELECT doc_id, text, line_no, n, short,
         CASE WHEN short AND len(list_filter(hidden, lambda w: w <> '{ANY}')) = 0 THEN plain ELSE hidden END AS words
  FROM masked),
leaved AS (SELECT *, CASE WHEN short THEN words ELSE words[1:{DEPTH}] END AS lead FROM parsed),
corpus AS (SELECT count(*) AS texts FROM documents WHERE text IS NOT NULL),
frequent AS (
  SELECT n, lead FROM leaved, corpus GROUP BY n, lead, short, texts
  HAVING count(DISTINCT (doc_id, text)) >= CASE WHEN short THEN greatest({SHORT_DOCS}, texts * pow({SHORT_SHARE}, n)) ELSE {MIN_DOCS} END),
there AS (SELECT p.* FROM leaved p JOIN frequent USING (n, lead)),
once AS (SELECT n, lead, words, count(DISTINCT (doc_id, text)) AS docs FROM there GROUP BY n, lead, words),
placed AS (
  SELECT n, lead, docs, unnest(words[{DEPTH + 1}:]) AS word, generate_subscripts(words[{DEPTH + 1}:], 1) AS place FROM once WHERE n > {DEPTH}),
votes AS (SELECT n, lead, place, word, sum(docs) AS votes FROM placed GROUP BY n, lead, place, word),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n, lead, place ORDER BY votes DESC, word) AS r,
         sum(votes) OVER (PARTITION BY n, lead, place) AS total FROM votes),
template AS (
  SELECT n, lead, list(CASE WHEN 2 * votes > total THEN word END ORDER BY place) AS t FROM ranked WHERE r = 1 GROUP BY n, lead),
compared AS (
  SELECT o.n, o.lead, o.words, t.t,
         len(list_filter(t.t, lambda w: w <> '{ANY}')) AS known,
         len([1 FOR i IN range(1, len(t.t) + 1) IF NOT (o.words[{DEPTH} + i] = '{ANY}' AND coalesce(t.t[i] = '{ANY}', false))]) AS places,
         len([1 FOR i IN range(1, len(t.t) + 1) IF coalesce(o.words[{DEPTH} + i] = t.t[i] AND t.t[i] <> '{ANY}', false)]) AS agree
  FROM once o LEFT JOIN template t USING (n, lead)),
named AS (
  SELECT n, lead, words, coalesce(2 * known > len(t) AND agree >= {SIMILAR} * places, false) AS of_leaf,
         known + len(list_filter(lead, lambda w: w <> '{ANY}')) AS fixed
  FROM compared),
owned AS (
  SELECT t.doc_id, t.text, t.line_no, t.n, t.lead, CASE WHEN NOT of_leaf THEN m.words END AS own,
         CASE WHEN of_leaf THEN fixed END AS fixed
  FROM there t JOIN named m USING (n, lead, words)),
seen AS (
  SELECT *, rank() OVER (PARTITION BY n, lead, own ORDER BY doc_id, line_no) AS r FROM owned),
recurring AS (
  SELECT n, lead, own FROM owned, corpus GROUP BY n, lead, own, fixed, texts
  HAVING count(DISTINCT (doc_id, text)) >= greatest({MIN_DOCS}, coalesce(texts * pow({SHORT_SHARE}, fixed), 0))),
gone AS (
  SELECT DISTINCT s.doc_id, s.line_no FROM seen s JOIN recurring c
    ON s.n = c.n AND s.lead = c.lead AND s.own IS NOT DISTINCT FROM c.own WHERE s.r > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE g.doc_id IS NULL) AS text,
         count(g.doc_id) AS lines_gone
  FROM split_lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN coalesce(k.lines_gone, 0) = 0 THEN d.n_chars ELSE length(coalesce(k.text, '')) END AS n_chars,
       coalesce(k.lines_gone, 0)::INTEGER AS lines_gone
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
