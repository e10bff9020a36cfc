"""Line dedup by a log-template tree, with DataFrame functions only.

A line's tokens are its words, those with a digit masked. The tree has a fixed depth: a
line's leaf is its token count and its leading tokens. Inside a leaf a token is constant
where enough documents hold it at that place, and a variable field elsewhere; the line's
template is its constant tokens with variable fields left open. A masked token agrees
with every other one at its place; of the remaining tokens enough must be constant, and
one at least. Templates that recur across enough documents are dropped, however short.

A document that would lose more than ``most_share`` of its words is a copy as a whole
rather than a carrier of repeated lines; it stays as it is, for a document-level dedup.
Two texts that share 8/9 of their words are alike by 0.8 (8 of 9 + 9 - 8), so below that
share repeated lines alone make no near-duplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failcast.scratch import finished, materialize, scope

MASK = "<*>"
#: Leading tokens that choose the leaf; documents that make a template recurrent; constant share of its
#: unmasked tokens; share of its words that a document may lose.
DEPTH, MIN_DOCS, CONSTANT, MOST_SHARE = 4, 5, 0.6, 8 / 9


def tokens_of(line: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a line, those with a digit 0-9 masked."""
    loose = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for c in "\t\r\x0b\x0c":
        loose = loose | line.contains(c)
    # a plain split gives the same words where single spaces stand between them, at a fraction of the cost
    words = F.when(loose | (line == ""), F.regexp_extract_all(line, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).otherwise(F.split(line, " ", -1))
    return F.when(line.rlike("[0-9]"), F.transform(words, lambda w: F.when(w.rlike("[0-9]"), F.lit(MASK)).otherwise(w))).otherwise(words)


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, text_hash, at, raw, n_tokens, leaf and line (hashes) of each line that holds a word."""
    split = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    made = split.withColumn("tokens", tokens_of(F.col("raw"))).where(F.size("tokens") > 0)
    return made.select("doc_id", "text_hash", "at", "raw", F.size("tokens").alias("n_tokens"),
                       F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"), F.xxhash64("tokens").alias("line"))


def templates(occurrences: DataFrame, min_docs: int, constant: float) -> DataFrame:
    """line, template: the lines (hashes) whose template recurs."""
    holders = occurrences.select("leaf", "line", "doc_id").distinct()
    per_line = materialize(holders.groupBy("leaf", "line").agg(F.count("*").alias("holders")), "line_holders")
    leaves = per_line.groupBy("leaf").agg(F.sum("holders").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    # Spark's own Bloom filter of the leaves keeps the other lines out of the shuffle
    occurrences.sparkSession.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1MB")
    leaves = materialize(leaves, "line_leaves").where(F.col("leaf") >= -(1 << 63))
    texts = occurrences.select("leaf", "line", "raw").join(leaves, "leaf", "left_semi").groupBy("leaf", "line").agg(F.first("raw").alias("raw"))
    spread = materialize(texts.join(per_line, ["leaf", "line"]).select("leaf", "line", "holders", F.posexplode(tokens_of(F.col("raw"))).alias("place", "token")), "line_tokens")
    held = spread.groupBy("leaf", "place", "token").agg(F.sum("holders").alias("n")).where((F.col("n") >= min_docs) & (F.col("token") != MASK))
    fixed = spread.join(materialize(held.drop("n"), "constant_tokens").withColumn("fixed", F.lit(True)), ["leaf", "place", "token"], "left")
    shape = fixed.groupBy("leaf", "line").agg(
        F.count_if(F.col("token") != MASK).alias("n_plain"), F.count("fixed").alias("n_fixed"),
        F.sort_array(F.collect_list(F.when(F.col("fixed"), F.struct("place", "token")))).alias("constant"))
    return (shape.where((F.col("n_fixed") > 0) & (F.col("n_fixed") >= constant * F.col("n_plain")))
            .select("line", F.xxhash64("leaf", "constant").alias("template")))


def repeated_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT,
                   most_share: float = MOST_SHARE) -> DataFrame:
    """Per text that loses lines (doc_id, text_hash): drop, the places of those lines."""
    with scope(docs.sparkSession):
        occurrences = materialize(_lines(docs, depth), "lines")
        shaped = materialize(templates(occurrences, min_docs, constant), "line_templates")
        found = materialize(occurrences.join(shaped, "line").select("doc_id", "text_hash", "at", "n_tokens", "template"), "template_lines")
        often = (found.select("template", "doc_id").where("doc_id IS NOT NULL").distinct().groupBy("template").count()
                 .where(F.col("count") >= min_docs).select("template"))
        # rows repeated with id and text count as often in both sums
        gone = found.join(materialize(often, "recurring_templates"), "template").groupBy("doc_id", "text_hash").agg(
            F.sort_array(F.collect_set("at")).alias("drop"), F.sum("n_tokens").alias("lost"))
        words = occurrences.groupBy("doc_id", "text_hash").agg(F.sum("n_tokens").alias("words"))
        same = F.col("g.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("g.text_hash") == F.col("t.text_hash"))
        drops = gone.alias("g").join(words.alias("t"), same).where(F.col("lost") <= most_share * F.col("words"))
        return finished(drops.select("g.doc_id", "g.text_hash", "drop"), "dropped_lines")


def without_repeated_lines(docs: DataFrame, text: str = "text", counts: bool = False, **options) -> DataFrame:
    """``docs`` with the lines of recurring templates cut from the text; with ``counts`` also n_lines and n_dropped.

    Lines are what stands between line feeds; a line without a word is never dropped. Documents are told
    apart by doc_id (rows that share one count once, rows with a null one count for no template). Null texts stay null,
    empty ones empty. Every row is kept, equal rows alike; a text that loses all its lines would be empty.
    """
    own = docs.columns
    named = docs.withColumnRenamed(text, "text") if text != "text" else docs
    drops = repeated_lines(named.select("doc_id", "text"), **options)
    split = named.withColumns({"__hash": F.xxhash64("text"), "__lines": F.split("text", "\n", -1)}).drop("text")
    key = lambda other: split["doc_id"].eqNullSafe(other["doc_id"]) & (split["__hash"] == other["text_hash"])
    out = split.join(drops.withColumnRenamed("drop", "__drop"), key(drops), "left").drop(drops["doc_id"]).drop("text_hash")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drop")
    kept = F.when(F.col("__drop").isNull(), F.array_join("__lines", "\n")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    cols = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in own]
    if not counts:
        return out.select(*cols)
    made = out.select("*", F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("__n_dropped"))
    word = F.size(F.filter("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return made.select(*cols, F.coalesce(word, F.lit(0)).cast("long").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, text without the lines of recurring templates, n_lines and n_dropped."""
    return without_repeated_lines(docs.select("doc_id", "text"), counts=True, **options)


def cleaned_sql(depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT, most_share: float = MOST_SHARE) -> str:
    """The same result in DuckDB SQL (documents with distinct ids)."""
    return rf"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at
             FROM documents WHERE text IS NOT NULL),
worded AS (SELECT *, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{MASK}' ELSE w END) AS tokens FROM raw),
lines AS (SELECT *, len(tokens) AS n, tokens[1:{depth}] AS lead FROM worded WHERE len(tokens) > 0),
per_line AS (SELECT n, lead, tokens, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS holders FROM lines GROUP BY ALL),
spread AS (SELECT n, lead, tokens, holders, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM per_line),
held AS (SELECT n, lead, place, token FROM spread WHERE token <> '{MASK}' GROUP BY ALL HAVING sum(holders) >= {min_docs}),
shape AS (SELECT s.n, s.lead, s.tokens, count(h.token) AS n_fixed, count(*) FILTER (s.token <> '{MASK}') AS n_plain, list({{'p': s.place, 't': h.token}} ORDER BY s.place) FILTER (h.token IS NOT NULL) AS constant
          FROM spread s LEFT JOIN held h ON s.n = h.n AND s.lead = h.lead AND s.place = h.place AND s.token = h.token GROUP BY ALL),
found AS (SELECT l.doc_id, l.at, l.n, s.n AS sn, s.lead, s.constant FROM lines l JOIN shape s ON l.tokens = s.tokens WHERE s.n_fixed > 0 AND s.n_fixed >= {constant} * s.n_plain),
often AS (SELECT sn, lead, constant FROM found WHERE doc_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doc_id) >= {min_docs}),
gone AS (SELECT f.doc_id, list(f.at) AS drop, sum(f.n) AS lost FROM found f JOIN often o ON f.sn = o.sn AND f.lead = o.lead AND f.constant = o.constant GROUP BY f.doc_id),
total AS (SELECT doc_id, sum(n) AS words, count(*) AS n_lines FROM lines GROUP BY doc_id),
drops AS (SELECT g.* FROM gone g JOIN total t USING (doc_id) WHERE g.lost <= {most_share}::DOUBLE * t.words),
kept AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.at) AS text FROM raw r JOIN drops d USING (doc_id) WHERE NOT list_contains(d.drop, r.at) GROUP BY r.doc_id)
SELECT d.doc_id, CASE WHEN g.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(len(g.drop), 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN total t USING (doc_id) LEFT JOIN drops g USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
