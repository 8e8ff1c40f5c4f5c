"""Quality rules: word and line counts of each text, and line frequency across the documents of a host.

A line that many different documents of one host share is boilerplate. Lines are normalised and
hashed; for each host and line the different documents (texts) that have it are counted. Lines above
the limit are taken away and documents that lose too much are rejected. All steps are DataFrame
functions; a hot host is split by its lines, counts are aggregated before every shuffle, and texts
are judged where they are read. A verdict has the number of words taken away; kept documents are
returned with texts that lack those lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import among, halvings, let
from .common import BROADCAST_KEYS, discard, free_name, stored

#: Words that a kept document has at least, also after its frequent lines are gone.
MIN_WORDS = 20
#: Hundredths of words in repeated windows at most.
MOST_REPEATED = 30
WINDOW_WORDS = 8
#: A line is frequent in a host if more documents than this, and than this share of the host's, have it.
LINE_DOCS = 10
LINE_SHARE = 0.02
#: Hundredths of a document's words that frequent lines may hold at most: in any document, and in one
#: that without them has too few words.
MOST_REMOVED = 80
MOST_REMOVED_SHORT = 50

#: ASCII white space apart from the blank, and the symbols that are counted.
_SPACES = "\t\n\u000b\f\r"
_SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")


def _window_hashes(words: Column) -> Column:
    """A hash of each window of eight words, from hashes of two and four words."""

    def step(hashes: Column, apart: int) -> Column:
        return F.zip_with(hashes, F.slice(hashes, F.lit(apart + 1), F.size(hashes)), lambda a, b: F.xxhash64(a, b))

    ones = F.transform(words, lambda w: F.xxhash64(w))
    eights = let(let(let(ones, lambda h: step(h, 1)), lambda h: step(h, 2)), lambda h: step(h, 4))
    return let(eights, lambda h: F.slice(h, F.lit(1), F.size(h) - (WINDOW_WORDS - 1)))


def repeated_words(words: Column) -> Column:
    """Words in eight-word windows that the text has twice or more, the first occurrence included."""

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def covered(starts: Column) -> Column:
        each = F.transform(starts, lambda x, k: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(starts, k + 1), x + WINDOW_WORDS) - x))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(places(hashes), covered))

    return F.when(F.size(words) < WINDOW_WORDS, 0).otherwise(let(_window_hashes(words), count))


def base_counts(text: Column) -> Column:
    """A struct of the counts of one text; zeros for null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.regexp_count(text, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    return found


def normal(line: Column) -> Column:
    """The line as it is compared: lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def _line_hashes(text: Column) -> Column:
    """hash and words of each line that is not blank, in order."""
    clean = F.filter(F.transform(F.split(text, "\n"), normal), lambda x: x != "")
    return F.transform(clean, lambda x: F.struct(F.xxhash64(x).alias("hash"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))


def _host() -> Column:
    return F.coalesce("source", F.lit(""))


def frequent_lines(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """host and line (hash) of the lines that too many different documents of a host have.

    Documents are different if their texts are, so exact copies count once. A hot host or line is
    counted by parts: each of its (line, text) pairs is a group of its own before lines are counted.
    """
    rows = docs.where(F.col("text").isNotNull()).select(_host().alias("host"), F.xxhash64("text").alias("doc"), F.array_distinct(F.transform(_line_hashes(F.col("text")), lambda x: x["hash"])).alias("lines"))
    # The filter on size keeps the exploded array from being computed anew for each column.
    lines = stored(rows.where(F.size("lines") > 0).select("host", "doc", F.explode("lines").alias("line")), "lines")
    counts = lines.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > line_docs)
    hosts = lines.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    found = stored(counts.join(hosts, "host").where(F.col("n") > line_share * F.col("docs")).select("host", "line"), "frequent")
    discard(lines)
    return found


def _with_frequent(docs: DataFrame, frequent: DataFrame, name: str) -> DataFrame:
    """docs with an array, called name, of its host's frequent lines; null where there are none.

    Above its share of a host's documents a host has few lines, so they are one array a host. Few
    arrays are broadcast. Of many, those of hosts with over a thousandth of all rows (a thousand at
    most) are broadcast, so that no hot host's texts meet in one task; the others are shuffled.
    """
    host, mark = free_name(docs, "_host"), free_name(docs, "_hot")
    by_host = frequent.groupBy(F.col("host").alias(host)).agg(F.collect_list("line").alias(name))
    if frequent.count() <= BROADCAST_KEYS:
        return docs.join(F.broadcast(by_host), _host() == F.col(host), "left").drop(host)
    hot = docs.groupBy(_host().alias(host)).agg(F.count("*").alias("n")).where(F.col("n") > docs.count() / 1000).select(host, F.lit(True).alias(mark))
    marked = docs.join(F.broadcast(hot), _host() == F.col(host), "left").drop(host)
    few = marked.where(F.col(mark)).join(F.broadcast(by_host.join(F.broadcast(hot.select(host)), host, "left_semi")), _host() == F.col(host), "left")
    rest = marked.where(F.col(mark).isNull()).join(by_host, _host() == F.col(host), "left")
    return few.union(rest).drop(host, mark)


def _hits(lines: Column, frequent: Column) -> Column:
    """The frequent ones of the lines' hashes, sorted."""
    return F.sort_array(F.array_intersect(F.transform(lines, lambda x: x["hash"]), frequent))


def removed_words(text: Column, frequent: Column) -> Column:
    """Words of the text's lines that are frequent."""

    def count(lines: Column) -> Column:
        def of(hit: Column) -> Column:
            total = let(halvings(hit), lambda steps: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.when(among(hit, steps, x["hash"]), x["words"]).otherwise(0)))
            return F.when(F.size(hit) > 0, total).otherwise(F.lit(0).cast("long"))

        return let(_hits(lines, frequent), of)

    return F.when(frequent.isNull(), F.lit(0).cast("long")).otherwise(F.coalesce(let(_line_hashes(text), count), F.lit(0).cast("long")))


def without_lines(text: Column, frequent: Column) -> Column:
    """The text without its frequent lines; other lines stay as they are."""

    def drop(pairs: Column) -> Column:
        def rest(hit: Column) -> Column:
            kept = let(halvings(hit), lambda steps: F.array_join(F.transform(F.filter(pairs, lambda x: ~among(hit, steps, x["hash"])), lambda x: x["line"]), "\n"))
            return F.when(F.size(hit) > 0, kept).otherwise(text)

        return let(_hits(pairs, frequent), rest)

    pairs = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.xxhash64(normal(x)).alias("hash")))
    return F.when(frequent.isNull() | text.isNull(), text).otherwise(let(pairs, drop))


def judge_quality(docs: DataFrame, keep: bool = False, min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED, most_removed: int = MOST_REMOVED, most_removed_short: int = MOST_REMOVED_SHORT, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """Counts and verdict of every row of docs(doc_id, text, source, ...).

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    removed (words of frequent lines). A null text has no words and fails; a null source is the host
    ``. Repeated rows are judged each and count once as documents of a line; texts of any length are
    read whole. An empty table gives no rows. With keep, the kept rows are returned with all columns
    of docs, their texts without the frequent lines, and n_chars (if there is such a column) set anew.
    """
    frequent = frequent_lines(docs, line_docs, line_share)
    name = free_name(docs, "_frequent")
    rows = _with_frequent(docs, frequent, name)
    counts = F.struct(base_counts(F.col("text")).alias("c"), removed_words(F.col("text"), F.col(name)).alias("removed"))

    def verdict(x: Column) -> Column:
        n, removed = F.coalesce(x["c"]["n_words"], F.lit(0)), x["removed"]
        failed = (n < min_words) | (100 * F.coalesce(x["c"]["n_repeat_words"], F.lit(0)) > most_repeated * n)
        most = F.when(n - removed < min_words, most_removed_short).otherwise(most_removed)
        named = [F.coalesce(x["c"][k], F.lit(0).cast("long")).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(*named, failed.alias("base_failed"), (~failed & (100 * removed <= most * n)).alias("kept"), removed.alias("removed"))

    judged = let(counts, verdict)
    if keep:
        # A filter alone: counts and verdict are computed once for each row, texts do not move.
        out = rows.where(judged["kept"]).withColumn("text", without_lines(F.col("text"), F.col(name)))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
        return out.select(docs.columns)
    return rows.select("doc_id", judged.alias("x")).select("doc_id", "x.n_words", "x.word_chars", "x.n_symbols", "x.n_dup_lines", "x.n_repeat_words", "x.base_failed", "x.kept", "x.removed")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT k, i, array_to_string(words[i:i + 7], ' ') AS x FROM w, unnest(range(1, len(words) - 6)) AS u(i) WHERE len(words) >= 8),
twice AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, x) > 1),
rep AS (SELECT k, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM twice) GROUP BY k),
l AS (SELECT k, host, text, line FROM (SELECT k, host, text, unnest(list_transform(lines, lambda x: trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')))) AS line FROM w)),
c AS (SELECT host, line, count(DISTINCT text) AS n FROM l GROUP BY ALL HAVING count(DISTINCT text) > 10),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM l GROUP BY ALL),
freq AS (SELECT host, line FROM c JOIN hosts USING (host) WHERE n > 0.02 * docs),
rem AS (SELECT k, sum(length(line) - length(replace(line, ' ', '')) + 1) AS removed FROM l JOIN freq USING (host, line) GROUP BY k),
b AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed
      FROM w LEFT JOIN rep USING (k) LEFT JOIN rem USING (k)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * removed <= (CASE WHEN n_words - removed < 20 THEN 50 ELSE 80 END) * n_words AS kept, removed
FROM v
"""
