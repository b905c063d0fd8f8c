"""Near-duplicate lines by deletion neighbourhoods.

The edit distance counts words: one word inserted, deleted or replaced is one edit. Two lines within one edit become equal
when the right word is deleted from one or both, so the variants of a line without one of its words are hashed
keys, and equal keys join. What meets is verified on the words, and the earlier line stays. No Python runs.

Only lines that can have a partner emit variants: within one edit, either the first or the second half of the words
is equal, so halves are counted first. Before every later join a Bloom filter of fixed size keeps rows without a partner
out of the exchange; what it lets through by chance the join drops, so results do not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldsieve.llm.common import stored, text_of

#: Lines of fewer words must match exactly to be duplicates.
LEAST_WORDS = 10
#: Bits of a filter; it holds one row for 64 of them at most, whatever the input.
FILTER_BITS = 1 << 26
SPACES = "\t\x0b\x0c\r"


def _has_word(line: Column) -> Column:
    """Whether a line holds more than white space; looks no further than its first word."""
    return F.ltrim(line, F.lit(" " + SPACES)) != ""


def _normal(line: Column) -> Column:
    """The words of a line with one space between them. Most lines are so already and are only looked at."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for space in SPACES:
        odd = odd | line.contains(space)
    words = F.array_remove(F.split(F.translate(line, SPACES, " " * len(SPACES)), " "), "")
    return F.when(odd, F.array_join(words, " ")).otherwise(line)


def _without(words: Column, i: Column) -> Column:
    """The words but the one at ``i`` (from 0)."""
    return F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words)))


def _halves(normal: Column, n: Column) -> Column:
    """Hashes of both halves of ``n`` words, as the line is (it may lose or change a word) and as one word longer than its partner."""
    keys = []
    for base in (n, n - 1):
        half = F.shiftright(base, 1)
        keys.append(F.xxhash64(F.lit("first"), base, F.call_function("substring_index", normal, F.lit(" "), half)))
        keys.append(F.xxhash64(F.lit("last"), base, F.call_function("substring_index", normal, F.lit(" "), half - base)))
    return F.array(*keys)


def _lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``place`` (key, hash of the text, number of the line) and ``body`` of every line with a word."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.posexplode(F.split(text_of(F.col(text)), "\n")).alias("at", "body"))
    return rows.filter(_has_word(F.col("body"))).select(F.struct("id", "hash", "at").alias("place"), "body")


def _marked(rows: DataFrame, column: str, wanted: DataFrame, of: str) -> DataFrame:
    """``rows`` with ``_may``: true if ``column`` is in a row of ``wanted``, false for most of the others."""

    def bit(frame: DataFrame, name: str) -> DataFrame:
        spot = F.pmod(F.xxhash64(F.col(name)), F.lit(FILTER_BITS))
        return frame.withColumns({
            "_cell": F.shiftright(spot, 6), "_bit": F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(spot, F.lit(64)).cast("int"))
        })

    cells = bit(wanted, of).groupBy("_cell").agg(F.bit_or("_bit").alias("_bits"))
    met = bit(rows, column).join(F.broadcast(cells), "_cell", "left")
    return met.withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_cell", "_bit", "_bits")


def _filtered(rows: DataFrame, column: str, wanted: DataFrame, of: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is in no row of ``wanted``; all that are remain."""
    return _marked(rows, column, wanted, of).filter("_may").drop("_may")


def _with_partner(firsts: DataFrame) -> DataFrame:
    """``place, line`` of the lines that share half of their words with a different line."""
    keys = firsts.filter("halves is not null").select("place", "line", F.explode(F.array_distinct("halves")).alias("half"))
    shared = stored(keys.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half"), "halves")
    return _filtered(keys, "half", shared, "half").join(shared, "half", "left_semi").select("place", "line").distinct()


def _earlier(partners: DataFrame) -> DataFrame:
    """``number, earlier``: candidates for the earliest line within one edit of each, by equal variants."""
    # Hashing one array after another is hashing their concatenation; numbers hash faster than words.
    words = F.col("hashes")
    left, right = F.slice(words, F.lit(1), F.col("i")), F.slice(words, F.col("i") + 2, F.size(words))
    each = partners.select("number", "hashes", F.explode(F.sequence(F.lit(0), F.size(words) - 1)).alias("i"))
    parts = stored(each.select("number", F.xxhash64(left, right).alias("key"), "i"), "variants")
    # one word replaced: both without the same word
    groups = parts.groupBy("key", "i").agg(F.min("number").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.filter("n > 1").drop("n"), "variant-groups")
    replaced = _filtered(parts, "key", groups, "key").join(groups, ["key", "i"]).select("number", F.col("least").alias("other"))
    # one word more or less: a line, and others without any one of their words; a key belongs to one line at most
    whole = partners.select(F.xxhash64("hashes").alias("key"), F.col("number").alias("other"))
    inserted = _filtered(parts, "key", whole, "key").join(whole, "key").select("number", "other")
    met = replaced.union(inserted).select(F.greatest("number", "other").alias("number"), F.least("number", "other").alias("other"))
    return met.filter("number <> other").groupBy("number").agg(F.min("other").alias("earlier"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by at most one word inserted, deleted or replaced."""
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    longer, shorter = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    inserted = F.exists(F.sequence(F.lit(0), F.size(longer) - 1), lambda i: _without(longer, i) == shorter)
    return F.when(F.size(a) == F.size(b), differ <= 1).otherwise((F.abs(F.size(a) - F.size(b)) == 1) & inserted)


def dropped_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """``id, hash, drops``: for documents that lose lines, the numbers of those lines (from 0).

    A line goes when an earlier line (by key with nulls first, hash of the text, number of the line) has the same words,
    or lies within one edit of the words of the first such line and both have ``least_words`` words or more.
    """
    n = F.octet_length("normal") - F.octet_length(F.replace(F.col("normal"), F.lit(" "), F.lit(""))) + 1
    rows = _lines(docs, text, key).select("place", _normal(F.col("body")).alias("normal")).withColumn("n", n)
    rows = stored(rows.select(
        "place", F.unhex(F.md5(F.col("normal").cast("binary"))).alias("line"),
        F.when(F.col("n") >= least_words, _halves(F.col("normal"), F.col("n"))).alias("halves"),
    ), "lines")
    # equal lines have equal halves
    firsts = rows.groupBy("line").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), F.first("halves").alias("halves"))
    firsts = stored(firsts, "first-lines")

    wanted = stored(_with_partner(firsts), "partners")
    texts = _filtered(_lines(docs, text, key), "place", wanted, "place").join(wanted, "place").dropDuplicates(["place"])
    # After a sort the ids rise with the place, so they stand for it in the variants.
    named = texts.orderBy("place").select(F.monotonically_increasing_id().alias("number"), "line", F.split(_normal(F.col("body")), " ").alias("words"))
    partners = stored(named.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))), "words")
    pairs = _earlier(partners)
    close = (
        pairs.join(partners.drop("hashes"), "number")
        .join(partners.select(F.col("number").alias("earlier"), F.col("words").alias("earlier_words")), "earlier")
        .filter(within_one_edit(F.col("words"), F.col("earlier_words")))
        .select("line", F.lit(True).alias("near"))
    )
    repeated = firsts.filter("n > 1").select("line", F.col("place").alias("first"))
    judged = stored(repeated.join(close, "line", "full_outer"), "judged")
    gone = _filtered(rows.select("place", "line"), "line", judged, "line").join(judged, "line").filter("near or place <> first")
    return gone.groupBy(F.col("place.id").alias("id"), F.col("place.hash").alias("hash")).agg(F.collect_set("place.at").alias("drops"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` with the repeated lines taken out of ``text``, and ``n_lines, n_dropped``.

    See :func:`dropped_lines` for which lines go. Lines without a word always stay; so does a null or empty text. White
    space between words does not count. Rows that repeat a key and its text are one document and lose the same lines.
    Columns of ``docs`` named ``n_lines`` or ``n_dropped`` are replaced, others are kept. An empty table gives no
    rows. A document may be left without text; it is for the caller to drop it.
    """
    lost = stored(dropped_lines(docs, text, key, least_words).select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"), "drops"), "drops")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    tagged = docs.select(F.struct(*names).alias("row"), F.col(key).alias("id"), F.col(text).alias("body"), F.xxhash64(text).alias("hash"))
    # Texts that lose nothing are not moved, but for the few that the filter lets through.
    marked = _marked(tagged.withColumn("place", F.struct("id", "hash")), "place", lost.select(F.struct("of_id", "of_hash").alias("place")), "place")
    met = marked.filter("_may").join(lost, (F.col("hash") == F.col("of_hash")) & F.col("id").eqNullSafe(F.col("of_id")), "left")
    joined = met.select("row", "body", "drops").union(marked.filter("not _may").select("row", "body", F.lit(None).cast("array<int>")))
    kept = F.array_join(F.filter(F.split("body", "\n"), lambda x, i: ~F.array_contains("drops", i)), "\n")
    has_word = F.size(F.filter(F.split(text_of(F.col("body")), "\n"), _has_word)).cast("bigint")
    left = F.when(F.col("drops").isNull(), F.col("body")).otherwise(kept)
    whole = F.struct(*(left.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names))
    return joined.select(
        whole.alias("row"), has_word.alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
    ).select("row.*", "n_lines", "n_dropped")


ORACLE = rf"""
WITH split AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
bodies AS (SELECT doc_id, unnest(ls) AS body, generate_subscripts(ls, 1) - 1 AS pos FROM split),
lines AS (
  SELECT doc_id, pos, w FROM (SELECT doc_id, pos, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM bodies) WHERE len(w) > 0),
firsts AS (SELECT w, min((doc_id, pos)) AS first, count(*) AS n FROM lines GROUP BY w),
wide AS (SELECT w, first, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= {LEAST_WORDS}),
parts AS (SELECT first, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS v FROM wide),
whole AS (SELECT first, array_to_string(w, ' ') AS v FROM firsts WHERE len(w) >= {LEAST_WORDS}),
near AS (
  SELECT a.first FROM parts a JOIN parts b ON a.v = b.v AND a.i = b.i WHERE b.first < a.first
  UNION SELECT a.first FROM parts a JOIN whole b ON a.v = b.v WHERE b.first < a.first
  UNION SELECT b.first FROM parts a JOIN whole b ON a.v = b.v WHERE a.first < b.first),
gone AS (
  SELECT l.doc_id, l.pos FROM lines l JOIN firsts f ON l.w = f.w LEFT JOIN near ON near.first = f.first
  WHERE near.first IS NOT NULL OR (l.doc_id, l.pos) <> f.first),
counted AS (SELECT doc_id, list(pos) AS drops, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
SELECT s.doc_id, coalesce(k.n, 0) AS n_lines, coalesce(c.n, 0) AS n_dropped, sha256(coalesce(
  CASE WHEN c.n IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(drops, i - 1)), chr(10)) END, '')) AS text_sha256
FROM split s LEFT JOIN counted c USING (doc_id) LEFT JOIN words k USING (doc_id)
"""
