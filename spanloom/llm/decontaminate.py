"""Benchmark passages in training texts, by a positional inverted index; DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import bucketed, partitions, settings, written

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Test words, or windows, that one pass broadcasts; more of them take more passes.
BLOCK = 1_000_000
#: Rarest words of a window whose lists are intersected one after another, before the rest at once.
FIRST = 2

_UPPER = "".join(map(chr, range(65, 91)))
_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
END = -1


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all characters beyond ASCII; only A-Z is lower-cased. Null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _GAPS, _UPPER.lower() + " " * len(_GAPS))
    return F.array_remove(F.split(plain, " ", -1), "")


def vocabulary(items: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct words of test items: word and term, a number. Written once."""
    return written(items.select(F.explode(words(F.col(text_col))).alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")


def _blocks(rows: DataFrame, key: str) -> list[DataFrame]:
    """Disjoint parts of a small written table, each of about BLOCK rows."""
    n = -(-rows.count() // BLOCK) or 1
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def index(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of the vocabulary's words in all documents: row, term, pos, and an end mark for each document.

    A document's end mark has the term -1, its number of words as ``pos`` and its id
    as ``id``. Documents are dealt by row once, and the postings are stored in buckets by row, in order
    of terms within a bucket: a term's list is spread over all buckets, however common it is, and lists
    are intersected where they lie. Of the documents' columns only id and text are read.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(n, "row")
    placed = rows.select("row", "id", F.posexplode(F.array_append(words(F.col("text")), F.lit(""))).alias("pos", "word"))
    mark = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(END).cast("long").alias("term"))
    parts = _blocks(vocab, "word")
    known = [F.broadcast(p.unionByName(mark) if i == 0 else p) for i, p in enumerate(parts)]
    made = reduce(DataFrame.unionByName, [placed.join(k, "word").select("row", F.when(F.col("term") == END, F.col("id")).alias("id"), "term", "pos") for k in known])
    return bucketed(made.sortWithinPartitions("term"), "postings", n, "row")


def windows(items: DataFrame, postings: DataFrame, vocab: DataFrame, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the items that may occur: w, len, rest and items. Written once.

    ``rest`` lists a window's words (n, off, term) from the rarest in the index to the commonest; ``items``
    are the items that have it, as strings. A window with a word that no document has is left out.
    """
    listed = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("v")).where(F.size("v") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("v") - width + 1, F.lit(1))))
    cut = listed.withColumn("at", starts).select("item", F.slice("v", F.col("at"), F.lit(width)).alias("v"))
    cut = written(cut.groupBy("v").agg(F.collect_set("item").alias("items")).withColumn("w", F.monotonically_increasing_id()), "windows")
    known = vocab.join(postings.where(F.col("term") >= 0).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term")
    spread = cut.select("w", F.posexplode("v").alias("off", "word")).join(known, "word")
    rest = spread.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("rest"))
    whole = cut.join(rest, "w").where(F.size("rest") == F.size("v"))
    return written(whole.select("w", F.size("v").alias("len"), "rest", "items"), "windows")


def occurrences(postings: DataFrame, found: DataFrame, slop: int = 0) -> DataFrame:
    """Where windows occur: row, start, len and w. Written once.

    Lists are shifted by each word's offset and intersected from the rarest word on:
    its list gives the possible starts, each of the next words' lists cuts them down, and the lists of the rest
    are met at once. With ``slop`` 0 the words stand in order, next to each other: an exact
    phrase. Else each may stand up to ``slop`` places from where the rarest one puts it: a match by proximity
    (two such places may be one, if the words are equal). All joins are on row, by which the postings are
    dealt: only starts are hashed, and nothing is shuffled.
    """
    width = 2 * slop + 1
    lists = postings.where(F.col("term") >= 0)
    bins = lambda x: F.floor(x / F.lit(width)) if slop else x

    def met(starts: DataFrame, word: Column) -> DataFrame:
        """Starts whose ``word`` (off, term) stands where it should, more than once if it does so more than once."""
        asked = starts.withColumn("_o", word).withColumn("_low", F.col("start") + F.col("_o.off") - slop)
        asked = asked.withColumn("_bin", bins(F.col("_low")) if not slop else F.explode(F.array_distinct(F.array(bins(F.col("_low")), bins(F.col("_low") + 2 * slop)))))
        asked = asked.select(*starts.columns, "_low", "_bin", F.col("_o.term").alias("_term"), F.col("_o.off").alias("_off"))
        have = lists.select(F.col("row").alias("_row"), F.col("term").alias("_t"), F.col("pos").alias("_pos"), bins(F.col("pos")).alias("_b"))
        same = (F.col("row") == F.col("_row")) & (F.col("_term") == F.col("_t")) & (F.col("_bin") == F.col("_b"))
        return have.join(asked.hint("shuffle_hash"), same & (F.col("_pos") - F.col("_low")).between(0, 2 * slop)).drop("_row", "_t", "_b", "_bin", "_pos", "_low", "_term")

    made = []
    for part in _blocks(found, "w"):
        rare = part.select("w", "len", "rest", F.col("rest")[0]["term"].alias("term"), F.col("rest")[0]["off"].alias("off"))
        starts = lists.join(F.broadcast(rare), "term").select("row", (F.col("pos") - F.col("off")).alias("start"), "w", "len", "rest")
        if not slop:
            starts = starts.where("start >= 0")
        for k in range(1, FIRST):  # a shorter window meets its last word again
            last = F.least(F.lit(k), F.size("rest") - 1)
            starts = met(starts, F.get("rest", last)).drop("_off")
            starts = starts.dropDuplicates(["row", "start", "w"]) if slop else starts
        rest = starts.where(F.size("rest") > FIRST)
        want = F.size("rest") - FIRST
        all_of = met(rest.select("row", "start", "w", "len", want.alias("want"), F.explode(F.slice("rest", FIRST + 1, F.greatest(want, F.lit(0)))).alias("o")), F.col("o"))
        all_of = all_of.groupBy("row", "start", "w", "len", "want").agg((F.count_distinct("_off") if slop else F.count(F.lit(1))).alias("n")).where("n = want")
        made += [starts.where(F.size("rest") <= FIRST).select("row", "start", "len", "w"), all_of.select("row", "start", "len", "w")]
    # rows of the same document lie together, whatever else a join compares
    with settings(postings.sparkSession, requireAllClusterKeysForCoPartition="false"):
        return written(reduce(DataFrame.unionByName, made), "occurrences")


def hits(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each document with what it shares with test items: id, n_words, n_hit and items (a sorted list of strings).

    A word inside any occurrence of any window of ``width`` consecutive words of an item is
    hit. A null or empty text has no words; items without words are passed over, a null
    item id is written as an empty string, and equal ones are listed once. Rows that repeat an id are separate documents. Empty
    tables give no rows, or no hits. Other columns don't matter. Test items are taken in
    blocks of BLOCK words and windows, which are broadcast; there is no bound on either table.
    With ``slop``, words of a proximity match count as the places that an exact one would have.
    """
    vocab = vocabulary(items, item_text)
    postings = index(docs, vocab, id_col, text_col)
    found = windows(items, postings, vocab, width, item_col, item_text)
    at = occurrences(postings, found, slop)
    ahead = Window.partitionBy("row").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = at.select("row", "start", "len").distinct().withColumn("_upto", F.greatest(F.max(end).over(ahead), F.col("start")))
    covered = fresh.groupBy("row").agg(F.sum(F.greatest(end - F.coalesce("_upto", "start"), F.lit(0))).alias("n_hit"))
    met = at.select("row", "w").distinct().join(found.select("w", "items"), "w").select("row", F.explode("items").alias("item"))
    listed = met.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    marks = postings.where(F.col("term") == END).select("row", "id", F.col("pos").alias("n_words"))
    out = marks.join(covered, "row", "left").join(listed, "row", "left")
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op11(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: words hit by windows of ten words, and the items they come from."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    made = hits(docs, items)
    return made.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS v FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS v FROM benchmark),
cut AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(v) - {WINDOW}, 0) + 2), lambda s: array_to_string(v[s:s + {WINDOW - 1}], ' '))) AS g FROM i WHERE len(v) > 0),
lens AS (SELECT DISTINCT len(string_split(g, ' ')) AS k FROM cut),
runs AS (SELECT r, k, unnest(list_transform(range(1, len(v) - k + 2), lambda s: {{'s': s, 'g': array_to_string(v[s:s + k - 1], ' ')}})) AS x FROM d, lens),
hit AS (SELECT DISTINCT r, k, x.s AS s, item FROM runs JOIN cut ON x.g = g),
places AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT r, s, k FROM hit)) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(v)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(t, '')) AS items_sha256, places.n IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN named USING (r)
"""
