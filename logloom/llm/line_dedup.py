"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words.  A line goes if an earlier line (by document id,
then position) has a Jaccard similarity of 0.8 or more.

1. Rarity: every word falls in one of ``BUCKETS`` buckets by its hash, and a
   bucket's class is the logarithm of how many words of the corpus fall in it.
   The classes are a table of ``BUCKETS`` small numbers, whatever the corpus; it
   is a subquery's result.  A word's key is its class above 56 bits of its hash, so sorted
   keys run from rare to frequent.
2. Lines with equal sets are one: the earliest stands for all.
3. The prefix of a set (its rarest words, one more than may be missing) goes out
   by word with the set's size, the word's place and a parity signature: each word
   flips one of 64 bits (of 128 in large sets, whose second part tells apart what
   half of the words flipped), so two sets differ in no more bits than words.  A
   semi-join by word with the length, positional and signature filters keeps the
   sets that have any possible partner; a row leaves it once, however many
   partners a hot word offers.
4. Only for those sets the words are cut again.  Each meets the earliest set of
   every prefix word first and the Jaccard is verified; only sets without a match
   there meet all earlier ones, so a group of near-equal lines never becomes all
   its pairs.

Sets and words are compared by hashes: 64 bits for a set, 56 for a word.  That two
different ones of n are confounded has a chance of at most n * n / 2 ** 57 (words)
and n * n / 2 ** 65 (sets).

Defined results: every line with a word takes part; lines without one always
stay; a null text has no lines and stays null; rows with equal id and text keep
the same lines; rows of one id but different texts are told apart by the text's
hash; a null id counts as the smallest; texts of any length are cut into lines,
and a line is the largest thing held at once; further columns are passed
through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, needed, release

#: Hash buckets of the rarity table, as a power of two.
BUCKETS = 1 << 18
#: Sets of up to so many words are near no other set: one word more or less is already too much.
ALONE = 3
#: Sets of fewer words have only the first part of the signature.
WIDE = 52
#: Bits of the table of lines whose words are cut again, at most (16 MB).
MOST_BITS = 1 << 27
_HASH = (1 << 56) - 1
_TOP_CLASS = 126

ROW = ("doc_id", "h", "pos")


def _plain(text: Column) -> Column:
    """All white space but line ends as spaces; looking for a character is much cheaper than replacing one that is not there."""
    plain, odd = text, F.lit(False)
    for c in "\t\x0b\x0c\r":
        plain, odd = F.replace(plain, F.lit(c), F.lit(" ")), odd | F.contains(text, F.lit(c))
    return F.when(odd, plain).otherwise(text)


def _classes(store: Stored, docs: DataFrame) -> Column:
    """The class of every bucket: one array of small numbers, as a subquery."""
    buckets = _lines(docs).select(F.explode(F.split("line", " ")).alias("word")).select(F.xxhash64("word").bitwiseAND(BUCKETS - 1).alias("bucket"))
    empty = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("n"))
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("n")).unionByName(empty).groupBy("bucket").agg(F.sum("n").alias("n"))
    level = F.least(F.floor(F.log2(F.col("n") + 1) * 4) + 1, F.lit(_TOP_CLASS)).cast("byte")
    # one row of BUCKETS small numbers
    table = counts.select("bucket", level.alias("level")).agg(F.sort_array(F.collect_list(F.struct("bucket", "level"))).getField("level").alias("levels"))
    return store.put(table).scalar()


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, pos, line) of the lines with a word."""
    return docs.select("doc_id", "h", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("pos", "line")).where("trim(line) != ''")


def _with_keys(lines: DataFrame, classes: Column) -> DataFrame:
    """Lines with keys: the set of a line's words from rare to frequent.

    The optimizer puts the subquery in the place of the column, so that no row carries the table.
    """
    hashes = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    hashes = F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit(""))))
    level = lambda h: F.coalesce(F.get("classes", h.bitwiseAND(BUCKETS - 1).cast("int")).cast("long"), F.lit(0))
    keys = F.sort_array(F.transform(hashes, lambda h: F.shiftleft(level(h), 56).bitwiseOR(h.bitwiseAND(_HASH))))
    kept = [c for c in lines.columns if c != "line"]
    return lines.withColumn("classes", classes).select(*kept, keys.alias("keys"))


def _places(bits: int) -> Column:
    """Which bit of a table stands for a line."""
    return F.xxhash64(*ROW).bitwiseAND(bits - 1)


def _listed(rows: DataFrame) -> Column:
    """Whether a line may be one of rows: their bits, eight for each and ``MOST_BITS`` at most, travel as one array.

    With more rows than that the table lets more lines through, and the join that follows shuffles more; it is exact either way.
    """
    bits = min(max(1 << (8 * rows.count()).bit_length(), 1 << 10), MOST_BITS)
    place = rows.select(_places(bits).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits"))
    empty = rows.sparkSession.range(bits >> 6).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    all_words = words.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = all_words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("table")).scalar()
    at = _places(bits)
    return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1


def _described(rows: DataFrame) -> DataFrame:
    """Rows with keys: their number n, their hash, signature and prefix."""
    parity = "aggregate(keys, 0L, (a, x) -> a ^ shiftleft({}, int(x & 63)))"
    whole, half = parity.format("1L"), parity.format("(x >> 6) & 1")
    prefix = F.expr(f"slice(keys, 1, if(size(keys) > {ALONE}, size(keys) - (4 * size(keys) + 4) div 5 + 1, 0))")
    return rows.withColumns({"set": F.xxhash64("keys"), "n": F.size("keys"), "s0": F.expr(whole), "s1": F.expr(f"if(size(keys) >= {WIDE}, {half}, 0L)"), "prefix": prefix})


def _firsts(known: DataFrame) -> DataFrame:
    """The earliest line of each set; Spark limits each task's part of a hot set before it deals the rest out."""
    ranked = known.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY set ORDER BY {', '.join(ROW)})"))
    return ranked.where("rank = 1").select("set", F.struct(*ROW).alias("first"), "n", "s0", "s1", "prefix")


def _postings(sets: DataFrame, name: str) -> DataFrame:
    """(name, word, n, most, s0, s1) of the prefix words, none null, so that no pair is tested for nulls.

    most: how many words a set may have whose first common word with this one it is, by length (n >= 4 in 5) and place
    (of both sets' words 4 in 9 must still come, from this one on).
    """
    rows = sets.select(name, "n", "s0", "s1", F.posexplode("prefix").alias("place", "word"))
    most = F.expr("int((5L * n - 9L * place) div 4)")
    return rows.select(name, "word", "n", most.alias("most"), "s0", "s1").select(*(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in ((name, "long"), ("word", "long"), ("n", "int"), ("most", "int"), ("s0", "long"), ("s1", "long"))))


#: Length, positional and signature filters on sets a and b whose first common word this is: of their n words
#: together, 4 in 9 must be common, so 1 in 9 may differ.
_MAY_MATCH = f"""a.word = b.word AND b.n <= a.most AND a.n <= b.most AND 9 * bit_count(a.s0 ^ b.s0) <= a.n + b.n
AND (a.n < {WIDE} OR b.n < {WIDE} OR 9 * (bit_count(a.s1 ^ b.s1) + bit_count(a.s0 ^ a.s1 ^ b.s0 ^ b.s1)) <= a.n + b.n)"""


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The later ids of the pairs whose sets are similar enough."""
    side = lambda name: sets.select(F.col("id").alias(name), F.struct("n", "keys").alias(name[0]))
    both = pairs.join(side("a_id"), "a_id").join(side("b_id"), "b_id")
    return both.where(f"9 * size(array_intersect(a.keys, b.keys)) >= 4 * (a.n + b.n)").select(F.col("a_id").alias("id")).distinct()


def _near(sets: DataFrame, store: Stored) -> DataFrame:
    """The sets (id, n, s0, s1, prefix, keys) that have a similar set of a smaller id: (id)."""
    rows = _postings(sets, "id")
    heads = rows.groupBy("word").agg(F.min("id").alias("id"), F.count("*").alias("sharing"), *(F.min_by(c, "id").alias(c) for c in ("n", "most", "s0", "s1"))).where("sharing > 1")
    pairs = lambda a, b: a.alias("a").join(b.alias("b"), F.expr(f"b.id < a.id AND {_MAY_MATCH}")).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).distinct()
    first = store.put(_similar(pairs(rows, heads), sets))
    rest = _postings(sets.join(first, "id", "left_anti"), "id")
    return first.unionByName(_similar(pairs(rest, rows), sets))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, pos) of the lines that go, of docs (doc_id, h, text)."""
    spark = docs.sparkSession
    store = Stored(spark, "lines", {"parquet.enable.dictionary": "false"})
    classes = _classes(store, docs)
    known = store.put(_described(_with_keys(_lines(docs), classes)).drop("keys"))
    sets = store.put(_firsts(known))
    index = store.put(known.select(*ROW, "set"))
    store.drop(1)
    release(spark)
    a, b = (_postings(sets, "set").alias(x) for x in "ab")
    able = store.put(a.join(b, F.expr(f"{_MAY_MATCH} AND a.set != b.set"), "left_semi").select("set").distinct())
    del a, b
    release(spark)
    wanted = store.put(sets.join(able, "set").select("first.*", "first"))
    lines, wanted = _lines(docs).where(_listed(wanted)), wanted.hint("shuffle_hash")
    same = lines.doc_id.eqNullSafe(wanted.doc_id) & (lines.h == wanted.h) & (lines.pos == wanted.pos)
    cut = store.put(_described(_with_keys(lines.join(wanted, same).select("first", "line"), classes)).dropDuplicates(["set"]))
    # numbered in the order of first lines; the numbers are written before anything uses them
    numbered = store.put(cut.orderBy("first").withColumn("id", F.monotonically_increasing_id()))
    release(spark)
    gone = store.put(_near(numbered, store).join(numbered.select("id", "set"), "id").select("set", F.lit(True).alias("gone")))
    judged = sets.select("set", "first").join(gone.hint("shuffle_hash"), "set", "left").hint("shuffle_hash")
    rows = index.join(judged, "set").where((F.struct(*ROW) != F.col("first")) | F.col("gone"))
    return store.last(rows.select(*ROW).distinct())


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return needed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its lines, how many go, and their positions from 0 as text."""
    docs = _identified(docs, id_col, text_col)
    gone = removed_lines(docs).groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("pos")).alias("gone"))
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    counts = docs.select("doc_id", "h", F.coalesce(ends + 1, F.lit(0)).cast("long").alias("n_lines"))
    joined = counts.join(gone, counts.doc_id.eqNullSafe(gone.doc_id) & (counts.h == gone.h), "left")
    return joined.select(counts.doc_id, "n_lines", F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed_lines"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, without the lines that go."""
    gone = removed_lines(_identified(docs, id_col, text_col)).groupBy("doc_id", "h").agg(F.collect_list("pos").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("hash", F.xxhash64("text"))
    joined = rows.join(gone, rows.id.eqNullSafe(gone.doc_id) & (rows.hash == gone.h), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda k: F.get(F.col("lines"), k)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    return joined.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n"))).select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
