"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. A line goes if an earlier line (by doc_id, then line number) has a Jaccard similarity of
THRESHOLD or more. The join follows prefix filtering: words are ordered by rarity, and two sets that similar share a
word among the first n - ceil(t n) + 1 of each. Sizes and the places of the shared word bound the overlap that is still
possible (length and positional filters), parity signatures bound the symmetric difference, and what passes is
verified on the words themselves.

Rarity is the doubling level of the word's count in a table of cells addressed by hash: it needs no join of all words
with their counts, while any fixed order keeps the join exact. The number of cells grows with the text, so words rarely
share one, up to MOST_CELLS (a byte each); beyond that, words of the same cell share a level and only the order gets
coarser. Shared words are found by a 31-bit part of their hashes; a collision only adds a candidate.

Signatures hold the parity of the words in 64 cells, in 128 and 256 for longer lines, where fewer would be saturated:
cells whose parities differ are a lower bound of the words that differ. Rows of prefix words carry 64 cells only, of the
set without the words before the row's. No word before the first that two sets share is common, so of that row the places
of both count as words that differ, beside the cells; other rows of a pair mostly fail this bound, and needn't pass it. The
wider signatures wait with their sets for the pairs.

Bounded work for groups of copies: equal sets are grouped first and only their first line goes on. Then each set is
verified against two sets, instead of all pairs: of the first and the preceding ones that share a prefix word, those
that share most; sets that find an earlier match this way are done. Only the others are joined with all earlier sets,
within these bounds; that join reads a table bucketed by word, so prefix words are shuffled once. Lines of a set that a large share of all lines belongs to meet it by a broadcast of bounded size. All steps are
DataFrame and SQL functions.

Defined cases: null text is one empty line; lines without words never match and stay; rows of the same doc_id and text
are one document and share its result, rows of the same doc_id and other text are ordered by a hash of the text; a null
doc_id comes before all others; no rows give no rows; lines of any length and number are taken whole; a column named
removed_lines is replaced, others of clashing names stay. Lines are one set if two 64-bit hashes over the 57-bit hashes
of their words agree: among 10^12 lines, under one in 10^14 that any two are taken for equal by the former, and lines
that differ in one word for equal by the latter only at odds of one in 10^17 each.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, join_hot, shuffles_removed, stored

THRESHOLD = 0.8
#: Words are counted in a power of two of cells: one for this many bytes of text or less, up to a bound of memory.
BYTES_A_CELL, MOST_CELLS = 128, 1 << 24
LEVEL_BIT = 57
#: Tables of places in documents are broadcast up to this size, else joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Words above which a line's signature has 128 or 256 cells.
LONG_LINE, LONGER_LINE = 80, 170
#: Words at most that a row's signature leaves out.
MOST_BEFORE = 32
WHITE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _text() -> F.Column:
    return F.coalesce("text", F.lit(""))


def _document() -> list[F.Column]:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key"), F.xxhash64(_text()).alias("th")]


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), line_no, line."""
    split = docs.select("doc_id", F.xxhash64(_text()).alias("th"), F.split(_text(), "\n").alias("lines"))
    return split.select("doc_id", "th", F.posexplode("lines").alias("line_no", "line"))


def line_words(line: F.Column) -> F.Column:
    """The lower-cased words of a line. Splitting at single spaces is cheaper than at runs of any white space."""
    odd = line.contains("\t") | line.contains("\r") | line.contains("\v") | line.contains("\f")
    return F.array_remove(F.when(odd, F.split(F.lower(line), WHITE)).otherwise(F.split(F.lower(line), " ")), "")


def _shift(number: F.Column, bits: F.Column, to: str = "left") -> F.Column:
    return F.call_function(f"shift{to}", number, bits)


def rarity(docs: DataFrame) -> tuple[F.Column, int]:
    """Levels of all cells as a constant of a byte each, and their number. Level k: counted 2^k to 2^(k+1) - 1 times.

    Words are counted as they stand between spaces: cheap and near enough.
    """
    total = docs.agg(F.sum(F.octet_length(_text()))).first()[0] or 0
    size = min(MOST_CELLS, max(1 << 12, 1 << (total // BYTES_A_CELL).bit_length()))
    words = docs.select(F.explode(F.split(_text(), " ")).alias("w"))
    counted = words.groupBy(F.xxhash64("w").bitwiseAND(size - 1).cast("int").alias("cell")).count()
    level = F.floor(F.log2("count")).cast("bigint")
    byte = F.shiftleft(F.col("cell").bitwiseAND(7), 3)
    with shuffles_removed(docs.sparkSession):
        packed = counted.groupBy(F.shiftright("cell", 3).alias("at")).agg(F.bit_xor(_shift(level, byte)).alias("levels")).toArrow()  # eight cells a row
    table = np.zeros(size >> 3, "<i8")
    table[packed["at"].to_numpy()] = packed["levels"].to_numpy()
    return F.lit(table.tobytes()), size


def _ranked(word: F.Column, levels: F.Column, size: int) -> F.Column:
    """The word's level above LEVEL_BIT bits of its hash: sorting by it is sorting by rarity."""
    level = F.ascii(F.substring(levels, word.bitwiseAND(size - 1).cast("int") + 1, 1).cast("string"))
    return F.shiftleft(level.cast("bigint"), LEVEL_BIT).bitwiseOR(word.bitwiseAND((1 << LEVEL_BIT) - 1))


def prefix_size(n: F.Column, threshold: float) -> F.Column:
    return (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int")


SIGNATURES = ("sig", "sig2", "sig3", "sig4")


def signatures(words: F.Column) -> list[F.Column]:
    """Parities in 64 cells of all words; for longer lines also of the words with bit 44, bit 45 and both, else 0."""
    n, bit = F.size(words), {k: (lambda h, k=k: F.shiftright(h, k)) for k in (44, 45)}
    marks = {
        "sig": (0, lambda h: F.lit(1).cast("bigint")), "sig2": (LONG_LINE, lambda h: bit[44](h).bitwiseAND(1)),
        "sig3": (LONGER_LINE, lambda h: bit[45](h).bitwiseAND(1)), "sig4": (LONGER_LINE, lambda h: bit[44](h).bitwiseAND(bit[45](h)).bitwiseAND(1)),
    }

    def parity(mark: Callable[[F.Column], F.Column]) -> F.Column:
        return F.aggregate(words, F.lit(0).cast("bigint"), lambda s, h: s.bitwiseXOR(_shift(mark(h), h.bitwiseAND(63).cast("int"))))

    return [(parity(mark) if not least else F.when(n > least, parity(mark)).otherwise(0)).alias(name) for name, (least, mark) in marks.items()]


def distinct_sets(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Stored: every line with words (doc_id, th, line_no, sid), and every distinct set (id, sid, first, copies, n, signatures, prefix).

    sid is a pair of hashes of the set, id a number in the order of the sets' first lines, prefix the set's rarest words
    in order.
    """
    levels, size = rarity(docs)
    hashes = F.array_distinct(F.transform(line_words(F.col("line")), lambda w: F.xxhash64(w)))
    # a filter on the words themselves would be pushed down and make them twice
    worded = document_lines(docs).where(F.col("line").rlike(WORD)).select("doc_id", "th", "line_no", F.sort_array(F.transform(hashes, lambda h: _ranked(h, levels, size))).alias("words"))
    words = F.col("words")
    n = F.size(words)
    prefix = F.transform(F.slice(words, 1, prefix_size(n, threshold)), lambda h: h.bitwiseAND(0x7FFFFFFF).cast("int"))
    sid = F.struct(F.xxhash64(words).alias("one"), F.xxhash64(F.lit(1), words).alias("two")).alias("sid")
    lines = stored(worded.select("doc_id", "th", "line_no", sid, n.alias("n"), *signatures(words), prefix.alias("prefix")), "lines")
    first = F.min(F.struct("doc_id", "th", "line_no")).alias("first")
    sets = lines.groupBy("sid").agg(first, F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", *SIGNATURES, "prefix")])
    ordered = sets.repartitionByRange("first").sortWithinPartitions("first")
    return lines.select("doc_id", "th", "line_no", "sid"), stored(ordered.select(F.monotonically_increasing_id().alias("id"), "*"), "line-sets")


def _need(n: F.Column, m: F.Column, threshold: float) -> F.Column:
    """Common words that sets of n and m words must have."""
    return F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - 1e-9)


def _alike(other: str, threshold: float, wide: bool = True) -> F.Column:
    """Length and signature filters between a row's set and its ``other``; only 64 cells if not ``wide``."""
    n, m = F.col("n"), F.col(f"{other}.n")

    def differing(*parts: F.Column) -> F.Column:
        return reduce(operator.add, map(F.bit_count, parts))

    one, *more = (F.col(c).bitwiseXOR(F.col(f"{other}.{c}")) for c in (SIGNATURES if wide else SIGNATURES[:1]))
    shorter, least = F.least(n, m), differing(one)
    if wide:
        two, three, four = more
        quarters = (four, two.bitwiseXOR(four), three.bitwiseXOR(four), one.bitwiseXOR(two).bitwiseXOR(three).bitwiseXOR(four))
        least = F.when(shorter > LONGER_LINE, differing(*quarters)).when(shorter > LONG_LINE, differing(two, one.bitwiseXOR(two))).otherwise(least)
    return (shorter >= F.greatest(n, m) * F.lit(threshold) - 1e-9) & (least <= (n + m) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9)


def _possible(other: str, threshold: float) -> F.Column:
    """The filters of 64 cells and the positional one; places count from 0."""
    n, m = F.col("n"), F.col(f"{other}.n")
    return _alike(other, threshold, wide=False) & (F.least(n - F.col("at"), m - F.col(f"{other}.at")) >= _need(n, m, threshold))


def _first_shared(other: str, threshold: float) -> F.Column:
    """What holds for the first word that similar sets share: words before it, of both, differ beside those that signatures tell."""
    before = F.least(F.col("at"), F.lit(MOST_BEFORE)) + F.least(F.col(f"{other}.at"), F.lit(MOST_BEFORE))
    differ = before + F.bit_count(F.col("sig").bitwiseXOR(F.col(f"{other}.sig")))
    return _possible(other, threshold) & (differ <= (F.col("n") + F.col(f"{other}.n")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9)


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y: ids) that have the similarity. Only the lines of these pairs are read again."""
    pairs = stored(pairs.distinct(), "line-candidates")
    named = stored(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), "line-named")
    # few sets are in a pair: the others stay where they are
    known = stored(sets.select("id", "first", "n", *SIGNATURES).join(_small(named), "id"), "line-known")
    x = known.select(F.col("id").alias("x"), F.col("first").alias("x_first"), "n", *SIGNATURES)
    y = known.select(F.col("id").alias("y"), F.col("first").alias("y_first"), F.struct("n", *SIGNATURES).alias("other"))
    kept = pairs.join(x, "x").join(y, "y").where(_alike("other", threshold))
    kept = stored(kept.select("x", "y", "x_first", "y_first"), "line-pairs")
    ends = kept.select(F.col("x").alias("id"), F.col("x_first").alias("first")).unionByName(kept.select(F.col("y").alias("id"), F.col("y_first").alias("first"))).distinct()
    key = F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias("doc_key")
    wanted = stored(ends.groupBy(key, F.col("first.th").alias("th")).agg(F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "id")).alias("wanted")), "line-places")
    texts = docs.select(*_document(), _text().alias("text")).join(_small(wanted, "wanted", 16), ["doc_key", "th"])
    one = texts.select(F.explode("wanted").alias("p"), F.split("text", "\n").alias("lines")).select("p.id", F.get("lines", F.col("p.line_no")).alias("line"))
    words = stored(one.groupBy("id").agg(F.first("line").alias("line")), "line-words")
    both = kept.select("x", "y").join(words.select(F.col("id").alias("x"), F.col("line").alias("x_line")), "x").join(words.select(F.col("id").alias("y"), F.col("line").alias("y_line")), "y")
    sets_of = F.struct(F.array_distinct(line_words(F.col("x_line"))).alias("a"), F.array_distinct(line_words(F.col("y_line"))).alias("b"))
    # one element, so that the word sets are made once though the condition names them twice
    similar = F.transform(F.array(sets_of), lambda p: F.size(F.array_intersect(p["a"], p["b"])) >= _need(F.size(p["a"]), F.size(p["b"]), threshold))
    return both.where(F.element_at(similar, 1)).select("x", "y")


def _small(frame: DataFrame, lists: str | None = None, width: int = 0) -> DataFrame:
    """Marked for broadcast if its rows, with the entries of the array column ``lists``, are of bounded size."""
    entries = F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.lit(0)
    rows, inside = frame.agg(F.count(F.lit(1)), entries).first()
    return F.broadcast(frame) if rows * 80 + inside * width <= BROADCAST_BYTES else frame


def _shared_words(sets: DataFrame, threshold: float) -> str:
    """A table bucketed by prefix word: every set with a word that another set has, and its first candidates.

    sig is without the words before the row's. lead and before: ids of the first and the preceding set with the word, if
    the filters leave them possible.
    """
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1).cast("bigint")
    after = F.aggregate(F.slice("prefix", 1, F.least("at", F.lit(MOST_BEFORE))), F.col("sig"), lambda s, w: s.bitwiseXOR(_shift(one, w)))  # shifts count modulo 64
    words = sets.select("id", "n", "sig", "prefix", F.posexplode("prefix").alias("at", "w")).select("id", "n", after.alias("sig"), "at", "w").repartition(parts, "w")
    own = F.struct("id", "n", "at", "sig")
    order = Window.partitionBy("w").orderBy("id")
    met = words.withColumns({"lead": F.first(own).over(order.rowsBetween(Window.unboundedPreceding, 0)), "before": F.lag(own).over(order), "followed": F.lead("id").over(order).isNotNull()})
    near = F.col("before").isNotNull()
    kept = met.where(near | F.col("followed")).select("w", "id", "n", "at", "sig", *[F.when(near & _possible(c, threshold), F.col(f"{c}.id")).alias(c) for c in ("lead", "before")])
    name = f"line_shared_{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        kept.write.format("parquet").option("compression", "zstd").bucketBy(parts, "w").sortBy("w").saveAsTable(name)
    return name


def matched_sets(sets: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id of every set that an earlier set matches; stored."""
    spark = sets.sparkSession
    name = _shared_words(sets, threshold)
    try:
        shared = spark.table(name)
        near = shared.select(F.col("id").alias("x"), F.explode(F.array_compact(F.array("lead", "before"))).alias("y")).groupBy("x", "y").count()
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "y"))), 1, 2)  # a line has few candidates
        tried = stored(near.groupBy("x").agg(best.alias("best")).select("x", F.explode("best.y").alias("y")), "line-tried")
        done = stored(verified(tried, sets, docs, threshold).select("x").distinct(), "line-done")
        slim = shared.select("w", "id", "n", "at", "sig")
        rest = slim.join(_small(done), slim["id"] == done["x"], "left_anti").withColumnRenamed("id", "x")
        earlier = slim.select("w", F.struct("id", "n", "at", "sig").alias("y"))
        met = rest.join(earlier, "w").where((F.col("y.id") < F.col("x")) & _first_shared("y", threshold))
        later = met.select("x", F.col("y.id").alias("y"))
        found = verified(later.join(tried, ["x", "y"], "left_anti"), sets, docs, threshold).select("x")
        return stored(done.unionByName(found).distinct().withColumnRenamed("x", "id"), "line-matched")
    finally:
        spark.sql(f"DROP TABLE {name}")


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th, line_no of every line that goes."""
    lines, sets = distinct_sets(docs, threshold)
    matched = matched_sets(sets, docs, threshold)
    heads = sets.select("id", "first").join(_small(matched), "id").select("first.doc_id", "first.th", "first.line_no")
    several = sets.where("copies > 1").select("sid", "first", "copies")
    few = _small(several)
    itself = F.struct("doc_id", "th", "line_no")
    marked = lines.join(few, "sid") if few is not several else join_hot(lines, several, "sid", "copies", lines.count())
    return marked.where(~itself.eqNullSafe(F.col("first"))).select("doc_id", "th", "line_no").unionByName(heads)


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` plus removed_lines (numbers from 0); text is what is left, null where it was null."""
    key, th = free_name(docs, "key"), free_name(docs, "text_hash")
    taken = removed.groupBy(_document()[0].alias(key), F.col("th").alias(th)).agg(F.array_sort(F.collect_set("line_no")).alias("removed_lines"))
    taken = stored(taken, "line-removed")
    names = [c for c in docs.columns if c.lower() != "removed_lines"]
    own = docs.select(*names, *[c.alias(n) for c, n in zip(_document(), (key, th), strict=True)])
    joined = own.join(_small(taken, "removed_lines", 4), [key, th], "left")
    gone = F.coalesce("removed_lines", F.array().cast("array<int>"))
    parts = F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains(F.col("removed_lines"), at))
    left = F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(F.array_join(parts, "\n"))
    return joined.select(*[left.alias(n) if n == "text" else F.col(n) for n in names], gone.alias("removed_lines"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines, kept_sha256 (of the text that is left) of every document."""
    slim = docs.select("doc_id", "text", F.size(F.split(_text(), "\n")).alias("n_lines"))
    left = without_lines(slim, removed_lines(docs, threshold))
    return left.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", F.sha2(_text(), 256).alias("kept_sha256"))
