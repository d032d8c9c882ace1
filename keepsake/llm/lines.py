"""Line dedup: an exact set-similarity join over the lines of all texts.

A line is the set of its words. Words are ordered by how rare they are in the corpus, and
only a line's rarest words, its *prefix*, are joined on: two sets as similar as asked for
must share one. Length, position and bitmap filters within the join drop pairs that cannot
reach the similarity; the rest is verified on the full sets. Native expressions throughout.

Equal sets are folded before the join, so a line repeated in a third of all texts is one
row of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch, likely_among, result_texts

THRESHOLD = 0.8
# Rarity is counted in this many hash buckets, so that its table has one size for any corpus.
RARITY_BITS = 16
# Sets after this many that share a word of their prefix are matched with the first of them beforehand,
HOT_LINES = 8
# by every word of a prefix up to this length, and by about half of the words of a longer one.
HUB_WORDS = 4
# Words of prefixes are shuffled in so many shares, one after the other, to bound the disk.
SHARES = 2
# Sets above this size get a second sketch, of four times as many bits.
WIDE_SIZE = 100
# Most hashes of words are too rare for a dictionary to be worth its making.
PLAIN_TOKENS = {"parquet.enable.dictionary#tokens.list.element": "false"}
DOC = ("object_id", "tag")
PLACE = (*DOC, "line")


def _needed(threshold: float, n: Column, m: Column) -> Column:
    """Words two sets of these sizes must share; the small term forgives rounding."""
    return F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)


def _hashes(line: Column) -> Column:
    """Hashes of the words of a line; blanks side by side leave hashes of the empty word among them."""
    # Splitting at one character needs no regular expression.
    odd = F.greatest(*[line.contains(c) for c in SPACES if c not in " \n"])
    words = F.when(odd, F.split(line, r"[ \t\x0B\f\r]")).otherwise(F.split(line, " "))
    return F.transform(words, lambda w: F.xxhash64(w))


def _bucket(token: Column) -> Column:
    return F.shiftrightunsigned(token, 64 - RARITY_BITS).cast("int")


def _rank_table(sets: DataFrame) -> DataFrame:
    """One row ``ranks``: for every bucket the bits that make its number, atop a word's hash, its rank by count."""
    words = sets.select(F.explode("tokens").alias("token"))
    counted = words.groupBy(_bucket(F.col("token")).alias("bucket")).agg(F.count("*").alias("n"))
    every = sets.sparkSession.range(1 << RARITY_BITS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"))
    whole = counted.unionByName(every).groupBy("bucket").agg(F.sum("n").alias("n"))
    by_count = whole.agg(F.sort_array(F.collect_list(F.struct("n", "bucket"))).alias("s"))
    by_bucket = by_count.select(F.sort_array(F.transform("s", lambda s, i: F.struct(s["bucket"].alias("bucket"), i.alias("rank")))).alias("s"))
    # Numbers are signed: the first half of the ranks is negative.
    ranked = lambda s: s["rank"].bitwiseXOR(1 << (RARITY_BITS - 1)).bitwiseXOR(s["bucket"])
    return by_bucket.select(F.transform("s", lambda s: F.shiftleft(ranked(s).cast("long"), 64 - RARITY_BITS)).alias("ranks"))


def _by_rarity(tokens: Column, ranks: Column) -> Column:
    """Words as numbers, rarest first: rank of the bucket, then the rest of the hash."""
    # Never null, so that the numbers are sorted as such.
    bits = lambda t: F.coalesce(F.get(ranks, F.shiftrightunsigned(t, 64 - RARITY_BITS)), F.lit(0).cast("long"))
    return F.sort_array(F.transform(tokens, lambda t: t.bitwiseXOR(bits(t))))


def _bounds(tokens: Column) -> Column:
    """Where each quarter of all hashes ends among sorted tokens; null for sets up to ``WIDE_SIZE``."""
    bounds = [F.lit(-(1 << 62)), F.lit(0).cast("long"), F.lit(1 << 62)]
    merged = F.sort_array(F.concat(tokens, F.array(*bounds)))
    ends = [(F.array_position(merged, b) - k - 1).cast("int") for k, b in enumerate(bounds)]
    return F.when(F.size(tokens) > WIDE_SIZE, F.array(F.lit(0), *ends, F.size(tokens)))


def _sketches(sets: DataFrame) -> DataFrame:
    """Adds ``bits``, parities of words by hash, and ``wide``, the same in four parts, of sets above ``WIDE_SIZE``."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))
    parity = lambda tokens: F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(bit(t)))
    bound = lambda k: F.get("bounds", F.lit(k))
    part = lambda k: parity(F.slice("tokens", bound(k) + 1, bound(k + 1) - bound(k)))
    wide = F.when(F.col("n") > WIDE_SIZE, F.array(*[part(k) for k in range(4)]))
    return sets.withColumn("bits", parity(F.col("tokens"))).withColumn("wide", wide)


def remove_similar_lines(results: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Remove lines whose words are those of an earlier line, or nearly.

    Reads ``object_id, result_text`` of semantic results. Lines are split at newlines and
    ordered by object_id, then by place in the text. A line goes if the Jaccard similarity of
    its set of words with that of some earlier line, in the same text or another, is at
    least ``threshold``; lines are judged on the input. Returns per input row: object_id,
    n_lines, n_removed, ``kept_text`` (remaining lines, unchanged, joined by newlines).

    Lines without words are never removed. Null text is one empty line and stays null.
    Rows that repeat an object_id and its text get the same result and do not remove from
    each other; different texts of one object_id are ordered by a hash of the text. Rows
    without object_id stand outside the order, remove nothing and lose nothing. An empty
    table gives no rows. Other columns are not read.
    """
    scratch = Scratch(results.sparkSession, "lines")
    texts = result_texts(results).withColumn("tag", F.xxhash64("result_text"))
    known = texts.filter("object_id IS NOT NULL AND result_text IS NOT NULL")

    # Texts in their order, those that repeat once; ids of lines follow it.
    once = known.repartitionByRange(*DOC).withColumn("copy", F.row_number().over(Window.partitionBy(*DOC).orderBy(*DOC))).filter("copy = 1")
    split = once.select(*DOC, F.posexplode(F.split("result_text", "\n")).alias("line", "content"))
    split = split.select(*PLACE, F.monotonically_increasing_id().alias("id"), _hashes(F.col("content")).alias("hashes"))
    split = split.select(*PLACE, "id", F.sort_array(F.array_distinct(F.array_remove("hashes", F.xxhash64(F.lit(""))))).alias("tokens"))
    written = scratch.write(split.select(
        *PLACE, "id", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("set_a"), F.xxhash64(F.lit(1), "tokens").alias("set_b"),
        _bounds(F.col("tokens")).alias("bounds"), "tokens"), "sets", PLAIN_TOKENS)
    sets = written.filter("n > 0")

    # Only the first line of each set is compared. Written apart, so that the join can split a set of many lines.
    repeated = sets.groupBy("set_a", "set_b").agg(F.min("id").alias("first"), F.count("*").alias("lines")).filter("lines > 1")
    repeated = scratch.write(repeated.select("set_a", "set_b", "first"), "repeated")
    copies = scratch.write(sets.join(repeated, ["set_a", "set_b"]).filter("id > first").select("id", *PLACE), "copies")
    ranks = scratch.write(_rank_table(sets), "ranks").scalar()
    n = F.col("n")
    length = F.greatest(n - F.ceil(n * threshold - 1e-9) + 1, F.lit(1)).cast("int")
    described = _sketches(sets.select("id", "n", "tokens", "bounds")).withColumn("ranks", ranks)
    described = described.select("id", "n", "bits", "wide", F.slice(_by_rarity(F.col("tokens"), F.col("ranks")), F.lit(1), length).alias("prefix"))
    firsts = scratch.write(described.join(copies.select("id"), "id", "left_anti"), "firsts")

    def possible(x: str, y: str) -> Column:
        """Whether sizes and sketches of two sets allow the similarity."""
        # Bits are parities of words by hash: as many as differ, at least, are not shared.
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        apart = lambda a, b: F.bit_count(a.bitwiseXOR(b))
        in_wide = [apart(F.get(f"{x}.wide", F.lit(k)), F.get(f"{y}.wide", F.lit(k))) for k in range(4)]
        differing = F.when((n > WIDE_SIZE) & (m > WIDE_SIZE), in_wide[0] + in_wide[1] + in_wide[2] + in_wide[3]).otherwise(
            apart(F.col(f"{x}.bits"), F.col(f"{y}.bits")))
        return (F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9) & (n + m - differing >= 2 * _needed(threshold, n, m))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Later lines of the pairs that are similar on their full sets."""
        wanted = pairs.select(F.col("later").alias("id")).unionByName(pairs.select(F.col("earlier").alias("id"))).distinct()
        found = scratch.write(likely_among(sets.select("id", "tokens"), wanted, "id").join(wanted, "id"), "found", PLAIN_TOKENS)
        later, earlier = found.select(F.col("id").alias("later"), F.col("tokens").alias("x")), found.select(F.col("id").alias("earlier"), F.col("tokens").alias("y"))
        alike = F.size(F.array_intersect("x", "y")) >= _needed(threshold, F.size("x"), F.size("y"))
        similar = scratch.write(pairs.join(later, "later").join(earlier, "earlier").filter(alike).select(F.col("later").alias("id")).distinct(), name)
        scratch.drop(found)
        return similar

    # Where many lines share a word of their prefix, most of those that resemble any resemble
    # the first: a line for each, not a pair for every two.
    in_order = Window.partitionBy("token").orderBy("id")
    hub = F.first(F.struct("id", "n", "bits", "wide")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at_prefix = firsts.select("id", "n", "bits", "wide", F.size("prefix").alias("words"), F.explode("prefix").alias("token"))
    at_prefix = at_prefix.filter((F.col("words") <= HUB_WORDS) | (F.pmod("token", F.lit(2)) == 0))
    at_hubs = at_prefix.select("id", "n", "bits", "wide", F.row_number().over(in_order).alias("place"), hub.alias("hub"))
    at_hubs = at_hubs.alias("x").filter((F.col("place") > HOT_LINES) & (F.col("id") > F.col("hub.id")) & possible("x", "hub"))
    near_hubs = at_hubs.select(F.col("id").alias("later"), F.col("hub.id").alias("earlier")).distinct()
    settled = verified(scratch.write(near_hubs, "near_hubs"), "settled")

    # All other pairs whose later line is not settled. One side of a pair, the smaller set,
    # needs fewer words of its prefix.
    marked = firsts.join(settled.withColumn("settled", F.lit(True)), "id", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))

    def open_pairs(share: int) -> DataFrame:
        rows = marked.select("id", "n", "bits", "wide", "settled", F.posexplode("prefix").alias("at", "token"))
        rows = rows.filter(F.pmod("token", F.lit(SHARES)) == share)
        x, y = rows.alias("x"), rows.alias("y")
        xn, yn = F.col("x.n"), F.col("y.n")
        smaller = (yn < xn) | ((yn == xn) & (F.col("y.id") < F.col("x.id")))
        indexed = F.col("y.at") < yn - _needed(threshold, yn, yn) + 1
        in_reach = F.least(xn - F.col("x.at"), yn - F.col("y.at")) >= _needed(threshold, xn, yn)
        open_later = ~F.when(F.col("x.id") > F.col("y.id"), F.col("x.settled")).otherwise(F.col("y.settled"))
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & smaller & indexed & open_later & in_reach & possible("x", "y"))
        return pairs.select(F.greatest("x.id", "y.id").alias("later"), F.least("x.id", "y.id").alias("earlier"))

    shares = [scratch.write(open_pairs(k).distinct(), f"pairs-{k}") for k in range(SHARES)]
    pairs = scratch.write(reduce(DataFrame.unionByName, shares).distinct(), "pairs")
    similar = settled.unionByName(verified(pairs, "similar"))

    gone = copies.select(*PLACE).unionByName(likely_among(sets.select("id", *PLACE), similar, "id").join(similar, "id").select(*PLACE))
    # Lines of a text meet as narrow rows; collected before the shuffle they would be wide.
    flags = scratch.write(gone.repartition(*DOC).groupBy(*DOC).agg(F.collect_list("line").alias("gone")), "flags")
    scratch.drop(written, repeated, copies, firsts, pairs, *shares)
    parts = F.split("result_text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone"), lambda i: F.get("parts", i))
    cut = texts.join(flags, [*DOC], "left").select("object_id", "result_text", "gone", F.when(F.col("gone").isNotNull(), parts).alias("parts"))
    return cut.select(
        "object_id", F.size(F.split(F.coalesce("result_text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("result_text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))
