"""Document fingerprints: SimHash, and all fingerprints within a Hamming radius, in DataFrame functions only.

A term is a word and the word after it (A-Z lower-cased; the last word alone), its weight the
number of times it occurs.  The two 64-bit hashes of each term vote on 128 signed bits, and a
bit is set where the votes for it outweigh those against.  Votes are counted two bits to a
64-bit sum, 32 bits each, which holds texts of up to 2**31 terms; terms are exploded and
summed within one stage, so only one narrow row a document and task is shuffled.

Near fingerprints are found in permuted block tables: BITS are cut to BLOCKS blocks, and
for each choice of KEY blocks there is a table that has those in front.  Fingerprints
within RADIUS = BLOCKS - KEY bits agree in all bits of some KEY blocks, so an equi-join on
(table, front blocks) finds every one; a pair is taken from the first table it meets in and
verified on all bits.  Equal fingerprints are one row with a count before that, so copies
cost nothing, and only the stated queries are looked up, against all fingerprints.

Documents are put in order by ranges of doc_id of about RANGE_ROWS rows, bounded by quantiles (MOST_RANGES
at most, whose bounds are the one thing broadcast); the first document of a range is sent to
the range before as well, as the next one of its last.

Defined cases: a null text counts as empty, and the empty text has a fingerprint of its own;
texts equal but for upper case A-Z and white space have equal fingerprints; a null doc_id
comes before all others, and rows that share a doc_id follow each other by text; a single
document is its own next one; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_az, staged

BITS, BLOCKS, KEY = 128, 6, 3
RADIUS = BLOCKS - KEY
#: Documents of a range of doc_id, and most ranges.
RANGE_ROWS, MOST_RANGES = 500, 1 << 16
LANES = 0x0000000100000001


def terms_of(text: Column) -> Column:
    """The words that terms are made of, white space being the space and U+0009 to U+000D."""
    return F.split(F.btrim(lower_az(text), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys (which tell the rows apart) and text -> keys, high, low: the fingerprint as two 64-bit numbers."""
    words = texts.select(*keys, terms_of(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    term = words.select(*keys, "_w", F.posexplode("_w").alias("_at", "_word")).select(*keys, F.xxhash64("_word", F.expr("get(_w, _at + 1)")).alias("_h"))
    term = term.select(*keys, "_h", F.xxhash64("_h").alias("_g"))
    # sum i holds the votes for bit i in its lower half and those for bit i + 32 in its upper one
    votes = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES))).alias(f"{h}{i}") for h in ("_h", "_g") for i in range(32)]
    voted = term.groupBy(*keys).agg(F.count("*").alias("_n"), *votes)

    def number(h: str) -> Column:
        out = F.lit(0).cast("bigint")
        for i in range(32):
            c = F.col(f"{h}{i}")
            for bit, n in ((i, c.bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(c, 32))):
                out = out.bitwiseOR(F.when(2 * n > F.col("_n"), F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint")))
        return out

    return voted.select(*keys, number("_h").alias("high"), number("_g").alias("low"))


def distance(high: Column, low: Column, other_high: Column, other_low: Column) -> Column:
    return F.bit_count(high.bitwiseXOR(other_high)) + F.bit_count(low.bitwiseXOR(other_low))


def likeness(*pair: Column) -> Column:
    """The share of equal bits, from 0 to 1."""
    return 1 - distance(*pair) / F.lit(float(BITS))


def as_text(high: Column, low: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def _blocks() -> list[tuple[int, int]]:
    """(mask of high, mask of low) of each block."""
    edges = [round(BITS * i / BLOCKS) for i in range(BLOCKS + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [(signed(m >> 64), signed(m & (1 << 64) - 1)) for m in masks]


def _same_block(block: tuple[int, int]) -> Column:
    high, low = block
    return (F.col("high").bitwiseXOR(F.col("q_high")).bitwiseAND(F.lit(high)) == 0) & (F.col("low").bitwiseXOR(F.col("q_low")).bitwiseAND(F.lit(low)) == 0)


def near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every pair of different fingerprints of queries and prints (high, low, each once) within radius: q_high, q_low, high, low, bits.

    radius: RADIUS at most.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the tables find fingerprints within {RADIUS} bits")
    blocks, chosen = _blocks(), list(combinations(range(BLOCKS), KEY))

    def keyed(df: DataFrame, high: str, low: str) -> DataFrame:
        fronts = []
        for no, of in enumerate(chosen):
            h, m = (F.col(c).bitwiseAND(F.lit(sum(blocks[b][i] for b in of))) for i, c in enumerate((high, low)))
            fronts.append(F.struct(F.lit(no).alias("table"), F.xxhash64(h, m).alias("front")))
        return df.select(high, low, F.inline(F.array(*fronts)))

    asked = keyed(queries.select(F.col("high").alias("q_high"), F.col("low").alias("q_low")), "q_high", "q_low")
    found = asked.join(keyed(prints.select("high", "low"), "high", "low"), ["table", "front"])
    bits = distance(F.col("high"), F.col("low"), F.col("q_high"), F.col("q_low"))
    met = found.where(bits.between(1, radius))
    # the first table that a pair meets in has its first KEY equal blocks in front
    same = [_same_block(b).cast("int") for b in blocks]
    first = F.array(*(F.when(s == 1, F.lit(i)) for i, s in enumerate(same)))
    table = F.element_at(F.array(*(F.lit(1 << 0) * 0 + sum(1 << b for b in of) for of in chosen)), F.col("table") + 1)
    front = F.aggregate(F.slice(F.array_compact(first), 1, KEY), F.lit(0), lambda acc, b: acc + F.pow(F.lit(2.0), b).cast("int"))
    return met.where(table == front).select("q_high", "q_low", "high", "low", bits.alias("bits"))


def _ranged(docs: DataFrame) -> DataFrame:
    """Each document in its range of doc_id, and the first of a range once more in the one before (`guest`)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    ranges = min(MOST_RANGES, max(1, n // RANGE_ROWS))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = (rows.agg(F.percentile_approx("doc_id", cuts, 10 * ranges).alias("c")).first()["c"] or []) if cuts else []
    bounds = sorted(set(bounds))
    side = max(1, round(len(bounds) ** 0.5))
    coarse = bounds[::side]
    if bounds:
        both = docs.sparkSession.createDataFrame([(coarse, bounds)], "coarse array<bigint>, bounds array<bigint>")
        rows = rows.crossJoin(F.broadcast(both))
        # two short scans: the coarse bounds up to the id, then the fine ones behind the last of those
        block = F.size(F.filter("coarse", lambda b: b <= F.col("doc_id")))
        fine = F.size(F.filter(F.slice("bounds", (F.col("block") - 1) * side + 1, side), lambda b: b <= F.col("doc_id")))
        rows = rows.withColumn("block", F.coalesce(block, F.lit(0))).withColumn("range", F.when(F.col("block") > 0, (F.col("block") - 1) * side + fine).otherwise(0)).drop("coarse", "bounds", "block")
    else:
        rows = rows.withColumn("range", F.lit(0))
    # a row a range, without texts: its first document and the range before it, the last one for the very first
    named = rows.select("range", F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", F.xxhash64("text").alias("hash")).alias("d"))
    starts = named.groupBy("range").agg(F.min("d").alias("d"))
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy()))
    starts = staged(starts.select(F.col("range").alias("s_range"), F.col("d.doc_id").alias("s_id"), F.col("d.hash").alias("s_hash"), before.alias("to")))
    starting = (F.col("range") == F.col("s_range")) & F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.xxhash64("text") == F.col("s_hash"))
    rows = rows.join(F.broadcast(starts), starting, "left")
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    places = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("range"), F.lit(True).alias("guest"))))
    return rows.select("doc_id", "text", F.inline(places))


def document_fingerprints(docs: DataFrame, asked: Column) -> DataFrame:
    """docs: doc_id, text -> a row for each, with the fingerprints of its text and of its edited text.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document's.  near_edited and near_next: likeness to the edited text's and the next document's
    fingerprint.  n_near: for rows for which `asked` (of doc_id) holds, how many other
    documents have a fingerprint within RADIUS bits; near_id: the smallest doc_id of those.
    """
    order = Window.partitionBy("range").orderBy("guest", F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = _ranged(docs).select("range", "guest", "doc_id", "text", F.length("text").cast("bigint").alias("n_chars"), F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("next"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), quarter))
    rows = rows.select("range", "guest", "at", "doc_id", "n_chars", "text", F.when(~F.col("guest"), edited).alias("edited"))
    versions = F.when(F.col("guest"), F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("text")))).otherwise(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("text")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text"))))
    keys = ["range", "at", "guest", "doc_id", "n_chars", "sha", "version"]
    both = rows.select("range", "at", "guest", "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"), F.inline(versions))
    prints = staged(fingerprints(both, keys))
    pair = lambda v: F.max(F.when(F.col("version") == v, F.struct("high", "low")))
    one = prints.groupBy("range", "at", "guest", "doc_id", "n_chars", "sha").agg(pair(0).alias("own"), pair(1).alias("edit"))
    one = one.withColumn("next", F.lead("own").over(Window.partitionBy("range").orderBy("at"))).where(~F.col("guest")).drop("range", "at", "guest")
    one = staged(one)
    other = lambda c: likeness(F.col("own.high"), F.col("own.low"), F.col(f"{c}.high"), F.col(f"{c}.low"))
    known = staged(one.groupBy(F.col("own.high").alias("high"), F.col("own.low").alias("low")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max(F.coalesce(asked, F.lit(False))).alias("asked")))
    met = near(known, known.where("asked")).join(known.select("high", "low", "n", "first"), ["high", "low"])
    around = met.groupBy(F.col("q_high").alias("high"), F.col("q_low").alias("low")).agg(F.sum("n").alias("others"), F.min("first").alias("other_first"))
    copies = known.where("asked").join(around, ["high", "low"], "left")
    looked = one.where(asked).select("doc_id", "own").distinct()
    # the smallest other id among a document's own copies: the smallest of all, or the next one where that is its own
    second = one.select("own", "doc_id").join(copies.select(F.struct("high", "low").alias("own"), "first"), "own").where("doc_id <> first").groupBy("own").agg(F.min("doc_id").alias("second"))
    copies = copies.select(F.struct("high", "low").alias("own"), "n", "first", "others", "other_first")
    answer = looked.join(copies, "own").join(second, "own", "left")
    copy_id = F.when(F.col("first") != F.col("doc_id"), F.col("first")).otherwise(F.col("second"))
    answer = answer.select("doc_id", "own", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), F.least(copy_id, "other_first").alias("near_id"))
    print_of = lambda c: as_text(F.col(f"{c}.high"), F.col(f"{c}.low"))
    return one.join(answer, ["doc_id", "own"], "left").select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), print_of("own").alias("fingerprint"), print_of("edit").alias("edited_fingerprint"), other("edit").alias("near_edited"), other("next").alias("near_next"), "n_near", "near_id")
