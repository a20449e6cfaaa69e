"""I-Match fingerprints over an inverse-document-frequency band and randomised lexicon subsets.

Terms are maximal runs of letters and digits, lower-cased.  The lexicon holds
the terms whose share of documents lies between MIN_SHARE and MAX_SHARE, that
is, an idf between ln(1/MAX_SHARE) and ln(1/MIN_SHARE); the lower bound keeps
it below (mean distinct terms of a document) / MIN_SHARE entries however many
documents there are.  It is held as 2**SLOT_BITS slots, each with all the hashes
that fall into it.

A fingerprint is a list of hashes, each of the sorted distinct lexicon terms
that fall into one randomised subset.  Subsets are small and come in several
sizes, so that for short and long texts alike many hold a term or two of a text.
A text with fewer than MIN_TERMS lexicon terms is fingerprinted over all its
distinct terms, one without terms over its whole text; an empty text has only
empty subsets.  Likeness is the share of equal hashes among subsets that aren't
empty in both (1 if all are).

Null texts count as empty.  Rows are fingerprinted one by one; repeated rows
count in the lexicon as often as they stand there.  Rows with equal keys are
ordered by their values.  The columns these functions add replace none of the
caller's, but for `out` itself and next_<value>.

Only column expressions: statistics, look-up and hashing run in the JVM.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.llm.native import in_slots, slot_table
from cityloom.session import fresh, stored

MIN_SHARE, MAX_SHARE = 0.002, 0.3
SLOT_BITS = 18
MIN_TERMS = 4
#: A term falls into one of so many cells; the first SIDE * SIDE of them are subsets.  With the first spread every term is in one.
SPREADS, SIDE = (64, 256), 8
#: Bytes of text that a task of with_next() orders.
BLOCK_BYTES = 64 << 20


def term_hashes(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of a text's terms."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.xxhash64(t))))


def lexicon(df: DataFrame, text: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """One row: the slots of the terms within the band, counted over every row of df."""
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("_t"))
    counts = rows.select(F.explode(term_hashes(F.col("_t"))).alias("_term")).groupBy("_term").agg(F.count(F.lit(1)).alias("_docs"))
    total = df.count()
    band = counts.filter((F.col("_docs") >= min_share * total) & (F.col("_docs") <= max_share * total)).select("_term")
    return slot_table(band, SLOT_BITS)


def signatures(known: Column, text: Column) -> Column:
    """Array of subset hashes (0: empty subset) of a text, given the sorted hashes of its lexicon terms."""

    def cell(h: Column, level: int) -> Column:
        return F.shiftright(h, 20 + 10 * level).bitwiseAND(F.lit(SPREADS[level] - 1))

    def of_level(kept: Column, level: int) -> Column:
        # rows of cells first, then cells, so that a term is looked at 2 * SIDE times; arrays of one element bind what is used again
        side = F.sequence(F.lit(0).cast("bigint"), F.lit(SIDE - 1).cast("bigint"))
        bits = SIDE.bit_length() - 1
        few = F.filter(kept, lambda h: cell(h, level) < SIDE * SIDE) if SPREADS[level] > SIDE * SIDE else kept
        rows = F.get(F.transform(F.array(few), lambda f: F.transform(side, lambda a: F.filter(f, lambda h: F.shiftright(cell(h, level), bits) == a))), 0)
        return F.flatten(F.transform(rows, lambda r: F.transform(side, lambda b: F.filter(r, lambda h: cell(h, level).bitwiseAND(F.lit(SIDE - 1)) == b))))

    def hashed(kept: Column) -> Column:
        return F.flatten(F.array(*[of_level(kept, level) for level in range(len(SPREADS))]))

    def instead() -> Column:  # evaluated for the few texts with hardly a lexicon term
        return F.get(F.transform(F.array(term_hashes(text)), lambda t: F.when(F.size(t) > 0, t).when(F.length(text) > 0, F.array(F.xxhash64(text))).otherwise(t)), 0)

    # a one-element array binds a value that several lambdas use
    chosen = F.array(F.when(F.size(known) >= MIN_TERMS, known).otherwise(instead()))
    sets = F.get(F.transform(chosen, hashed), 0)
    return F.transform(sets, lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF))).cast("bigint"))


def likeness(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(0)).when(x == y, F.lit(1001)).otherwise(F.lit(1000)))
    total = F.aggregate(both, F.lit(0), lambda s, x: s + x)
    same, used = total % 1000, F.floor(total / 1000)
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used).cast("double")


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprints(df: DataFrame, slots: DataFrame, text: str = "text", out: str = "signature") -> DataFrame:
    """df with the signature of its text; `slots` from lexicon()."""
    # The look-up table is named once, in the projection right below its only use, so that the
    # optimizer makes one projection of the two and no row ever carries the table.  The second
    # use of the text, its length, keeps that projection apart from what computes the text.
    s, n, k = fresh(df, "_slots", "_n", "_known")
    body = F.coalesce(F.col(text), F.lit(""))
    below = df.withColumns({s: slots.scalar(), n: F.coalesce(F.octet_length(text), F.lit(0))})
    known = F.when(F.col(n) > 0, F.filter(term_hashes(body), lambda h: in_slots(F.col(s), SLOT_BITS, h))).otherwise(F.array().cast("array<bigint>"))
    return below.withColumn(k, known).drop(s, n).withColumn(out, signatures(F.col(k), body)).drop(k)


def blocks(df: DataFrame, key: str, count: int) -> Column:
    """Number of the key range (of about `count`, equal in rows) that a row falls into, descending keys.

    Bounds are quantiles of the key column alone; they are found level by level,
    so that a row is compared with few of them.
    """
    got = df.select(F.percentile_approx(key, [i / count for i in range(1, count)], max(10_000, 20 * count)).alias("b")).first()["b"] if count > 1 else []
    bounds = sorted(set(got or []), reverse=True)
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    kind, k = df.schema[key].dataType.simpleString(), F.col(key)
    # one literal each, folded before the query runs: thousands of bounds don't swell the plan
    heads = F.from_json(F.lit(json.dumps([g[-1] for g in groups], default=str)), f"array<{kind}>")
    parts = F.from_json(F.lit(json.dumps(groups, default=str)), f"array<array<{kind}>>")
    group = F.size(F.filter(heads, lambda b: b > k))
    inside = F.coalesce(F.size(F.filter(F.get(parts, group), lambda b: b > k)), F.lit(0))
    return F.when(k.isNull(), F.lit(len(bounds) + 1)).otherwise(group * step + inside)


def with_next(df: DataFrame, key: str, values: list[str], count: int | None = None) -> DataFrame:
    """df with next_<value>: that of the row after it in descending key order, the first row after the last.

    One shuffle by key range and a window inside each range; what lies beyond a
    range's end is the head of the next range that has rows, fetched from a table
    with a row a range.  There are as many ranges and tasks as the first value's
    bytes need, so that a task's share doesn't grow with the data.
    """
    if count is None:
        size = df.agg(F.sum(F.octet_length(F.col(values[0]).cast("string"))).alias("b")).first()["b"] or 0
        count = max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    block, last, head, nxt = fresh(df, "_block", "_last", "_head", "_next")
    placed = df.withColumn(block, blocks(df, key, count))
    order = [F.col(key).desc_nulls_last(), *[F.col(v).asc_nulls_first() for v in values]]
    w = Window.partitionBy(block).orderBy(*order)
    inner = placed.repartition(count, block).withColumns({last: F.lead(F.lit(1)).over(w).isNull(), **{f"next_{v}": F.lead(v).over(w) for v in values}})
    # a range's head: its first row in the order
    top = placed.groupBy(block).agg(F.min(F.struct(F.when(F.col(key).isNull(), 1).otherwise(0).alias("n"), (-F.col(key)).alias("k"), *values)).alias(head))
    heads = stored(top, "block-heads")
    row = Window.orderBy(block)  # a row a range
    follow = heads.select(block, F.lead(block).over(row).alias(nxt))
    first = heads.agg(F.min(block).alias("_first"))
    ahead = follow.withColumn(nxt, F.coalesce(nxt, first.scalar())).join(heads.select(F.col(block).alias(nxt), head), nxt).select(block, F.lit(True).alias(last), head)
    return inner.join(ahead, [block, last], "left").withColumns({f"next_{v}": F.when(F.col(last), F.col(head)[v]).otherwise(F.col(f"next_{v}")) for v in values}).drop(block, last, head)
