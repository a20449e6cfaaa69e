"""Benchmark decontamination by template canonicalisation.

Texts are tokenised into lower-cased words, numbers and unit signs.  Numbers,
names (capitalised words inside a sentence, and those elsewhere that aren't
STARTERS) and units become typed placeholders.  Windows of WINDOW tokens of benchmark items and documents meet in
a hash join, both as templates and literally; what joins is compared token by
token.  Hits on one diagonal (document position minus item position) form an
alignment.  A hit that is only a template counts if its alignment's slots are
consistent: each item value stands for one document value and the other way
round, so a question whose numbers were swapped is caught and a coincidence of
placeholders isn't.

A document is contaminated by an item if aligned hits cover at least MIN_COVER
of the item's windows, or if MIN_RUN consecutive tokens agree.

Texts with fewer than WINDOW tokens form one window of their own length; texts
without tokens (null, empty) are never contaminated and contaminate nothing.
Windows with fewer than MIN_LITERAL words that aren't placeholders are no
evidence as templates; on an alignment that other hits anchor they count where
the template agrees and the slots of all its windows are consistent.  Rows that share a doc_id are judged together; repeated
items and repeated rows change nothing.  Of equal windows every one meets its item, so that ties need no order.

Only column expressions.  A bit table of the benchmark's window hashes (fixed
size) drops nearly all document windows before they become rows; the join
decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.llm.native import bit_table, in_bits
from cityloom.session import fresh, maybe_broadcast, stored

WINDOW, MIN_LITERAL = 5, 3
MIN_COVER, MIN_RUN = 0.8, 13
#: An alignment with fewer hits is chance.
MIN_ALIGNED = 2
TABLE_BITS = 22

# Words for numbers and units that the canonical form replaces.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split()
UNIT_WORDS = "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh percent cent cents dollar dollars euro euros yen degree degrees % $ € £ °".split()
TOKEN = r"\p{L}[\p{L}\p{M}'’]*|\p{N}+(?:[.,]\p{N}+)*|[%$€£°]"
#: Placeholders hold characters that no token has.
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Words that are no names at the start of a sentence, a line or a quotation.
STARTERS = "A About After All Also Although An And Any Are As At Because Before Both But By Calculate Can Choose Compute Consider Could Determine Did Do Does During Each Either Every Explain Find For From Give Given Had Has Have He Her Here His How However If In Is It Its Let Many More Most My Neither Next No None Not Now Of On One Or Our Out Over She Should Show Since So Solve Some State Suppose That The Their Them Then There These They This Those Through To Two Under Until Up Use Was We Were What When Where Which While Who Whom Whose Why Will With Would Write You Your".split()
STARTERS += "Al Algunos Aunque Como Con Cuando Cuál Cuánto Cuántos De Del Desde Donde El Ella En Es Esta Este Están Hay La Las Lo Los Mientras No Para Pero Por Porque Qué Quién Se Si Sin Sobre Su Sus También Todos Un Una Unos Ya".split()
STARTERS += "Alors Après Au Aux Avec Avant Ce Ces Cette Chaque Chez Combien Comme Comment Dans Des Donc Du Elle Elles En Est Et Il Ils Je Le Les Leur Lorsque Mais Nous On Où Par Pendant Pour Pourquoi Quand Que Quel Quelle Qui Sa Sans Ses Son Sur Tous Tout Une Vous".split()
STARTERS += "Aber Alle Als Am An Auch Auf Aus Bei Bis Das Dass Dem Den Der Des Die Dies Diese Dieser Durch Ein Eine Einem Einen Einer Er Es Für Hat Ich Ihr Im In Ist Jede Jeder Kann Man Mit Nach Nicht Nun Oder Sie Sind So Und Vom Von Vor Wann War Warum Was Welche Wenn Wer Wie Wieviel Wir Wird Wo Zu Zum Zur".split()
STARTERS += [w.capitalize() for w in NUMBER_WORDS + UNIT_WORDS if w.isalpha()]
#: A letter that hardly a text has stands before a name while tokens are made.
MARK = "\ua78f"


def one_of(words: list[str]) -> str:
    """Pattern of these words that branches letter by letter, so that a text isn't compared with each of them."""
    follow: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        follow.setdefault(w[:1], []).append(w[1:])
    ends = "" in follow
    parts = [c + one_of(rest) for c, rest in follow.items() if c]
    return "(?:" + "|".join(parts) + ")" + ("?" if ends else "") if parts else ""


NAMED = r"(?=\p{Lu}\p{Ll})(?:(?<=[\p{Ll}\p{N},;:] )|(?<![\p{L}\p{M}'’])(?!" + one_of(STARTERS) + r"(?![\p{L}\p{M}])))\p{Lu}\p{Ll}+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def marked_names(text: Column) -> Column:
    """A capitalised word after a lower-case one or a comma is a name, elsewhere unless it is a usual first word; MARK is put before it."""
    return F.regexp_replace(text, NAMED, MARK + "$0")


def unmarked(t: Column) -> Column:
    return F.when(t.startswith(MARK), F.substring(t, 2, 1 << 30)).otherwise(t)


def canonical(t: Column, number, unit, name, other) -> Column:
    """One of four values for a token: which placeholder it becomes, or `other`."""
    kind = F.when((t >= "0") & (t < ":") | t.isin(NUMBER_WORDS), number).when(t.isin(UNIT_WORDS), unit).when(t.startswith(MARK), name).otherwise(other)
    # most tokens are told to be none of these by one look-up and two comparisons
    return F.when(t.isin(NUMBER_WORDS + UNIT_WORDS) | (t < ":") | (t >= MARK), kind).otherwise(other)


def literal(marked: Column) -> Column:
    return F.transform(marked, unmarked)


def placeholders(marked: Column) -> Column:
    return F.transform(marked, lambda t: canonical(t, NUMBER, UNIT, NAME, t))


def window_hash(h: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])


def starts(h: Column) -> Column:
    n = F.size(h)
    return F.when(n > WINDOW, F.sequence(F.lit(0), n - WINDOW)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def starts_with_slot(hl: Column, ht: Column) -> Column:
    """Of starts() those whose window holds a placeholder: where the hashes of literal and canonical tokens differ.

    Neither array is named within a lambda, so that none is made anew for each element.
    """
    slots = F.array_compact(F.transform(F.zip_with(hl, ht, lambda a, b: a != b), lambda d, i: F.when(d, i)))
    near = lambda p, n: F.sequence(F.greatest(p - (WINDOW - 1), F.lit(0)), F.least(p, F.greatest(n - WINDOW, F.lit(0))))
    once = F.array(F.struct(slots.alias("slots"), F.size(hl).alias("n")))
    return F.get(F.transform(once, lambda x: F.array_distinct(F.flatten(F.transform(x["slots"], lambda p: near(p, x["n"]))))), 0)


def forms(df: DataFrame, text: str) -> DataFrame:
    """df with the marked tokens _raw and the hashes _hl and _ht of their literal and canonical forms."""
    body = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(""))
    read = df.withColumn("_raw", tokens(F.lower(marked_names(body)))).withColumn("_hl", F.transform("_raw", lambda t: F.xxhash64(unmarked(t))))
    slot = lambda p: F.xxhash64(F.lit(p))
    return read.withColumn("_ht", F.zip_with("_raw", "_hl", lambda t, h: canonical(t, slot(NUMBER), slot(UNIT), slot(NAME), h)))


def windows_at(kind: int, h: Column, places: Column) -> Column:
    """kind (0 literal, 1 template), pos, hash, literal and canonical tokens of the windows at these places."""
    cut = lambda i: F.slice(F.col("_raw"), i + 1, F.lit(WINDOW))
    return F.transform(places, lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), window_hash(h, i).alias("hash"), literal(cut(i)).alias("lit"), placeholders(cut(i)).alias("tmp")))


def as_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each entry of _w.

    explode() would have its filter on the array's size pushed below the
    projection that makes the array, and so evaluate it twice.
    """
    return df.select(*keep, F.explode_outer("_w").alias("_x")).select(*keep, "_x.*").filter("pos IS NOT NULL")


def slots_only(tmp: Column) -> Column:
    """Placeholders of a window."""
    return F.filter(tmp, lambda t: t.isin(NUMBER, NAME, UNIT))


def is_evidence() -> Column:
    """A template window with a placeholder, and words enough beside it; or a literal one."""
    n = F.size(slots_only(F.col("tmp")))
    return (F.col("kind") == 0) | ((n > 0) & (F.size("tmp") - n >= MIN_LITERAL))


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, pos, kind, hash, lit, tmp, windows, evidence: every window of every distinct item."""
    form = forms(items.select(F.col(item).alias("item"), text).distinct(), text)
    both = F.flatten(F.array(windows_at(0, F.col("_hl"), starts(F.col("_hl"))), windows_at(1, F.col("_ht"), starts(F.col("_ht")))))
    placed = form.select("item", F.size(starts(F.col("_hl"))).alias("windows"), both.alias("_w"))
    return as_rows(placed, ["item", "windows"]).withColumn("evidence", is_evidence())


def slot_pairs(item_lit: Column, lit: Column, tmp: Column) -> Column:
    """(type, a, b) of each placeholder of a window: item value a stands for document value b."""
    both = F.zip_with(F.arrays_zip(item_lit.alias("item_lit"), lit.alias("lit")), tmp, lambda x, t: F.struct(t.alias("type"), x["item_lit"].alias("a"), x["lit"].alias("b")))
    return F.filter(both, lambda p: p["type"].isin(NUMBER, NAME, UNIT))


LINE = ["key", "item", "diagonal"]


def on_line(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """a joined with b on LINE, null keys included; b's LINE goes."""
    b = b.withColumnsRenamed({c: f"_{c}2" for c in LINE})
    return a.join(b, F.col("key").eqNullSafe(F.col("_key2")) & F.col("item").eqNullSafe(F.col("_item2")) & (F.col("diagonal") == F.col("_diagonal2")), how).drop("_key2", "_item2", "_diagonal2")


def consistency(hits: DataFrame) -> DataFrame:
    """LINE and whether each item value stands for one document value there, and the other way round."""
    value = hits.select(*LINE, F.explode("pairs").alias("p")).groupBy(*LINE).agg(F.count_distinct("p.type", "p.a", "p.b").alias("n"), F.count_distinct("p.type", "p.a").alias("na"), F.count_distinct("p.type", "p.b").alias("nb"))
    return value.select(*LINE, ((F.col("n") == F.col("na")) & (F.col("n") == F.col("nb"))).alias("consistent"))


def between(kept: DataFrame, docs: DataFrame, dense: DataFrame, text: str) -> DataFrame:
    """Hits, like those of `kept`, of the windows without evidence that agree on an alignment of `kept`.

    docs (key, text), dense (item, pos, lit, tmp).  Only documents with such an alignment are read again.
    """
    anchors = kept.groupBy(*LINE, "windows").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") >= MIN_ALIGNED) | (F.col("windows") <= MIN_ALIGNED))
    d = dense.select(F.col("item").alias("_i"), F.struct(F.col("pos").alias("item_pos"), F.col("lit").alias("item_lit"), F.col("tmp").alias("item_tmp")).alias("_d"))
    asked = anchors.join(d, F.col("item").eqNullSafe(F.col("_i"))).groupBy(F.col("key").alias("_k")).agg(F.collect_list(F.struct("item", "windows", "diagonal", "_d.*")).alias("_asked"))
    asked = stored(asked, "contamination-asked")
    # the keys alone are small enough to leave the documents where they are
    few = docs.join(maybe_broadcast(asked.select(F.col("_k").alias("_ks")), 32), F.col("key").eqNullSafe(F.col("_ks")), "left_semi")
    named = few.join(asked, F.col("key").eqNullSafe(F.col("_k"))).drop("_k")
    cut = lambda x: F.slice(F.col("_raw"), x["diagonal"] + x["item_pos"] + 1, F.lit(WINDOW))
    there = F.filter("_asked", lambda x: x["diagonal"] + x["item_pos"] >= 0)
    met = forms(named, text).select("key", F.explode(F.transform(there, lambda x: F.struct(x.alias("w"), literal(cut(x)).alias("lit"), placeholders(cut(x)).alias("tmp")))).alias("_x")).select("key", "_x.w.*", "_x.lit", "_x.tmp")
    # literal ones are hits already
    met = met.filter((F.col("tmp") == F.col("item_tmp")) & (F.col("lit") != F.col("item_lit"))).groupBy("key", "item", "windows", "diagonal", "item_pos").agg(F.min(F.struct("lit", "item_lit", "tmp")).alias("w"))
    return met.select("key", "item", "windows", "diagonal", "item_pos", F.lit(1).alias("kind"), slot_pairs(F.col("w.item_lit"), F.col("w.lit"), F.col("w.tmp")).alias("pairs"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, coverage, run, template): a row for each document and item that contaminates it."""
    every = stored(benchmark_windows(items, item, item_text), "benchmark-windows")
    bench = every.filter("evidence")
    bits = stored(bit_table(bench.select("hash").distinct(), TABLE_BITS), "benchmark-bits")
    plain = docs.select(F.col(key).alias("key"), text)
    form = forms(plain, text)
    # The table is named once right below its use, so that no row carries it; the token hashes'
    # second use keeps this projection apart from the tokenisation.  Windows without a placeholder
    # are the same in both forms and looked for literally.
    hl, ht = F.col("_hl"), F.col("_ht")
    both = F.array(F.struct(hl.alias("h"), starts(hl).alias("at")), F.struct(ht.alias("h"), starts_with_slot(hl, ht).alias("at")))
    below = form.withColumns({"_bits": bits.scalar(), "_hs": both})
    sieve = F.transform(F.col("_hs"), lambda x: F.filter(x["at"], lambda i: in_bits(F.col("_bits"), TABLE_BITS, window_hash(x["h"], i))))
    sieved = below.withColumn("_hit", sieve)
    seen = sieved.select("key", F.flatten(F.array(windows_at(0, hl, F.get("_hit", 0)), windows_at(1, ht, F.get("_hit", 1)))).alias("_w"))
    mine = as_rows(seen, ["key"]).filter(is_evidence())

    small = maybe_broadcast(bench.select(F.col("hash"), F.col("kind"), F.col("item"), F.col("windows"), F.col("pos").alias("item_pos"), F.col("lit").alias("item_lit"), F.col("tmp").alias("item_tmp")), 400)
    met = mine.join(small, ["hash", "kind"]).filter(F.when(F.col("kind") == 0, F.col("lit") == F.col("item_lit")).otherwise(F.col("tmp") == F.col("item_tmp")))
    # the same place may meet literally and as a template: once, as literal
    hits = met.groupBy("key", "item", "windows", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos").agg(F.min("kind").alias("kind"), F.min(F.struct("lit", "item_lit", "tmp")).alias("w"))
    hits = stored(hits.withColumn("pairs", slot_pairs(F.col("w.item_lit"), F.col("w.lit"), F.col("w.tmp"))).drop("w"), "contamination-hits")
    kept = on_line(hits, consistency(hits), "left").filter((F.col("kind") == 0) | F.coalesce("consistent", F.lit(False))).drop("consistent")
    kept = stored(kept, "contamination-kept")
    found = kept.unionByName(stored(between(kept, plain, every.filter("NOT evidence"), text), "contamination-between").withColumn("_more", F.lit(True)), allowMissingColumns=True)
    # where the windows between don't fit the others, only they go
    agreed = consistency(found).filter("consistent").drop("consistent")
    kept = found.filter("_more IS NULL").unionByName(on_line(found.filter("_more"), agreed, "left_semi")).drop("_more")
    # runs of consecutive windows on a diagonal
    w = Window.partitionBy(*LINE).orderBy("item_pos")
    runs = kept.withColumn("_run", F.col("item_pos") - F.row_number().over(w)).groupBy(*LINE, "windows", "_run").agg(F.count(F.lit(1)).alias("_n"), F.max("kind").alias("_kind"), F.collect_set("item_pos").alias("_at"))
    aligned = runs.withColumn("_line", F.sum("_n").over(Window.partitionBy(*LINE))).filter((F.col("_line") >= MIN_ALIGNED) | (F.col("windows") <= MIN_ALIGNED))
    judged = aligned.groupBy("key", "item", "windows").agg((F.max("_n") + F.lit(WINDOW - 1)).cast("int").alias("run"), F.size(F.array_distinct(F.flatten(F.collect_set("_at")))).alias("_covered"), (F.max("_kind") == 1).alias("template"))
    verdict = judged.withColumn("coverage", (F.col("_covered") / F.col("windows")).cast("double")).filter((F.col("coverage") >= MIN_COVER) | (F.col("run") >= MIN_RUN))
    return verdict.select(F.col("key").alias(key), F.col("item").alias(item), "coverage", "run", "template")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates."""
    (k,) = fresh(docs, "_key")
    found = contamination(docs, items, key, text, **names).select(F.col(key).alias(k)).distinct()
    # few rows as a rule, yet measured: beyond the limit the documents are shuffled by key
    found = maybe_broadcast(stored(found, "contaminated"), 32)
    return docs.join(found, F.col(key).eqNullSafe(F.col(k)), "left_anti")


def marked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """docs with contaminated, item_ids (sorted), coverage and run of the worst item, and template (slots differ).

    Columns of docs that have these names are replaced.
    """
    item = names.get("item", "item_id")
    found = contamination(docs, items, key, text, **names)
    each = found.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set(item)).alias("item_ids"), F.max("coverage").alias("coverage"), F.max("run").alias("run"), F.max("template").alias("template"))
    # few rows as a rule, yet measured: beyond the limit the documents are shuffled by key
    each = maybe_broadcast(stored(each, "contaminated"), 200)
    plain = docs.drop("contaminated", "item_ids", "coverage", "run", "template")
    kind = dict(items.dtypes)[item]
    joined = plain.join(each, plain[key].eqNullSafe(each["_key"]), "left")
    return joined.withColumn("contaminated", F.col("run").isNotNull()).withColumns({"item_ids": F.coalesce("item_ids", F.array().cast(f"array<{kind}>")), "coverage": F.coalesce("coverage", F.lit(0.0)), "run": F.coalesce("run", F.lit(0)), "template": F.coalesce("template", F.lit(False))}).drop("_key")
