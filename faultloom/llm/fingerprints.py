"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame functions only.

A text is the set of its paragraphs (lines, and sentences within lines), each a 64-bit hash. A sketch
has three tables of cells; every hash is added to one cell of each: count, xor of the hashes, xor of
their check values. Empty cells are not kept. The difference of two sketches is taken cell by cell:
what both texts have cancels out. A cell left with one hash (its check value says so) gives up that
hash, which is then taken from its other cells, until the difference is empty; what was given up are
the paragraphs of one text only. When cells remain with several hashes each, both sketches are made
anew, larger by GROWTH, and tried again. Likeness is shared paragraphs over all paragraphs.

Sketches of all pairs are built, subtracted and peeled together: a cell is a row, adding is grouping,
and a round of peeling lets each table in turn give up its single hashes as rows that cancel cells.
All rounds run on rows dealt by document id, after one shuffle of the texts. The first size has twice
as many cells as the pair has paragraphs; the few pairs that are not empty after ROUNDS are retried
with larger sketches within their row. To find the next document, only ids are put in order, by
ranges, with one boundary row a range; a text lends its neighbour no more than it takes.

Defined cases: a null text is empty, an empty text has no paragraphs; two texts without any are
alike (1.0). The next document is the one with the next smaller id, after the smallest the largest;
a single document is next to itself. Of rows with equal ids the one with the smallest text counts.
Rows with a null id have no place in the order and give no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .steps import keyed, settle

CELLS = 8  # a table of a fingerprint
GROWTH = 4
TABLES = 3
ROUNDS = 15
PARAGRAPH_END = r"\n+|(?<=[.!?])[ \t]+"
_CELL = "struct<cell:int,n:int,key:bigint,check:bigint>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def paragraph_keys(text: Column) -> Column:
    """Distinct paragraph hashes of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, PARAGRAPH_END), lambda p: p != ""), lambda p: F.xxhash64(p)))


def _cell(cell, n, key, check) -> Column:
    return F.struct(cell.cast("int").alias("cell"), n.cast("int").alias("n"), key.alias("key"), check.alias("check"))


def _check(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(-1)), 32)


def _entries(keys: Column, width: Column, n: int) -> Column:
    """For every key its cell in each table of so many cells, holding n times the key."""

    def of(key):
        return F.array(*(
            _cell(F.pmod(F.xxhash64(key, width, F.lit(t)), width.cast("long")) + width * t, F.lit(n), key, _check(key))
            for t in range(TABLES)
        ))

    return F.flatten(F.transform(keys, of))


def _merged(entries: Column) -> Column:
    """Cells in order of their number, entries of one cell added up, empty cells left out."""

    def live(c):
        return (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0)

    def flushed(s):
        return F.when(live(s["last"]), F.concat(s["done"], F.array(s["last"]))).otherwise(s["done"])

    def step(s, e):
        last = s["last"]
        added = _cell(e["cell"], last["n"] + e["n"], last["key"].bitwiseXOR(e["key"]), last["check"].bitwiseXOR(e["check"]))
        return F.when(last["cell"] == e["cell"], F.struct(s["done"].alias("done"), added.alias("last"))).otherwise(
            F.struct(flushed(s).alias("done"), e.alias("last"))
        )

    zero = F.lit(0).cast("long")
    start = F.struct(F.array().cast(f"array<{_CELL}>").alias("done"), _cell(F.lit(-1), F.lit(0), zero, zero).alias("last"))
    return F.aggregate(F.array_sort(entries), start, step, flushed)


def sketch(keys: Column, width: Column) -> Column:
    return _merged(_entries(keys, width, 1))


def subtracted(a: Column, b: Column) -> Column:
    """Cells of sketch a less those of b."""
    return _merged(F.concat(a, F.transform(b, lambda c: _cell(c["cell"], -c["n"], c["key"], c["check"]))))


def _peeled(cells: Column, width: Column) -> Column:
    """How many hashes a difference gives up before it is empty; -1 if it doesn't get empty."""

    def alone(state, n):
        held = F.filter(state["cells"], lambda c: (c["n"] == n) & (c["check"] == _check(c["key"])))
        return F.array_distinct(F.transform(held, lambda c: c["key"]))

    def round_(state, _):
        both = F.struct(alone(state, 1).alias("plus"), alone(state, -1).alias("minus"))
        return let(both, lambda p: F.when(F.size(p["plus"]) + F.size(p["minus"]) == 0, state).otherwise(F.struct(
            _merged(F.concat(state["cells"], _entries(p["plus"], width, -1), _entries(p["minus"], width, 1))).alias("cells"),
            (state["found"] + F.size(p["plus"]) + F.size(p["minus"])).alias("found"),
        )))

    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda s: F.when(F.size(s["cells"]) == 0, s["found"]).otherwise(F.lit(-1))
    )


def difference(a: Column, b: Column) -> Column:
    """How many paragraph hashes only one of two sets has, recovered from sketches.

    Tables grow until the difference peels off; from four sizes on (which all but never happens) the
    sets themselves are compared.
    """
    first = first_width(F.size(a) + F.size(b))

    def attempt(level):
        width = (first * F.pow(F.lit(GROWTH), level)).cast("int")
        return let(width, lambda w: _peeled(subtracted(sketch(a, w), sketch(b, w)), w))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.lit(-1), lambda d, level: F.when(d >= 0, d).otherwise(attempt(level)))
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return let(found, lambda d: F.when(d >= 0, d).otherwise(exact))


def first_width(total: Column) -> Column:
    """Cells a table for two sets with so many hashes together."""
    return (total * 2 / TABLES).cast("int") + CELLS


def next_ids(ids: DataFrame) -> DataFrame:
    """_id, next: for every id (they are distinct) the next smaller one, for the smallest the largest.

    Ids are dealt out by ranges and looked up within their range; the ends of the ranges, one row
    each, are put in order on their own.
    """
    ranged = settle(ids.select("_id").repartitionByRange("_id").withColumn("_range", F.spark_partition_id()), "ids")
    own = Window.partitionBy("_range").orderBy("_id")
    ends = ranged.groupBy("_range").agg(F.max("_id").alias("largest"))
    below = ends.select("_range", F.lag("largest").over(Window.orderBy("_range")).alias("below"))
    top = ranged.agg(F.max("_id").alias("m")).first()["m"]
    return (
        ranged.withColumn("before", F.lag("_id").over(own))
        .join(below, "_range")
        .select("_id", F.coalesce("before", "below", F.lit(top).cast("long")).alias("next"))
    )


def one_row_an_id(source: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of repeated ids give way to the one with the smallest text. ids: _id, rows."""
    repeated = settle(ids.where("rows > 1").select("_id"), "repeated")
    if repeated.isEmpty():
        return source
    one = source.join(repeated, "_id").groupBy("_id").agg(F.min("_text").alias("_text"))
    return source.join(repeated, "_id", "left_anti").unionByName(one)


def _edited(source: DataFrame, chain: DataFrame) -> DataFrame:
    taken = chain.select(F.col("next").alias("_id"), F.col("_id").alias("asker"), F.expr("n div 3").cast("int").alias("take"))
    lent = source.join(taken, "_id").select(
        F.col("asker").alias("_id"), F.left("_text", F.col("take")).alias("_lent"), paragraph_keys(F.col("_text")).alias("next")
    )
    third = F.expr("n_chars div 3").cast("int")
    edited = F.concat(F.left("_text", F.col("n_chars").cast("int") - third), F.left("_lent", third))
    joined = source.join(lent, "_id").withColumn("n_chars", F.length("_text").cast("long")).withColumn("_edited", edited)
    return joined.select(
        "_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        paragraph_keys(F.col("_text")).alias("own"), paragraph_keys(F.col("_edited")).alias("edited"), "next",
    )


#: kinds of sketches of a document: fingerprints of both texts, differences from both other texts
OWN, EDITED, FROM_EDITED, FROM_NEXT = range(4)


def _cells(rows: DataFrame) -> DataFrame:
    """_id, kind, width, cell, n, key, check of the sketches of all kinds, empty cells left out."""
    none = F.array().cast("array<bigint>")

    def kind(number, width, plus, minus):
        return F.struct(F.lit(number).alias("kind"), width.cast("int").alias("width"), plus.alias("plus"), minus.alias("minus"))

    own, edited, following = F.col("own"), F.col("edited"), F.col("next")
    kinds = F.array(
        kind(OWN, F.lit(CELLS), own, none), kind(EDITED, F.lit(CELLS), edited, none),
        kind(FROM_EDITED, first_width(F.size(own) + F.size(edited)), own, edited),
        kind(FROM_NEXT, first_width(F.size(own) + F.size(following)), own, following),
    )
    signed = lambda keys, n: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(n).alias("n")))
    hashes = (
        rows.select("_id", F.inline(kinds))
        .select("_id", "kind", "width", F.inline(F.concat(signed(F.col("plus"), 1), signed(F.col("minus"), -1))))
        .withColumn("t", F.explode(F.array(*map(F.lit, range(TABLES)))))
    )
    return _added(hashes.select("_id", "kind", "width", _place(F.col("key"), F.col("t")).alias("cell"), "n", "key", _check(F.col("key")).alias("check")))


def _place(key: Column, table: Column) -> Column:
    width = F.col("width")
    return (F.pmod(F.xxhash64(key, width, table), width.cast("long")) + width * table).cast("int")


def _added(cells: DataFrame) -> DataFrame:
    sums = cells.groupBy("_id", "kind", "width", "cell").agg(
        F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check")
    )
    return sums.where("n <> 0 or key <> 0 or check <> 0")


def _round(cells: DataFrame, table: int) -> DataFrame:
    """One table gives up its single hashes; cell -1 of a sketch counts them."""
    key, n, zero = F.col("key"), F.col("n"), F.lit(0).cast("long")
    single = (
        (F.col("kind") >= FROM_EDITED) & (F.abs(n) == 1) & (F.col("cell") >= F.col("width") * table)
        & (F.col("cell") < F.col("width") * (table + 1)) & (F.col("check") == _check(key))
    )

    def row(cell, n, key, check):
        return F.struct(cell.cast("int").alias("cell"), n.cast("long").alias("n"), key.alias("key"), check.alias("check"))

    self_ = row(F.col("cell"), n, key, F.col("check"))
    gone = [row(_place(key, F.lit(t)), -n, key, F.col("check")) for t in range(TABLES)]
    counted = row(F.lit(-1), F.lit(1), zero, zero)
    rows = F.when(single, F.array(self_, *gone, counted)).otherwise(F.array(self_))
    return _added(cells.select("_id", "kind", "width", F.inline(rows)))


def _likeness(total: Column, differing: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise((total - differing) / (total + differing))


def compare(rows: DataFrame) -> DataFrame:
    """Fingerprints and likenesses from the rows of _edited; likeness is null where peeling failed."""
    cells = _cells(rows)
    for r in range(ROUNDS):
        cells = _round(cells, r % TABLES)

    def text(kind):
        cell = F.struct("cell", F.concat_ws("-", F.col("cell").cast("string"), F.col("n").cast("string"), F.hex("key"), F.hex("check")).alias("s"))
        listed = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, cell)))
        return F.array_join(F.transform(listed, lambda c: c["s"]), " ")

    def found(kind):
        mine = F.col("kind") == kind
        left = F.count(F.when(mine & (F.col("cell") >= 0), 1))
        return F.when(left == 0, F.coalesce(F.max(F.when(mine & (F.col("cell") < 0), F.col("n"))), F.lit(0)))

    made = cells.groupBy("_id").agg(
        text(OWN).alias("f"), text(EDITED).alias("e"), found(FROM_EDITED).alias("de"), found(FROM_NEXT).alias("dn"), F.lit(True).alias("any")
    )
    info = rows.select(
        "_id", "n_chars", "edited_sha256", F.size("own").alias("a"), F.size("edited").alias("b"), F.size("next").alias("c")
    )
    named = lambda n, f: F.concat_ws(" ", F.col(n).cast("string"), F.coalesce(f, F.lit("")))
    # a document without any paragraph has no cells
    d = lambda c: F.when(F.col("any").isNull(), F.lit(0)).otherwise(F.col(c))
    return info.join(made, "_id", "left").select(
        "_id", "n_chars", "edited_sha256", named("a", F.col("f")).alias("fingerprint"), named("b", F.col("e")).alias("edited_fingerprint"),
        _likeness(F.col("a") + F.col("b"), d("de")).alias("near_edited"), _likeness(F.col("a") + F.col("c"), d("dn")).alias("near_next"),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    source = keyed(docs, id_col, text_col).where("_id is not null").select("_id", F.coalesce("_text", F.lit("")).alias("_text"))
    ids = settle(source.groupBy("_id").agg(F.count("*").alias("rows"), F.max(F.length("_text")).alias("n")), "ids")
    source = one_row_an_id(source, ids)
    chain = settle(next_ids(ids).join(ids, "_id"), "chain")
    done = settle(compare(_edited(source, chain)), "fingerprints")
    failed = settle(done.where("near_edited is null or near_next is null").select("_id"), "failed")
    if failed.isEmpty():
        return done
    again = settle(chain.join(failed, "_id"), "again")
    needed = again.select("_id").union(again.select("next")).distinct()
    rows = _edited(source.join(needed, "_id", "left_semi"), again)
    own, edited, following = F.col("own"), F.col("edited"), F.col("next")
    larger = settle(rows.select(
        "_id", _likeness(F.size(own) + F.size(edited), difference(own, edited)).alias("e"),
        _likeness(F.size(own) + F.size(following), difference(own, following)).alias("n"),
    ), "larger")
    return done.join(larger, "_id", "left").select(
        *done.columns[:5], F.coalesce("near_edited", "e").alias("near_edited"), F.coalesce("near_next", "n").alias("near_next")
    )


def report(docs: DataFrame) -> DataFrame:
    """op4: fingerprints of all documents and their edited texts, and likenesses."""
    return fingerprints(docs).withColumnRenamed("_id", "doc_id")
