"""A stored text index: where every token stands, laid out so that a search reads only its tokens.

A token is what stands between two blanks, so a text is its tokens in order. A pattern of one word occurs
where a token contains it; a pattern of two where a token that ends with the first is followed by one that
starts with the second; a longer one where its inner words follow each other. All that follows from (token,
id, position) rows, and no vocabulary of the texts is made when searching. Only the outer words of longer
patterns are tested on texts: on the few that hold all inner words in order.

Two tables, written once:

* `rows`: a row per token and place, by bucket of the token, equal tokens together within a file. Every task
  lays what its own texts hold, so no posting is shuffled and a token that stands in most texts is in as many
  files as there are tasks. `part` goes up with the ids:
  a search for the first k ids of each pattern reads the first rows, then more for patterns that are
  still short, so a word of most texts costs its first places instead of all of them.
* `words`: how often each token stands, filed under the token itself, runs of three characters it holds,
  and up to three that it starts or ends with, by bucket of that key. Only the counts are shuffled; the keys,
  twenty or so per token, are laid by the task that has the token.

Wildcard patterns take their longest plain run from `words` and test only the texts found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import steps
from ..sources.tables import settle
from .textmatch import _by_test, _longest, _matches_all, first_per, like_test

BUCKETS = 64
GRAM = 3
# tokens up to this length are cut into runs without a regular expression
SHORT = 64
# shares of the texts that a search for the first ids reads before all of them
SHARES = (16,)
# words shorter than a run that are looked for in one pass
SHORT_AT_ONCE = 512


@dataclass(frozen=True)
class Postings:
    """The index of one table of texts: its id columns, postings and words."""

    ids: tuple[str, ...]
    rows: DataFrame
    words: DataFrame
    steps: tuple[int, ...]
    buckets: int = BUCKETS


def _bucket(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _lay(rows: DataFrame, key: str, path: str) -> None:
    """Write rows by bucket, those of a key together within a file.

    Every task sorts and writes its own rows, by numbers instead of texts: dealing them by bucket would move
    several times the texts through shuffle files."""
    laid = rows.withColumn("_at", F.xxhash64(key)).sortWithinPartitions("bucket", "_at").drop("_at")
    laid.write.option("compression", "zstd").partitionBy("bucket").parquet(path)


def in_parts(texts: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """The texts in order of their ids over all partitions, with a number that goes up with it as part."""
    return texts.repartitionByRange(*ids).sortWithinPartitions(*ids).withColumn("part", F.monotonically_increasing_id())


def posting_rows(texts: DataFrame, ids: tuple[str, ...], text_col: str) -> DataFrame:
    """ids, part, token, position and whether it is the last of its text, for every token of every text."""
    tokens = F.split(F.col(text_col), " ")
    return texts.filter(F.col(text_col).isNotNull()).select(
        *ids, "part", F.size(tokens).alias("_n"), F.posexplode(tokens).alias("position", "token")
    ).select(*ids, "part", "token", "position", (F.col("position") == F.col("_n") - 1).alias("last"))


def _filed(tokens: DataFrame) -> DataFrame:
    """key, token, n: everything a token is filed under, once each."""
    token, sizes = F.col("token"), range(1, GRAM + 1)
    runs = [F.when(F.length(token) >= k, F.concat(F.lit("^"), F.left(token, F.lit(k)))) for k in sizes]
    runs += [F.when(F.length(token) >= k, F.concat(F.lit("$"), F.right(token, F.lit(k)))) for k in sizes]
    whole = tokens.select(F.explode(F.array(F.concat(F.lit("="), token), *runs)).alias("key"), "token", "n").filter("key is not null")
    # a run counts where it stands first; that search is kept to short tokens
    each = (
        tokens.filter(F.length(token).between(GRAM, SHORT))
        .select("token", "n", F.explode(F.sequence(F.lit(1), F.length(token) - (GRAM - 1))).alias("at"))
        .withColumn("run", F.substr(token, F.col("at"), F.lit(GRAM))).filter("instr(token, run) = at")
    )
    cut = F.regexp_extract_all(token, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    long = tokens.filter(F.length(token) > SHORT).select("token", "n", F.explode(F.array_distinct(cut)).alias("run"))
    held = each.select("run", "token", "n").unionByName(long)
    return whole.unionByName(held.select(F.concat(F.lit("~"), "run").alias("key"), "token", "n"))


def write_postings(
    texts: DataFrame, ids: tuple[str, ...], text_col: str, root: str, buckets: int = BUCKETS
) -> Postings:
    """Index the texts below root. ids must identify a text, part comes from in_parts; NULL texts have no rows."""
    spark = texts.sparkSession
    rows = posting_rows(texts, ids, text_col).withColumn("bucket", _bucket("token", buckets))
    _lay(rows, "token", f"{root}/rows")
    with steps(spark):
        stored = spark.read.schema(rows.schema).parquet(f"{root}/rows")
        counts = settle(stored.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "counts")
        words = _filed(counts).withColumn("bucket", _bucket("key", buckets))
        _lay(words, "key", f"{root}/words")
    shares = F.percentile_approx("part", [1 / n for n in SHARES], 10_000)
    texts.agg(F.coalesce(shares, F.array().cast("array<long>")).alias("steps")).write.parquet(f"{root}/steps")
    return open_postings(spark, root, ids, buckets)


def open_postings(spark: SparkSession, root: str, ids: tuple[str, ...], buckets: int = BUCKETS) -> Postings:
    """An index that write_postings wrote."""
    steps = tuple(spark.read.parquet(f"{root}/steps").first()[0])
    return Postings(tuple(ids), spark.read.parquet(f"{root}/rows"), spark.read.parquet(f"{root}/words"), steps, buckets)


def _slots(patterns: DataFrame) -> DataFrame:
    """A row per word of each pattern that says something: how it is met and the key it is filed under."""
    c = F.col
    words = F.split("pattern", " ")
    each = patterns.select("pattern", F.size(words).alias("_n"), F.posexplode(words).alias("slot", "word"))
    kind = (
        F.when(c("_n") == 1, "~").when(c("slot") == 0, "$").when(c("slot") == c("_n") - 1, "^").otherwise("=")
    )
    run = (
        F.when(kind == "=", c("word"))
        .when(kind == "$", F.right("word", F.lit(GRAM)))
        .when(kind == "^", F.left("word", F.lit(GRAM)))
        .otherwise(F.substr("word", F.greatest(F.floor((F.length("word") - GRAM) / 2).cast("int"), F.lit(0)) + 1, F.lit(GRAM)))
    )
    outer = c("kind").isin("^", "$") & ((c("word") == "") | (c("_n") > 2))
    said = each.withColumns({"kind": kind, "key": F.concat(kind, run)}).filter(~outer)
    # a blank at the end: the word before it is not the last of its text
    more = F.endswith("pattern", F.lit(" ")) & (c("slot") == c("_n") - 2)
    return said.withColumn("more", more).withColumn("slots", F.count(F.lit(1)).over(Window.partitionBy("pattern")))


def _touched(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Only the buckets that some key is in; there are at most as many values as buckets."""
    found = [r[0] for r in keys.select("bucket").distinct().collect()]
    return df.filter(F.col("bucket").isin(found)) if found else df.filter(F.lit(False))


def _held_short(words: DataFrame, asked: DataFrame) -> DataFrame:
    """Tokens that hold a word too short to be filed, by a pass over the words."""
    short = [r.word for r in asked.filter((F.col("kind") == "~") & (F.length("word") < GRAM)).select("word").distinct().collect()]
    tokens = words.filter(F.startswith("key", F.lit("="))).select("token", "n")
    out = None
    for a in range(0, len(short), SHORT_AT_ONCE):
        words = F.array(*[F.lit(w) for w in short[a : a + SHORT_AT_ONCE]])
        some = tokens.select("token", "n", F.explode(F.filter(words, lambda w: F.contains("token", w))).alias("word"))
        out = some if out is None else out.unionByName(some)
    return out if out is None else out.join(asked.filter("kind = '~'"), "word")


def _wanted(words: DataFrame, slots: DataFrame, buckets: int) -> DataFrame:
    """(pattern, slot, token) of every stored token a word can be met by, with how rare the word is."""
    c = F.col
    asked = settle(slots.withColumn("bucket", _bucket("key", buckets)), "slots")
    token, word = c("token"), c("word")
    fits = (
        F.when(c("kind") == "~", F.contains(token, word)).when(c("kind") == "$", F.endswith(token, word))
        .when(c("kind") == "^", F.startswith(token, word)).otherwise(True)
    )
    columns = ["pattern", "slot", "slots", "more", "token", "n"]
    met = _touched(words, asked).join(asked, ["bucket", "key"]).filter(fits).select(*columns)
    short = _held_short(words, asked)
    met = met if short is None else met.unionByName(short.select(*columns))
    per_word = met.groupBy("pattern", "slot").agg(F.sum("n").alias("weight"))
    rarest = per_word.groupBy("pattern").agg(
        F.min(F.struct("weight", "slot"))["slot"].alias("lead"), F.count(F.lit(1)).alias("_met")
    )
    # a pattern with a word that no token meets is nowhere
    kept = met.join(rarest, "pattern").filter(c("_met") == c("slots"))
    return settle(
        kept.select("pattern", "slot", "slots", "more", "lead", "token").withColumn("bucket", _bucket("token", buckets)),
        "wanted",
    )


def _places(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where the tokens stand, as the place the pattern would start at."""
    met = _touched(rows, wanted).join(wanted, ["bucket", "token"])
    start = met.withColumn("start", F.col("position") - F.col("slot"))
    return start.filter((F.col("start") >= 0) & ~(F.col("more") & F.col("last")))


def _found(index: Postings, rows: DataFrame, wanted: DataFrame, first: int | None, texts: DataFrame, text_col: str) -> DataFrame:
    """(ids, pattern) of the wanted patterns in some of the rows."""
    c, ids = F.col, list(index.ids)
    cut = lambda df: df if first is None else first_per(df, "pattern", ids, first)
    long = F.size(F.split("pattern", " ")) > 2
    alone = _places(rows, wanted.filter("slots = 1")).select(*ids, "pattern")
    spot = ["pattern", *ids, "start"]
    leads = settle(_places(rows, wanted.filter("slots > 1 and slot = lead")).select(*spot, "slots"), "leads")
    others = _places(rows, wanted.filter("slots > 1 and slot <> lead")).select(*spot)
    # every place has one token, so a word counts once
    whole = others.join(leads, spot).groupBy(*spot, "slots").count().filter(c("count") == c("slots") - 1)
    near = settle(alone.filter(long).unionByName(whole.filter(long).select(*ids, "pattern")).distinct(), "near")
    tested = texts.select(*ids, text_col).join(near, ids).filter(c(text_col).contains(c("pattern"))).select(*ids, "pattern")
    short = cut(alone.filter(~long)).unionByName(cut(whole.filter(~long).select(*ids, "pattern").distinct()))
    return short.unionByName(cut(tested)).distinct()


def _plain(index: Postings, patterns: DataFrame, first: int | None, texts: DataFrame, text_col: str) -> DataFrame:
    """(ids, pattern) for patterns without wildcards that have at least one word.

    With first, rows are read in rounds: ids go up with part, so a pattern that has its first ids in the
    rows so far is done. The words of an early round are those of its rows.
    """
    c, out, begin = F.col, None, None
    open_ = patterns.select("pattern")
    for end in (*(index.steps if first is not None else ()), None):
        rows = index.rows if begin is None else index.rows.filter(c("part") > begin)
        rows = rows if end is None else rows.filter(c("part") <= end)
        words = index.words
        if end is not None:
            counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
            words = settle(_filed(counts).withColumn("bucket", _bucket("key", index.buckets)), "words")
        wanted = _wanted(words, _slots(open_), index.buckets)
        hits = settle(_found(index, rows, wanted, first, texts, text_col), "hits")
        out, begin = hits if out is None else out.unionByName(hits), end
        if end is not None:
            done = out.groupBy("pattern").count().filter(c("count") >= first)
            open_ = settle(open_.join(done, "pattern", "left_anti"), "open")
    return out


def matching(
    index: Postings, texts: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str,
    like: bool = False, first: int | None = None,
) -> DataFrame:
    """textmatch.containing through the index: distinct (ids, pattern) where the text contains the pattern.

    texts are the indexed texts; only those that an index lookup leaves in doubt are tested.
    """
    c, ids = F.col, list(index.ids)
    known = settle(patterns.select(c(pattern_col).alias("pattern")).filter("pattern is not null").distinct(), "patterns")
    cut = lambda df: df if first is None else first_per(df, "pattern", ids, first)
    wild = (c("pattern").contains("%") | c("pattern").contains("_")) if like else F.lit(False)
    blank = c("pattern").isin("", " ")
    found = cut(_plain(index, known.filter(~wild & ~blank), first, texts, text_col))
    odd = known.filter(wild | blank)
    if not odd.isEmpty():
        parts = odd.withColumn("part", _longest(F.split("pattern", "[ %_]" if like else " ")))
        parts = settle(parts.withColumn("part", F.when(blank, "").otherwise(c("part"))), "parts")
        present = texts.select(*ids, text_col).filter(c(text_col).isNotNull())
        asked = parts.filter("part <> ''")
        held = _plain(index, asked.select(c("part").alias("pattern")).distinct(), None, texts, text_col).withColumnRenamed("pattern", "part")
        near = settle(held.join(asked, "part").select(*ids, "pattern"), "near")
        test = like_test(c(text_col), c("pattern"))
        found = found.unionByName(cut(present.join(near, ids).filter(test).select(*ids, "pattern")))
        found = found.unionByName(cut(_by_test(present, ids, text_col, parts, like)))
        all_ = parts.filter(_matches_all(like)).select("pattern", F.lit(0).alias("_one"))
        every = present.select(*ids) if first is None else first_per(present.select(*ids), [], ids, first)
        found = found.unionByName(every.distinct().withColumn("_one", F.lit(0)).join(all_, "_one").select(*ids, "pattern"))
    return found.distinct().withColumnRenamed("pattern", pattern_col)
