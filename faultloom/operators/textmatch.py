"""Which patterns occur in which texts, for many patterns at once and without a nested loop.

A run of characters without a blank can only occur inside one blank-separated token of a text, and
a word with a blank on either side only as a whole token. So texts meet patterns by an equality
join on tokens: directly for patterns of three words or more, else through the vocabulary of
distinct tokens. Patterns with blanks or wildcards are then tested on the text itself, in the same
pass. Patterns of blanks and wildcards only have no token; they are tested on every text.

A search for the first ids tests all patterns on the lowest ids before it looks anything up: words of
most texts are done then, and only the tokens of the others are looked up. Texts never move: lookup
tables are dealt to pieces that every task can hold, and texts are read once per piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle

# lengths of the character runs a vocabulary token is filed under
GRAM_SIZES = (1, 2, 3, 5)
# characters from which a whole word is looked up without the vocabulary
SELECTIVE = 6
# groups that texts are dealt to for patterns that offer nothing to look up
SALTS = 512
# texts of the lowest ids that every pattern is tested on, the tasks that do it, and patterns they meet at once
FIRST_TEXTS = 1 << 13
FIRST_TASKS = 32
PATTERNS_AT_ONCE = 256
# characters of a lookup table that a task holds at once, with ROW for each row
HELD = 1 << 24
ROW = 64


def like_test(body: Column, pattern: Column) -> Column:
    """body LIKE %pattern%, where only % and _ are special. A pattern without them takes the plain
    substring test: LIKE compiles an expression for every row."""
    escaped = F.replace(pattern, F.lit("\\"), F.lit("\\\\"))
    wild = F.call_function("like", body, F.concat(F.lit("%"), escaped, F.lit("%")))
    return F.when(pattern.contains("%") | pattern.contains("_"), wild).otherwise(body.contains(pattern))


def _longest(words: Column) -> Column:
    sized = F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("word")))
    return F.array_max(sized)["word"]


def _with_anchor(patterns: DataFrame, like: bool) -> DataFrame:
    """Adds what a pattern is looked up by.

    whole:  a word between two blanks of the pattern, if it is long enough to be selective. It must
            be a token of the text as it stands.
    part:   else the longest run without blanks (and wildcards), which some token must contain;
            '' if there is none.
    side:   where that token has the part: $ at its end, ^ at its start, = it is the part, ~ anywhere.
    """
    pattern, words = F.col("pattern"), F.col("_words")
    plain = lambda w: (F.length(w) >= SELECTIVE) & (~w.rlike("[%_]") if like else F.lit(True))
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), plain)
    part, loose = F.col("part"), F.size(words) == 1
    loose = loose | pattern.rlike("[%_]") if like else loose
    side = (
        F.when(loose, "~").when(F.get(words, F.lit(0)) == part, "$")
        .when(F.element_at(words, -1) == part, "^").otherwise("=")
    )
    return (
        patterns.withColumn("_words", F.split(pattern, " "))
        .withColumn("whole", _longest(inner))
        .withColumn("part", F.when(
            F.col("whole").isNull(), _longest(F.split(pattern, "[ %_]") if like else words)
        ))
        .select(
            "pattern", "whole", "part",
            (F.col("whole").isNotNull() | (F.col("part") != pattern)).alias("open"),
            F.when(F.col("part") != "", _gram_size(F.length("part"))).alias("gram_size"), side.alias("side"),
        )
    )


def _gram_size(n: Column) -> Column:
    """The largest gram size that fits into n characters."""
    size = F.lit(GRAM_SIZES[0])
    for g in GRAM_SIZES[1:]:
        size = F.when(n >= g, g).otherwise(size)
    return size


def _key_gram() -> Column:
    """The middle of the part: beginnings and endings are shared by more words."""
    part, size = F.col("part"), F.col("gram_size")
    return F.substr(part, F.floor((F.length(part) - size) / 2).cast("int") + 1, size)


def _grams(token: Column, sizes: list[int]) -> Column:
    """All distinct grams of a token; a lookahead per position keeps it linear in its length."""
    each = [F.regexp_extract_all(token, F.lit(f"(?s)(?=(.{{{g}}}))"), F.lit(1)) for g in sizes]
    return F.array_distinct(F.flatten(F.array(*each)))


def containing(
    texts: DataFrame,
    id_cols: list[str],
    text_col: str,
    patterns: DataFrame,
    pattern_col: str,
    like: bool = False,
    first: int | None = None,
    per: tuple[str, ...] = (),
) -> DataFrame:
    """Distinct (id_cols, pattern) where the text contains the pattern, case-sensitively.

    like=True reads % and _ as wildcards. id_cols must identify a text. NULL texts and NULL
    patterns match nothing; an empty pattern matches every text.

    first=k keeps the k lowest ids of each pattern (and of each value of the id columns in `per`);
    every task cuts what it found to that before it is shuffled.
    """
    distinct = patterns.select(F.col(pattern_col).alias("pattern")).distinct()
    known = settle(_with_anchor(distinct.filter(F.col("pattern").isNotNull()), like), "patterns")
    present = texts.select(*id_cols, text_col).filter(F.col(text_col).isNotNull())
    cut = lambda df, keys: df if first is None else first_per(df, keys, id_cols, first)
    keys = ["pattern", *per]
    found, left, rest = [], known.filter(~_matches_all(like)), present
    if first is not None and not per:
        end = _last_of_first(present, id_cols, FIRST_TEXTS)
        low = present if end is None else present.filter(F.struct(*id_cols) <= end)
        found = [settle(cut(_tested(low, id_cols, text_col, left, like), keys).distinct(), "first")]
        if end is None:
            left = rest = None
        else:
            done = found[0].groupBy("pattern").count().filter(F.col("count") >= first)
            left = settle(left.join(done, "pattern", "left_anti"), "left")
            rest = present.filter(F.struct(*id_cols) > end)
    if rest is not None:
        met = [*_by_token(rest, id_cols, text_col, left, like), _by_test(rest, id_cols, text_col, left, like)]
        # what a piece finds is cut and written before the next piece is read
        found += [cut(df, keys) for df in met] if len(met) < 3 else [settle(cut(df, keys), "met") for df in met]
    hits = cut(reduce(DataFrame.unionByName, found), keys).distinct()
    # a pattern of nothing, or of % only, matches every text: the texts are cut before they meet it
    all_ = known.filter(_matches_all(like)).select("pattern", F.lit(0).alias("_one"))
    every = cut(present.select(*id_cols), list(per)).distinct().withColumn("_one", F.lit(0))
    hits = hits.unionByName(every.join(all_, "_one").select(*id_cols, "pattern"))
    return hits.withColumnRenamed("pattern", pattern_col)


def _last_of_first(texts: DataFrame, id_cols: list[str], n: int) -> Column | None:
    """The last of the n lowest ids; None if there are no more than these."""
    low = texts.select(*id_cols).orderBy(*id_cols).limit(n + 1)
    rows, last = low.agg(F.count(F.lit(1)), F.max(F.struct(*id_cols))).first()
    if rows <= n:
        return None
    return F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in low.schema.fields])


def _tested(texts: DataFrame, id_cols: list[str], text_col: str, known: DataFrame, like: bool) -> DataFrame:
    """Matches by testing every pattern on every text; for few texts. They are dealt anew, since the
    lowest ids often come in one file."""
    dealt = settle(texts.repartition(FIRST_TASKS, *id_cols), "low")
    groups = max(1, -(-known.count() // PATTERNS_AT_ONCE))
    asked = known.select("pattern", F.pmod(F.xxhash64("pattern"), F.lit(groups)).cast("int").alias("_group"))
    each = dealt.select(*id_cols, text_col, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))
    met = [each.join(piece, "_group").filter(_test(text_col, like)) for piece in held(asked, "asked")]
    return reduce(DataFrame.unionByName, met).select(*id_cols, "pattern")


def held(df: DataFrame, name: str) -> list[DataFrame]:
    """df in pieces that every task can hold, so that what they are joined to stays where it is.

    A piece has HELD characters by their mean, whatever the table's size; rows must be distinct."""
    kept = settle(df, name)
    texts = [F.coalesce(F.length(f.name), F.lit(0)) for f in kept.schema.fields if f.dataType.typeName() == "string"]
    size = kept.agg(F.sum(reduce(lambda a, b: a + b, texts, F.lit(ROW)))).first()[0] or 0
    pieces = max(1, -(-size // HELD))
    if pieces == 1:
        return [F.broadcast(kept)]
    at = F.pmod(F.xxhash64(*kept.columns), F.lit(pieces))
    return [F.broadcast(kept.filter(at == i)) for i in range(pieces)]


def _matches_all(like: bool) -> Column:
    pattern = F.col("pattern")
    return (F.replace(pattern, F.lit("%"), F.lit("")) if like else pattern) == ""


def _test(text_col: str, like: bool) -> Column:
    body, pattern = F.col(text_col), F.col("pattern")
    return like_test(body, pattern) if like else body.contains(pattern)


def _by_token(texts: DataFrame, id_cols: list[str], text_col: str, known: DataFrame, like: bool) -> list[DataFrame]:
    """Matches of the patterns that have something to look up, for each piece of the lookup table.

    Texts are read once for the vocabulary and once per piece.
    """
    tokens = F.array_distinct(F.split(F.col(text_col), " "))
    entry = lambda df, token: df.select(token.alias("token"), "pattern", "open")
    whole = entry(known.filter(F.col("whole").isNotNull()), F.col("whole"))
    sizes = sorted(r[0] for r in known.select("gram_size").filter("gram_size is not null").distinct().collect())
    hits = whole
    if sizes:
        parts = held(known.filter(F.col("gram_size").isNotNull()).withColumn("gram", _key_gram()), "parts")
        vocabulary = texts.select(F.explode(tokens).alias("token")).distinct()
        vocabulary = vocabulary if len(parts) == 1 else settle(vocabulary, "vocabulary")
        filed = vocabulary.select("token", F.explode(_grams(F.col("token"), sizes)).alias("gram"))
        token, part, side = F.col("token"), F.col("part"), F.col("side")
        fits = (
            F.when(side == "$", F.endswith(token, part)).when(side == "^", F.startswith(token, part))
            .when(side == "=", token == part).otherwise(F.contains(token, part))
        )
        for piece in parts:
            hits = hits.unionByName(entry(filed.join(piece, "gram").filter(fits), token))
    each = texts.select(*id_cols, text_col, F.explode(tokens).alias("token"))
    test = ~F.col("open") | _test(text_col, like)
    return [each.join(piece, "token").filter(test).select(*id_cols, "pattern") for piece in held(hits, "lookup")]


def _by_test(texts: DataFrame, id_cols: list[str], text_col: str, known: DataFrame, like: bool) -> DataFrame:
    """Matches of the patterns without a token, by testing every text. The patterns go to every
    group of texts, so no group holds more than its share of them."""
    group = F.pmod(F.xxhash64(*id_cols), F.lit(SALTS)).cast("int").alias("_group")
    odd = known.filter((F.col("part") == "") & ~_matches_all(like))
    spread = odd.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_group"))
    met = texts.select(*id_cols, text_col, group).join(spread, "_group")
    return met.filter(_test(text_col, like)).select(*id_cols, "pattern")


def first_per(df: DataFrame, key: str | list[str], order: list, k: int) -> DataFrame:
    """The rows with the first k distinct order values per key. Tasks cut their rows to that before
    they shuffle, so a key that most rows share arrives already short."""
    keys = [key] if isinstance(key, str) else (key or [F.lit(1)])
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
