"""Search over procedure chunks and documents.

All searches read an index: the chunks already joined with their document's attributes
(`search_index`). Store it once with `store_index`: a search of one text is then a scan with a bounded
top-k, and searches of many texts read only the postings of their words. Neither moves chunk text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, rules, text
from ..session import steps
from ..sources.tables import settle
from .chunks import chunk_table
from .postings import Postings, in_parts, matching, open_postings, write_postings
from .textmatch import containing, first_per, held, like_test
from .vectors import blended_topk

INDEX_COLUMNS = (
    "chunk_id", "chunk_text", "document_id", "document_title", "category", "chunk_type",
    "section_name", "page_number", "chunk_sequence", "equipment_types", "fault_codes",
    "char_start_position", "char_end_position",
)
RESULT_COLUMNS = (
    "chunk_id", "document_id", "document_title", "category", "chunk_text", "chunk_type",
    "section_name", "page_number", "chunk_sequence",
)
ORDER = ("document_id", "chunk_sequence")
# search texts that are tested on a document in one row
TEXTS_AT_ONCE = 256


def search_index(
    chunks: DataFrame, metadata: DataFrame, min_len: int | None = fixed.SEARCH_MIN_LENGTH
) -> DataFrame:
    """Meaningful chunks of active documents with title, category, equipment and codes.

    min_len=None keeps short chunks (the similar-fault search does). Where the texts are at hand,
    index_documents gives the same rows without moving chunks.
    """
    c = chunks.filter("is_meaningful")
    if min_len is not None:
        c = c.filter(rules.is_meaningful("chunk_text", min_len))
    return c.join(_attributes(metadata), "document_id").select(*INDEX_COLUMNS)


def _attributes(metadata: DataFrame) -> DataFrame:
    return metadata.filter("is_active").select(
        "document_id", F.col("title").alias("document_title"), "category", "equipment_types",
        "fault_codes",
    )


def index_documents(
    documents: DataFrame, metadata: DataFrame, min_len: int | None = fixed.SEARCH_MIN_LENGTH
) -> DataFrame:
    """search_index straight from the texts: documents meet their metadata before they are cut.

    Both sides hold one row per document, so no key is hot, however many chunks a document has.
    """
    carried = ("document_title", "category", "equipment_types", "fault_codes")
    joined = documents.select("document_id", "file_path", "content").join(
        _attributes(metadata), "document_id"
    )
    chunks = chunk_table(joined, id_cols=("document_id", "file_path", *carried), carry=carried)
    if min_len is not None:
        chunks = chunks.filter(rules.is_meaningful("chunk_text", min_len))
    return chunks.select(*INDEX_COLUMNS)


@dataclass(frozen=True)
class SearchIndex:
    """A stored index: the chunks with their attributes, and where every word of theirs stands."""

    chunks: DataFrame
    postings: Postings


def store_index(index: DataFrame, root: str) -> SearchIndex:
    """Write an index below root: chunks and the postings of their texts."""
    with steps(index.sparkSession):  # chunks that are not in order yet go as soon as they are
        laid = in_parts(settle(index, "index"), ORDER)
        laid.write.parquet(f"{root}/chunks")
    chunks = index.sparkSession.read.schema(laid.schema).parquet(f"{root}/chunks")
    write_postings(_bodies(chunks), ORDER, "body", f"{root}/postings")
    return open_index(index.sparkSession, root)


def open_index(spark: SparkSession, root: str) -> SearchIndex:
    """An index that store_index wrote."""
    return SearchIndex(spark.read.parquet(f"{root}/chunks"), open_postings(spark, f"{root}/postings", ORDER))


def _bodies(chunks: DataFrame) -> DataFrame:
    return chunks.select(*ORDER, "part", F.upper("chunk_text").alias("body"))


def _chunks(index: DataFrame | SearchIndex) -> DataFrame:
    return index.chunks if isinstance(index, SearchIndex) else index


def _covers(array: str, value: str) -> Column:
    """The array holds the value; NULL arrays and elements do not count."""
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def _restrict(
    df: DataFrame, chunk_type=None, category=None, equipment=None, document_id=None
) -> DataFrame:
    for column, value in (
        ("chunk_type", chunk_type), ("category", category), ("document_id", document_id)
    ):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df if equipment is None else df.filter(_covers("equipment_types", equipment))


def _scored(df: DataFrame, query: str, literal: bool) -> DataFrame:
    """Rows with any kind of hit, and the relevance of the best one."""
    q = F.lit(query)
    fields = ("chunk_text", "section_name", "document_title")
    tests = [text.matches(c, q, literal) for c in fields]
    tests.append(text.matches("chunk_text", text.first_word(q), literal))
    return df.filter(reduce(lambda a, b: a | b, tests)).withColumn(
        "relevance_score", text.relevance(*fields, q, literal)
    )


def search_chunks(
    index: DataFrame | SearchIndex,
    query: str,
    chunk_type: str | None = None,
    category: str | None = None,
    equipment: str | None = None,
    document_id: str | None = None,
    k: int = 10,
    literal: bool = False,
) -> DataFrame:
    """The k best chunks for one query. % and _ in the query are wildcards unless literal."""
    kept = _restrict(_chunks(index), chunk_type, category, equipment, document_id)
    return (
        _scored(kept, query, literal)
        .orderBy(F.desc("relevance_score"), *ORDER).limit(k)
        .select(*RESULT_COLUMNS, "relevance_score", F.lit(True).alias("equipment_match"))
    )


def find_similar(
    index: DataFrame | SearchIndex, description: str, threshold: float = 0.3, k: int = 5, literal: bool = False
) -> DataFrame:
    """The k best distinct (document, text) hits at or above a threshold.

    Use an index with min_len=None. Scores are 0.9, 0.7, 0.6 or 0.5: thresholds up to 0.5 filter
    nothing. With a stored index, only chunks of the first k documents of each kind of hit are read.
    """
    chunks = _chunks(index)
    if isinstance(index, SearchIndex):
        asked = chunks.sparkSession.createDataFrame([(description,)], "query_text string")
        found = _best_hits(index, asked, k, literal, ["document_id"])
        scored = chunks.join(settle(found.drop("query_text"), "hits"), list(ORDER))
    else:
        scored = _scored(chunks, description, literal)
    return (
        scored
        .filter(F.col("relevance_score") >= threshold)
        .select(
            "document_id", "document_title", "category",
            F.col("chunk_text").alias("similar_chunk_text"), "chunk_type", "relevance_score",
            "equipment_types", "fault_codes",
        )
        .distinct()
        .orderBy(F.desc("relevance_score"), "document_id", "similar_chunk_text").limit(k)
    )


def _best_hits(
    index: DataFrame | SearchIndex, queries: DataFrame, k: int, literal: bool, order: list[str]
) -> DataFrame:
    """query_text, ids and best score of all chunks that can be among the first k of a query.

    Every kind of hit has one fixed score and ties go by `order`, so of each kind the chunks with the
    first k values of it per pattern, section or title are all that can reach a top k.
    """
    upper = lambda c: F.upper(F.col(c))
    ids, chunks = list(ORDER), _chunks(index)
    texts = queries.select("query_text").filter(F.col("query_text").isNotNull()).distinct()
    roles = F.array(
        F.struct(upper("query_text").alias("pattern"), F.lit("full").alias("role")),
        F.struct(F.upper(text.first_word("query_text")).alias("pattern"), F.lit("first").alias("role")),
    )
    asked = settle(texts.select("query_text", F.inline(roles)), "queries")

    named = lambda kind, c: F.struct(F.lit(kind).alias("kind"), upper(c).alias("body"))
    labels = F.array(named("section", "section_name"), named("title", "document_title"))
    labelled = chunks.select(*ids, F.inline(labels)).filter(F.col("body").isNotNull())
    firsts = settle(first_per(labelled, ["kind", "body"], order, k), "labels")
    options = dict(like=not literal, first=k if order == ids else None)
    full = asked.filter("role = 'full'")
    hits = containing(firsts, [*ids, "kind"], "body", full, "pattern", per=("kind",), **options)
    if isinstance(index, SearchIndex):
        found = matching(index.postings, _bodies(chunks), "body", asked, "pattern", **options)
    else:
        found = containing(chunks.select(*ids, upper("chunk_text").alias("body")), ids, "body", asked, "pattern", **options)
    hits = hits.unionByName(found.withColumn("kind", F.lit("text")))
    if order != ids:
        hits = first_per(hits, ["pattern", "kind"], order, k)
    role, kind = F.col("role"), F.col("kind")
    score = rules.first_match(
        [
            ((kind == "text") & (role == "full"), fixed.SCORE_TEXT),
            (kind == "text", fixed.SCORE_FIRST_WORD),
            ((kind == "section") & (role == "full"), fixed.SCORE_SECTION),
            ((kind == "title") & (role == "full"), fixed.SCORE_TITLE),
        ],
        F.lit(None).cast("double"),
    )
    return (
        hits.join(asked, "pattern").withColumn("relevance_score", score)
        .filter(F.col("relevance_score").isNotNull())
        .groupBy("query_text", *ids).agg(F.max("relevance_score").alias("relevance_score"))
    )


def search_many(
    index: DataFrame | SearchIndex, queries: DataFrame, k: int = 10, literal: bool = False
) -> DataFrame:
    """search_chunks without filters, for a whole table of queries (column query_text).

    With a stored index only the postings of the queries' words are read; text is fetched for the
    winners only.
    """
    ids = list(ORDER)
    rank = Window.partitionBy("query_text").orderBy(F.desc("relevance_score"), *ids)
    best = _best_hits(index, queries, k, literal, ids)
    winners = settle(
        best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k), "winners"
    )
    # the winning chunks are picked where they lie: a join by shuffle would move the text of all chunks
    picked = [_chunks(index).select(*RESULT_COLUMNS).join(p, ids, "left_semi") for p in held(winners.select(*ids).distinct(), "picked")]
    texts = settle(reduce(DataFrame.unionByName, picked), "texts")
    return texts.join(winners, ids).select("query_text", "rank", *RESULT_COLUMNS, "relevance_score")


def search_documents(
    documents: DataFrame, query: str, category: str | None = None, k: int = 10, literal: bool = False
) -> DataFrame:
    """Document-level search over whole contents, one row per active document."""
    rows = documents.filter("is_active").select(
        "document_id", F.col("title").alias("document_title"), "category",
        F.col("content").alias("chunk_text"), F.lit(None).cast("string").alias("section_name"),
    )
    hits = (
        _scored(_restrict(rows, category=category), query, literal)
        .orderBy(F.desc("relevance_score"), "document_id").limit(k)
    )
    return hits.select(
        "document_id", "document_title", "category", "relevance_score",
        text.excerpt("chunk_text", F.lit(query)).alias("content_excerpt"),
    )


def fault_context(faults: DataFrame, index: DataFrame | SearchIndex, k: int = 5) -> DataFrame:
    """For every fault, the first k chunks of documents that list its code, in working order.

    Safety comes first, then diagnostic, procedure, verification, and last everything else. A code's
    chunks are the same for all its faults, so they are ranked once per distinct code; each task
    keeps k per code before the shuffle, and faults only meet those short lists.
    """
    codes = settle(
        faults.select("fault_code").filter(F.col("fault_code").isNotNull()).distinct(), "codes"
    )
    place = F.array_position(rules.strings(fixed.CONTEXT_TYPE_ORDER), F.col("chunk_type"))
    last = F.lit(len(fixed.CONTEXT_TYPE_ORDER) + 1)
    per_code = (
        _chunks(index).select(
            "chunk_id", "document_id", "chunk_sequence", "chunk_type",
            F.when(place > 0, place).otherwise(last).alias("place"),
            F.explode(F.array_distinct("fault_codes")).alias("fault_code"),
        )
        .join(codes, "fault_code", "left_semi")
    )
    ranked = per_code.withColumn(
        "position",
        F.row_number().over(Window.partitionBy("fault_code").orderBy("place", *ORDER)),
    ).filter(F.col("position") <= k)
    lists = ranked.groupBy("fault_code").agg(
        F.array_sort(F.collect_list(F.struct("position", "chunk_id", "document_id", "chunk_type")))
        .alias("context")
    )
    short = settle(lists, "contexts")
    return faults.select("fault_id", "fault_code").join(short, "fault_code", "left").select(
        "fault_id", "fault_code", F.coalesce(F.size("context"), F.lit(0)).alias("context_size"),
        "context",
    )


def ask_questions(index: DataFrame | SearchIndex, questions: DataFrame, max_chunks: int = 5) -> DataFrame:
    """The answer envelope of each (question, equipment_type, fault_code), with its sources.

    The composed text is searched for all questions at once. No text is generated: the answer
    names the question and the sources that were found.
    """
    asked = questions.select("question", "equipment_type", "fault_code").distinct().withColumn(
        "query_text", text.compose_question("question", "equipment_type", "fault_code")
    )
    hits = search_many(index, asked, max_chunks)
    sources = hits.groupBy("query_text").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id", "relevance_score")))
        .alias("source_chunks")
    )
    found = F.coalesce(F.size("source_chunks"), F.lit(0))
    return asked.join(sources, "query_text", "left").select(
        "question", "equipment_type", "fault_code", "query_text",
        (found > 0).alias("answer_found"),
        F.concat(F.lit("Sources found for: "), "question").alias("answer_text"),
        found.alias("chunks_used"), "source_chunks",
    )


def chat_answers(index: DataFrame | SearchIndex, questions: DataFrame) -> DataFrame:
    """Formatted answer per query_text from its best chunk, or the not-found text."""
    best = search_many(index, questions, 1).select(
        "query_text", "document_id", "document_title", "category", "relevance_score",
        text.excerpt("chunk_text", F.col("query_text")).alias("_excerpt"),
    )
    return questions.select("query_text").distinct().join(best, "query_text", "left").select(
        "query_text",
        text.format_answer(
            "document_id", "document_title", "relevance_score", "category", "_excerpt"
        ).alias("answer"),
    )


def document_scores(documents: DataFrame, queries: DataFrame, literal: bool = False) -> DataFrame:
    """The scores of search_documents without a cut, for a whole table of queries (column
    query_text): query_text, document_id, relevance_score of every active document that scores.

    Texts come in groups of TEXTS_AT_ONCE, a document meets each group in one row where it is read: most
    documents can score, and a lookup by word would need the vocabulary of all documents.
    """
    texts = queries.select("query_text").filter(F.col("query_text").isNotNull()).distinct()
    ranked = settle(texts.withColumn("_group", F.xxhash64("query_text")), "queries")
    groups = max(1, -(-ranked.count() // TEXTS_AT_ONCE))
    asked = settle(
        ranked.groupBy(F.pmod("_group", F.lit(groups)).alias("_group")).agg(F.collect_list("query_text").alias("asked")), "texts"
    )
    bodies = documents.filter("is_active").select(
        "document_id", F.upper("content").alias("content"), F.upper("title").alias("title"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("_group"),
    )
    test = (lambda c, q: F.col(c).contains(F.upper(q))) if literal else (lambda c, q: like_test(F.col(c), F.upper(q)))

    def score(q):
        return (
            F.when(test("content", q), fixed.SCORE_TEXT)
            .when(test("content", text.first_word(q)), fixed.SCORE_FIRST_WORD)
            .when(test("title", q), fixed.SCORE_TITLE)
        )

    scores = F.transform("asked", lambda q: F.struct(q.alias("query_text"), score(q).alias("relevance_score")))
    return (
        bodies.join(asked, "_group").select("document_id", F.inline(scores))
        .filter(F.col("relevance_score").isNotNull())
        .groupBy("query_text", "document_id").agg(F.max("relevance_score").alias("relevance_score"))
    )


def hybrid_many(
    queries: DataFrame, stored: DataFrame, documents: DataFrame, k: int = 10, weight: float = 0.5,
    literal: bool = False,
) -> DataFrame:
    """The k documents with the best blend of similarity and relevance for every query.

    queries: query_id, query_text, vector; stored: document_id, vector. Every document that scores
    in either way is blended, a score it does not have counts as 0; the cut to k comes after that.
    Gives query_id, rank, document_id, similarity, relevance_score, hybrid_score.
    """
    return blended_topk(queries, stored, document_scores(documents, queries, literal), k, weight)
