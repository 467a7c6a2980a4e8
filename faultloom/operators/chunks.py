"""Procedure documents: chunking, the searchable view, line classification, reassembly.

Everything that reads whole texts works inside the row, in time linear in the text, and leaves the
row only as exploded pieces: no operator here groups a document's text except `reassemble`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, rules, text
from ..functions.rules import first_match


def chunk_text(
    documents: DataFrame,
    text_col: str = "content",
    id_cols: tuple[str, ...] = ("document_id", "file_path"),
    size: int = fixed.CHUNK_SIZE,
    min_len: int = fixed.CHUNK_MIN_LENGTH,
) -> DataFrame:
    """Cut texts into consecutive pieces of `size` characters, typed and positioned.

    Pieces with min_len or fewer characters (blanks trimmed) are dropped after numbering, so
    sequences may have gaps. Pass min_len=-1 to keep every piece. An empty or NULL text has none.

    One regular-expression pass yields all pieces: cutting piece n with a substring would rescan
    the text from its start for every piece. The rule word is found before the pieces are unfolded:
    a caller's filter on the type then reads a column, where it would otherwise be pushed down as
    copies of the search for that word.
    """
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    upper = F.transform(pieces, lambda p: F.struct(p.alias("piece"), F.upper(p).alias("upper")))
    marked = F.transform(upper, lambda p: F.struct(
        p["piece"].alias("piece"), rules.chunk_keyword(p["upper"]).alias("keyword")
    ))
    number, piece = F.col("chunk_sequence"), F.col("chunk_text")
    start = (number - 1) * size + 1
    return (
        documents.select(*id_cols, F.posexplode(marked).alias("_pos", "_cut"))
        .filter(rules.is_meaningful("_cut.piece", min_len))
        .select(
            *id_cols, (F.col("_pos") + 1).alias("chunk_sequence"),
            F.col("_cut.piece").alias("chunk_text"), F.col("_cut.keyword").alias("_keyword"),
        )
        .select(
            *id_cols, "chunk_sequence", "chunk_text",
            rules.type_of_keyword("_keyword").alias("chunk_type"),
            rules.section_of_keyword("_keyword").alias("section_name"),
            start.alias("char_start_position"),
            (start + F.length(piece) - 1).alias("char_end_position"),
        )
    )


def chunk_table(documents: DataFrame, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """chunk_text as rows of the chunk table: with ids and the meaningful flag. Columns to carry
    along must be among id_cols."""
    return chunk_text(documents, **options).select(
        text.chunk_id("document_id", "chunk_sequence").alias("chunk_id"),
        "document_id", "file_path", "chunk_sequence", "chunk_text", "chunk_type", "section_name",
        F.lit(None).cast("int").alias("page_number"),
        "char_start_position", "char_end_position",
        F.lit(True).alias("is_meaningful"),
        *carry,
    )


SEARCHABLE = (
    "chunk_id", "document_id", "document_title", "category", "equipment_types", "fault_codes",
    "chunk_sequence", "chunk_text", "chunk_type", "section_name", "page_number",
    "char_start_position", "char_end_position", "document_version", "last_reviewed",
    "file_url", "file_last_modified",
)


def _described(metadata: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active documents and active files, with what a searchable chunk says of both."""
    m = metadata.filter("is_active").select(
        "document_id", F.col("title").alias("document_title"), "category", "equipment_types",
        "fault_codes", "document_version", "last_reviewed",
    )
    f = files.filter(F.col("file_status") == "ACTIVE").select(
        "file_path", "file_url", F.col("last_modified").alias("file_last_modified")
    )
    return m, f


def searchable_chunks(chunks: DataFrame, metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Meaningful chunks of active documents with active files (17 columns), from a chunk table.

    Where the texts are at hand, searchable_documents gives the same rows without moving chunks.
    """
    m, f = _described(metadata, files)
    kept = chunks.filter("is_meaningful")
    return kept.join(m, "document_id").join(f, "file_path").select(*SEARCHABLE)


def searchable_documents(documents: DataFrame, metadata: DataFrame, files: DataFrame) -> DataFrame:
    """searchable_chunks straight from the texts: a document meets its metadata and file before it
    is cut, one row each, so no chunk is shuffled and no key is hot."""
    m, f = _described(metadata, files)
    joined = documents.select("document_id", "file_path", "content").join(m, "document_id").join(f, "file_path")
    carried = tuple(c for c in joined.columns if c not in ("document_id", "file_path", "content"))
    cut = chunk_table(joined, id_cols=("document_id", "file_path", *carried), carry=carried)
    return cut.filter("is_meaningful").select(*SEARCHABLE)


def chunk_preview(chunks: DataFrame, n: int = 10) -> DataFrame:
    """The first n chunks with a 50-character preview."""
    return (
        chunks.orderBy("document_id", "chunk_sequence").limit(n)
        .select(
            "chunk_id", "document_id", "chunk_type",
            F.length("chunk_text").alias("chunk_length"),
            F.concat(F.substring("chunk_text", 1, 50), F.lit("...")).alias("chunk_preview"),
        )
    )


def chunk_metrics(chunks: DataFrame) -> DataFrame:
    """Characters and words per chunk."""
    return chunks.select(
        "chunk_id", "document_id", F.length("chunk_text").alias("char_count"),
        word_count("chunk_text").alias("word_count"),
    )


def word_count(c: Column | str) -> Column:
    """Runs of characters other than white space."""
    blanks = F.translate(rules.col(c), fixed.WHITESPACE, " " * len(fixed.WHITESPACE))
    return F.size(F.array_remove(F.split(blanks, " "), ""))


def document_stats(documents: DataFrame, chars_per_page: int = 2000) -> DataFrame:
    """Characters, words and pages per document. The page size is ours: texts carry no pages."""
    size = F.length("content")
    return documents.select(
        "document_id", size.alias("char_count"), word_count("content").alias("word_count"),
        F.ceil(size / chars_per_page).cast("int").alias("page_count"),
    )


def document_list(metadata: DataFrame) -> DataFrame:
    """Listing with defaults; arrays joined with commas, or 'Not specified' when empty."""
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("Not specified")
    return metadata.select(
        F.coalesce("document_id", F.lit("UNKNOWN")).alias("document_id"),
        F.coalesce("title", F.lit("Untitled Document")).alias("title"),
        F.coalesce("category", F.lit("General")).alias("category"),
        joined("equipment_types").alias("equipment_types"),
        joined("fault_codes").alias("fault_codes"),
    )


def classify_lines(documents: DataFrame) -> DataFrame:
    """One row per line (document_id, section_no, line_no, kind, line).

    Blank lines separate sections. A section whose first line is short upper case or ends with a
    colon has a header and its lines are numbered, bullet or plain; any other section is one
    paragraph. Blank sections and blank lines below a header are left out.
    """
    sections = F.split(text.strip("content"), "\n\n")
    title = text.strip(F.substring_index(F.col("section"), "\n", 1))
    cased = (F.upper(title) == title) & (F.lower(title) != title)
    header = (cased & (F.length(title) < fixed.HEADER_MAX)) | title.endswith(":")
    lines = F.when(F.col("has_header"), F.split("section", "\n")).otherwise(F.array("section"))
    bare = text.strip("raw")
    kind = first_match(
        [
            (~F.col("has_header"), "paragraph"),
            (F.col("line_no") == 0, "header"),
            (text.any_prefix(F.col("line"), fixed.NUMBER_MARKS), "numbered"),
            (F.col("line").startswith("-"), "bullet"),
        ],
        "plain",
    )
    return (
        documents.select("document_id", F.posexplode(sections).alias("section_no", "section"))
        .filter(F.length(text.strip("section")) > 0)
        .withColumn("has_header", header)
        .select("document_id", "section_no", "has_header", F.posexplode(lines).alias("line_no", "raw"))
        .withColumn("line", F.when(F.col("has_header"), bare).otherwise(F.col("raw")))
        .filter(~F.col("has_header") | (F.col("line_no") == 0) | (F.length("line") > 0))
        .select("document_id", "section_no", "line_no", kind.alias("kind"), "line")
    )


def reassemble(chunks: DataFrame, block: int = 1024) -> DataFrame:
    """Concatenate chunks back into texts. Exact only where no chunk was dropped.

    Two steps: blocks of consecutive chunks first, then the blocks of a document, so a long
    document is put together by many tasks and its last step sees one value per block.
    """
    part = ((F.col("chunk_sequence") - 1) / block).cast("long")
    ordered = lambda key, value: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ""
    )
    return (
        chunks.groupBy("document_id", part.alias("part"))
        .agg(ordered("chunk_sequence", "chunk_text").alias("piece"), F.count(F.lit(1)).alias("n"))
        .groupBy("document_id")
        .agg(ordered("part", "piece").alias("content"), F.sum("n").alias("chunk_count"))
    )


def context_window(chunks: DataFrame, w: int = 2, block: int = 1024) -> DataFrame:
    """Each chunk with the ids of its neighbours within w sequence numbers, itself included.

    The window is a range on the sequence, so gaps count. Documents are cut into blocks that also
    receive the w chunks on either side: a huge document is spread over many window groups.
    """
    block = max(block, 2 * w)
    seq = F.col("chunk_sequence")
    at = lambda c: F.floor(c / block)
    reach = F.array_distinct(F.array(at(seq), at(seq - w), at(seq + w)))
    frame = (
        Window.partitionBy("document_id", "part").orderBy("chunk_sequence").rangeBetween(-w, w)
    )
    return (
        chunks.select("chunk_id", "document_id", "chunk_sequence", F.explode(reach).alias("part"))
        .withColumn("neighbour_ids", F.collect_list("chunk_id").over(frame))
        .filter(F.col("part") == at(seq))
        .drop("part")
    )


def context_chunks(chunks: DataFrame, targets: DataFrame, w: int = 2) -> DataFrame:
    """The chunks within w sequence numbers of each target, with flag and distance.

    Targets (target_chunk_id, document_id, chunk_sequence) are unfolded to the 2w+1 positions they
    ask for, so the join is an equality on (document, position): no pairs within a document are
    tried, however many chunks and targets it has.
    """
    wanted = targets.select(
        "target_chunk_id", "document_id", F.col("chunk_sequence").alias("_at"),
        F.explode(F.sequence(F.col("chunk_sequence") - w, F.col("chunk_sequence") + w))
        .alias("chunk_sequence"),
    )
    return wanted.join(chunks, ["document_id", "chunk_sequence"]).select(
        "target_chunk_id", "chunk_id", "document_id", "chunk_sequence", "chunk_text", "chunk_type",
        (F.col("chunk_id") == F.col("target_chunk_id")).alias("is_target_chunk"),
        F.abs(F.col("chunk_sequence") - F.col("_at")).alias("distance_from_target"),
    )


def context_of(chunks: DataFrame, chunk_id: str, w: int = 2) -> DataFrame:
    """Context of one chunk by id, in sequence order."""
    target = chunks.filter(F.col("chunk_id") == chunk_id).select(
        F.col("chunk_id").alias("target_chunk_id"), "document_id", "chunk_sequence"
    )
    return context_chunks(chunks, target, w).orderBy("chunk_sequence")


def conversation_tail(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages per conversation. Spark cuts each task's rows to n per conversation
    before the shuffle (window group limit), so a hot conversation arrives already short."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (
        messages.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= n).drop("_rank")
    )
