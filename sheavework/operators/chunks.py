"""Text to chunks, paragraphs to text, headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, text
from ..session import scratch_path
from .spread import fits_broadcast, may_match, running_offset, settled


def skip_blank(df: DataFrame, col: str = "text") -> DataFrame:
    return df.where(text.not_blank(F.col(col)))


def chunk_words(docs: DataFrame, size: int = text.TEXT_WINDOW, col: str = "text") -> DataFrame:
    """One row per window of ``size`` words: the other columns, ``chunk_no`` from 0 and ``text``."""
    others = [F.col(c) for c in docs.columns if c != col]
    return docs.select(*others, F.posexplode(text.word_windows(F.col(col), size)).alias("chunk_no", "text"))


def identify_chunks(chunks: DataFrame, tag: str = "tag", source_name: str = "source", preview_chars: int = text.PREVIEW_CHARS) -> DataFrame:
    """Add ``chars``, ``preview`` and ``chunk_id``. ``source_name`` is the column with the file's own name."""
    sized = chunks.withColumn("chars", F.char_length("text"))
    return sized.withColumn("preview", text.preview(F.col("text"), preview_chars)).withColumn(
        "chunk_id", text.chunk_key(F.col(source_name), F.col(tag), F.col("chunk_no"), F.col("chars"))
    )


def text_chunks(docs: DataFrame, size: int = text.TEXT_WINDOW) -> DataFrame:
    """Documents (source, kind, page, sheet?, text) to identified chunks."""
    sheet = F.col("sheet") if "sheet" in docs.columns else F.lit(None).cast("string")
    tagged = docs.withColumn("tag", names.chunk_tag(F.col("kind"), F.col("page"), sheet))
    return identify_chunks(chunk_words(skip_blank(tagged), size)).drop("tag")


def join_paragraphs(paragraphs: DataFrame, part_rows: int = 1024) -> DataFrame:
    """Non-blank paragraphs joined by one blank, in parts of ``part_rows`` paragraph numbers.

    A document of up to ``part_rows`` paragraphs has one part; longer ones have several, to be read in
    the order of ``part_no``, so that no group grows with the document.
    """
    visible = skip_blank(paragraphs).withColumn("part_no", F.floor(F.col("para_no") / part_rows).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct("para_no", "text")))
    return visible.groupBy("source", "part_no").agg(
        F.array_join(F.transform(lines, lambda p: p["text"]), " ").alias("text")
    )


def chunk_paragraphs(paragraphs: DataFrame, size: int = text.TEXT_WINDOW) -> DataFrame:
    """The windows of ``chunk_words`` over the joined paragraphs, without joining a whole document.

    Every paragraph knows how many words come before it in its document. It is cut into windows of its
    own, each of which reaches into at most two of the document's windows; a document window then
    gathers its pieces, never more than ``size`` words.
    """
    counted = skip_blank(paragraphs).select(
        "source", "para_no", "text", F.size(text.words(F.col("text"))).alias("n_words")
    )
    placed = running_offset(counted, ["source"], "para_no", "n_words", "offset")
    pieces = placed.select(
        "source", "offset", F.posexplode(text.word_windows(F.col("text"), size)).alias("piece_no", "piece")
    ).select(
        "source",
        (F.col("offset") + F.col("piece_no") * size).alias("start"),
        F.split("piece", " ").alias("words"),
    )
    room = (F.lit(size) - F.col("start") % size).cast("int")
    first_window = F.floor(F.col("start") / size)
    halves = F.array(
        F.struct(first_window.alias("chunk_no"), F.slice("words", F.lit(1), room).alias("words")),
        F.struct((first_window + 1).alias("chunk_no"), F.slice("words", room + 1, F.lit(size)).alias("words")),
    )
    parts = pieces.select("source", "start", F.explode(halves).alias("h")).where(F.size("h.words") > 0)
    gathered = parts.groupBy("source", F.col("h.chunk_no").cast("int").alias("chunk_no")).agg(
        F.array_sort(F.collect_list(F.struct("start", F.array_join("h.words", " ").alias("piece")))).alias("pieces")
    )
    return gathered.select(
        "source", "chunk_no", F.array_join(F.transform("pieces", lambda p: p["piece"]), " ").alias("text")
    )


def headings_from_styles(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs whose style starts with "heading"; the level is the number in the style's name, else 1."""
    level = F.expr(r"try_cast(regexp_replace(style, '[^0-9]', '') AS int)")
    return skip_blank(paragraphs.where(F.lower("style").startswith("heading"))).select(
        "source",
        F.lit(1).alias("page"),
        F.coalesce(level, F.lit(1)).alias("level"),
        text.strip(F.col("text")).alias("heading"),
        "para_no",
    )


def page_medians(counts: DataFrame) -> DataFrame:
    """Upper median of the non-zero sizes of every page, from numbers ``n`` of words per (source, page, size)."""
    counts = counts.where(F.coalesce(F.col("size"), F.lit(0.0)) != 0).groupBy("source", "page", "size").agg(F.sum("n").alias("n"))
    page = Window.partitionBy("source", "page")
    upto = page.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(page))
    above = F.col("upto") > F.expr("total div 2")
    return ranked.groupBy("source", "page").agg(F.min(F.when(above, F.col("size"))).alias("median"))


# How much larger than the page median a line must be.
HEADING_RATIO = 1.25
TOP_HEADING_RATIO = 1.6


def headings_from_font_size(words: DataFrame) -> DataFrame:
    """Lines whose average size is well above the page's median; text is collected for those lines only.

    The words are read twice: once for the sizes that occur in each line, which are stored by columns as lines and pages are both summed
    up from them, and once for the text of the headings.
    """
    placed, path = words.withColumn("line", F.col("top").cast("int")), scratch_path(words.sparkSession, "sizes")
    placed.groupBy("source", "page", "line", "size").agg(F.count("*").alias("n"), F.min("word_no").alias("first_word")).write.parquet(path)
    sizes = words.sparkSession.read.parquet(path)
    lines = sizes.groupBy("source", "page", "line").agg(
        (F.sum(F.coalesce(F.col("size"), F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("line_size"), F.min("first_word").alias("first_word")
    )
    large = lines.join(page_medians(sizes), ["source", "page"]).where(
        F.col("line_size") >= F.col("median") * HEADING_RATIO
    )
    level = F.when(F.col("line_size") >= F.col("median") * TOP_HEADING_RATIO, 1).otherwise(2)
    marked = settled(large.select("source", "page", "line", "first_word", level.alias("level")))
    if fits_broadcast(marked):  # the words then meet their lines where they are read
        marked = F.broadcast(marked)
    else:  # few words of other lines are shuffled with those of the headings
        placed = may_match(placed, marked, ["source", "page", "line"])
    ordered = F.array_sort(F.collect_list(F.struct("word_no", F.coalesce("text", F.lit("")).alias("text"))))
    found = placed.join(marked, ["source", "page", "line"]).groupBy("source", "page", "line", "first_word", "level").agg(
        text.strip(F.array_join(F.transform(ordered, lambda w: w["text"]), " ")).alias("heading")
    )
    return found.where(F.col("heading") != "").select("source", "page", "level", "heading", "first_word")
