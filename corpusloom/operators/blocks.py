"""Parsed document blocks and media: text, order, sections, merging across pages and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bare_strong, html_first_row, norm_strong
from .tables import dealt, merge_joined

TEXT_TYPES = ("title", "paragraph", "list", "table", "chart", "equation_interline")


def explode_blocks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of well-shaped documents, and the documents that aren't. raw: source_id, pages array<array<block>>."""
    good = F.col("pages").isNotNull() & F.forall("pages", lambda p: p.isNotNull())
    blocks = raw.where(good).select("source_id", F.posexplode("pages").alias("page_idx", "_page")).select("source_id", "page_idx", F.posexplode("_page").alias("block_idx", "block"))
    return blocks, raw.where(~F.coalesce(good, F.lit(False)))


def text_of_items(items: Column) -> Column:
    """The text items of a content list, joined."""
    return F.array_join(F.transform(F.filter(items, lambda x: x["type"] == "text"), lambda x: F.coalesce(x["content"], F.lit(""))), "")


def render_list(kind: Column, items: Column) -> Column:
    """Items on lines, numbered if the list is ordered; an empty item gives no line but keeps its number."""
    lines = F.transform(items, lambda x, i: F.struct(F.trim(text_of_items(x["item_content"])).alias("t"), i.alias("i")))
    lines = F.filter(lines, lambda x: x["t"] != "")
    mark = lambda i: F.when(kind == "ordered_list", F.concat((i + 1).cast("string"), F.lit(". "))).otherwise(F.lit("- "))
    return F.array_join(F.transform(lines, lambda x: F.concat(mark(x["i"]), x["t"])), "\n")


def joined_parts(*parts: Column) -> Column:
    """Parts that aren't blank, on lines."""
    return F.concat_ws("\n", *[F.when(F.trim(p) != "", p) for p in parts])


def extract_block_text(blocks: DataFrame) -> DataFrame:
    """blocks (block: type and content) with type and text by the type; null where there is no text or the type has none."""
    c = F.col("block")["content"]
    by_type = {
        "title": text_of_items(c["title_content"]),
        "paragraph": text_of_items(c["paragraph_content"]),
        "list": render_list(c["list_type"], c["list_items"]),
        "table": joined_parts(text_of_items(c["table_caption"]), c["html"], text_of_items(c["table_footnote"])),
        "chart": joined_parts(text_of_items(c["chart_caption"]), c["content"]),
        "equation_interline": c["math_content"],
    }
    text = F.lit(None).cast("string")
    for kind, found in by_type.items():
        text = F.when(F.col("block")["type"] == kind, found).otherwise(text)
    return blocks.withColumn("type", F.col("block")["type"]).withColumn("text", F.nullif(text, F.lit("")))


def strip_image_content(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """blocks without the machine-made content of images, and the snippets that went (source_id, page_idx, block_idx, snippet)."""
    image = F.col("block")["type"] == "image"
    gone = blocks.where(image & (F.length(F.col("block")["content"]["content"]) > 0)).select("source_id", "page_idx", "block_idx", F.col("block")["content"]["content"].alias("snippet"))
    bare = F.when(image, F.col("block").withField("content.content", F.lit(None).cast("string"))).otherwise(F.col("block"))
    return blocks.withColumn("block", bare), gone


def media_raw_text(kind: Column, captions: Column, html: Column, footnotes: Column) -> Column:
    """Captions, body (of tables only) and footnotes on lines, blank ones left out."""
    some = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    body = F.when((kind == "table") & (F.trim(html) != ""), F.array(html)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(some(captions), body, some(footnotes)), "\n")


def build_media_records(manifest: DataFrame, enrichment: DataFrame, on: list[str]) -> DataFrame:
    """Chunk records of media that have a good enrichment; charts count as figures, an unknown kind is an error.

    manifest: source_id, heading_path, chunk_kind, page_idx, block_idx, caption, footnote, content and `on`; enrichment:
    `on`, status, medical_statement, title, summary, hypothetical_questions.
    """
    from ..functions import ids
    from ..functions.text import split_heading

    kind = F.col("chunk_kind")
    chunk_type = F.when(kind == "table", "table").when(kind.isin("figure", "chart"), "figure").otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("null")))).cast("string"))
    both = manifest.join(enrichment.where("status = 'ok'").drop("status"), on).withColumn("chunk_type", chunk_type)
    both = both.withColumn("heading_path_id", ids.heading_path_id(split_heading(F.col("heading_path")))).withColumn("relative_chunk_index", ids.media_relative(F.col("chunk_type"), F.col("page_idx"), F.col("block_idx")))
    both = both.withColumn("chunk_raw_text", media_raw_text(F.col("chunk_type"), F.col("caption"), F.col("content"), F.col("footnote")))
    made = {
        "chunk_id": ids.chunk_id(F.col("source_id"), F.col("heading_path_id"), F.col("relative_chunk_index")),
        "parent_chunk_id": ids.chunk_id(F.col("source_id"), F.col("heading_path_id"), F.lit("parent")),
        "content_hash": ids.media_content_hash(F.col("chunk_raw_text"), F.col("medical_statement")),
        "embedding_status": F.lit("pending"),
    }
    same = ["source_id", "heading_path_id", "heading_path", "relative_chunk_index", "chunk_type", "chunk_raw_text", "medical_statement", "title", "summary", "hypothetical_questions"]
    return both.select(*same, *[v.alias(k) for k, v in made.items()])


def filter_block_types(blocks: DataFrame, types: tuple[str, ...] = TEXT_TYPES) -> DataFrame:
    return blocks.where(F.col("type").isin(*types))


def strip_snippets(docs: DataFrame, snippets: DataFrame, least: int = 20) -> DataFrame:
    """Documents without the snippets (of at least so many characters), replaced one after another in block order."""
    of = dealt(snippets.where(F.length("snippet") >= least), "source_id").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "block_idx", "snippet"))), lambda x: x["snippet"]).alias("_s"))
    both = dealt(docs, "source_id").hint("merge").join(of, "source_id", "left")  # texts shrink well: few bytes of them may be many when broadcast
    clean = F.aggregate(F.coalesce("_s", F.array().cast("array<string>")), F.col("text"), lambda t, s: F.replace(t, s, F.lit("")))
    left = lambda t: F.size(F.filter(F.coalesce("_s", F.array().cast("array<string>")), lambda s: F.contains(t, s)))
    # the clean text is bound by name, or it would be made again for each snippet
    done = F.transform(F.array(clean), lambda t: F.struct(t.alias("clean_text"), left(t).alias("leftovers")))[0]
    return both.select(*[c for c in both.columns if c != "_s"], done.alias("_d")).select(*[c for c in both.columns if c != "_s"], "_d.clean_text", "_d.leftovers")


def classify_media(blocks: DataFrame) -> DataFrame:
    kind = F.when(F.col("type") == "table", "table").when((F.col("type") == "chart") | ((F.col("type") == "image") & (F.col("sub_type") == "flowchart")), F.when(F.col("type") == "chart", "chart").otherwise("figure"))
    return blocks.withColumn("chunk_kind", kind).where("chunk_kind is not null")


def drop_cover_tables(blocks: DataFrame, width: float = 800, height: float = 700) -> DataFrame:
    """Blocks without page-sized empty tables on pages that have no paragraph text."""
    page = W.partitionBy("source_id", "page_idx")
    texted = F.coalesce(F.bool_or((F.col("type") == "paragraph") & (F.trim("text") != "")).over(page), F.lit(False))
    big = (F.get("bbox", 2) - F.get("bbox", 0) > width) & (F.get("bbox", 3) - F.get("bbox", 1) > height)
    cover = (F.col("type") == "table") & (F.coalesce(F.trim("html"), F.lit("")) == "") & F.coalesce(big, F.lit(False)) & ~F.col("_texted")
    return blocks.withColumn("_texted", texted).where(~cover).drop("_texted")


def reroute_kind(manifest: DataFrame) -> DataFrame:
    """Tables captioned as figures become figures; a second run changes nothing."""
    caption = F.array_join("caption", " ")
    figure = F.rlike(caption, F.lit(r"(?<![一-龥])图\s*\d")) & ~F.rlike(caption, F.lit(r"(?<![一-龥])表\s*\d"))
    first = F.coalesce("original_chunk_kind", "chunk_kind")
    return manifest.withColumn("original_chunk_kind", first).withColumn("chunk_kind", F.when((first == "table") & F.coalesce(figure, F.lit(False)), "figure").otherwise(F.col("chunk_kind")))


def with_ordinal(blocks: DataFrame, kind: str = "chunk_kind") -> DataFrame:
    """Number of a block among those of its kind on its page, from 0."""
    return blocks.withColumn("kind_ordinal", F.row_number().over(W.partitionBy("source_id", "page_idx", kind).orderBy("block_idx")) - 1)


def recover_content(media: DataFrame, second: DataFrame) -> DataFrame:
    """Missing bodies from a second source by page, kind and ordinal. second: source_id, page_idx, chunk_kind, kind_ordinal, content."""
    keys = ["source_id", "page_idx", "chunk_kind", "kind_ordinal"]
    both = merge_joined(media, second.select(*keys, F.col("content").alias("_second")), keys, "left")
    missing = F.coalesce(F.trim("content"), F.lit("")) == ""
    found = missing & (F.trim("_second") != "")
    return both.withColumn("content_source", F.when(F.coalesce(found, F.lit(False)), "second").when(missing, "none").otherwise("first")).withColumn("content", F.when(F.coalesce(found, F.lit(False)), F.col("_second")).otherwise(F.col("content"))).drop("_second")


def nested_bodies(second: DataFrame, levels: int = 8) -> DataFrame:
    """source_id, page_idx, chunk_kind, kind_ordinal and content: the first string in a nested block that reads like a body of its kind.

    second: the keys and block, a text of JSON. A table's body holds `<table` or `<td>`, a chart's has a line end and four
    `|` at least, a figure's speaks of mermaid or is a `graph TD` or `graph LR`. Strings are looked at in the order of
    arrays and of the names in objects, down to `levels`. Blocks without any have no row, nor do broken ones.
    """
    keys = ["source_id", "page_idx", "chunk_kind", "kind_ordinal"]
    rows = second.select(*keys, F.try_parse_json("block").alias("_v"))
    places = [f"_p{i}" for i in range(levels)]
    for i in range(levels):
        inner = second.sparkSession.tvf.variant_explode_outer(F.col("_v").outer())
        rows = rows.lateralJoin(inner).select(*keys, *places[:i], F.col("pos").alias(places[i]), F.coalesce("value", "_v").alias("_v"))
    text = F.when(F.schema_of_variant("_v") == "STRING", F.try_variant_get("_v", "$", "string"))
    rows = rows.select(*keys, F.struct(*places).alias("_at"), text.alias("content")).where(F.trim("content") != "")
    has = lambda x: F.contains(F.col("content"), F.lit(x))
    table, chart = has("<table") | has("<td>"), (F.regexp_count("content", F.lit(r"\|")) >= 4) & has("\n")
    figure = F.contains(F.lower("content"), F.lit("mermaid")) | has("graph TD") | has("graph LR")
    fits = F.when(F.col("chunk_kind") == "table", table).when(F.col("chunk_kind") == "chart", chart).when(F.col("chunk_kind") == "figure", figure)
    return rows.where(fits).groupBy(*keys).agg(F.min_by("content", "_at").alias("content"))


def assign_heading(media: DataFrame, ranges: DataFrame) -> DataFrame:
    """Media with the section whose range [start, end] holds their position, by one pass over both; outside ones are orphans.

    media: source_id, position and others; ranges (disjoint in a source): source_id, start, end, heading_path.
    """
    marks = ranges.select("source_id", F.col("start").alias("position"), F.struct("heading_path", "end").alias("_r"), F.lit(0).alias("_kind"), F.lit(None).cast(media.select(F.struct(*media.columns)).schema[0].dataType).alias("_m"))
    rows = media.select("source_id", "position", F.lit(None).cast(marks.schema["_r"].dataType).alias("_r"), F.lit(1).alias("_kind"), F.struct(*media.columns).alias("_m")).unionByName(marks)
    here = F.last("_r", ignorenulls=True).over(W.partitionBy("source_id").orderBy("position", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = rows.withColumn("_here", here).where("_kind = 1").select("_m.*", F.when(F.col("_here.end") >= F.col("position"), F.col("_here.heading_path")).alias("heading_path"))
    return placed.withColumn("orphan_reason", F.when(F.col("heading_path").isNull(), "outside_sections"))


def with_child_index(children: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("parent_chunk_id").orderBy("position")) - 1
    return children.withColumn("relative_chunk_index", n.cast("string"))


def build_chunk_records(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Chunk records of parents, which are never embedded, and of their children, which are to be.

    parents: source_id, heading_path_id, text; children: the same and position. A child belongs to the parent of its
    source and heading.
    """
    from ..functions import ids

    parent_id = ids.chunk_id(F.col("source_id"), F.col("heading_path_id"), F.lit("parent"))
    above = parents.select("source_id", "heading_path_id", F.lit(None).cast("string").alias("parent_chunk_id"), F.lit("parent").alias("relative_chunk_index"), "text", F.lit("parent").alias("chunk_type"), F.lit("skip").alias("embedding_status"))
    below = with_child_index(children.withColumn("parent_chunk_id", parent_id)).withColumn("chunk_type", F.lit("child")).withColumn("embedding_status", F.lit("pending"))
    both = above.unionByName(below.select(*above.columns))
    return both.select(ids.chunk_id(F.col("source_id"), F.col("heading_path_id"), F.col("relative_chunk_index")).alias("chunk_id"), "source_id", "heading_path_id", "parent_chunk_id", "relative_chunk_index", "chunk_type", F.col("text").alias("chunk_raw_text"), ids.content_hash(F.col("text")).alias("content_hash"), "embedding_status")


def heading_paths(parents: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Paths of split parents: a part in the same section as the part before it takes its own head along."""
    same = F.lag("section_path").over(W.partitionBy("source_id").orderBy("position")).eqNullSafe(F.col("section_path")) & F.col("section_path").isNotNull()
    path = F.when(same & (F.col("head") != ""), F.concat_ws(" > ", "section_path", "head")).otherwise(F.col("section_path"))
    out = parents.withColumn("heading_path", path)
    if overrides is None:
        return out
    o = overrides.select("source_id", "position", F.col("heading_path").alias("_o"))
    return out.join(o, ["source_id", "position"], "left").withColumn("heading_path", F.coalesce("_o", "heading_path")).drop("_o")


def crosspage_siblings(tables: DataFrame, gap: int = 2) -> DataFrame:
    """Tables (source_id, heading_path, page_idx, block_idx, caption, content) with merge_role and merge_group_id.

    A table without caption that has the heading and the first row of the table before it, at most `gap` pages on, is
    its sibling. One heading and first row of one source is one group.
    """
    first = F.array_join(F.transform(html_first_row(F.col("content")), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", ""), r"(?U)[\s$]+", "")), "\u0001")
    rows = tables.withColumn("header", F.coalesce(first, F.lit(""))).withColumn("has_caption", F.trim(F.array_join("caption", " ")) != "")
    group = W.partitionBy("source_id", "heading_path", "header").orderBy("page_idx", "block_idx")
    follows = (F.col("header") != "") & ~F.col("has_caption") & (F.col("page_idx") - F.lag("page_idx").over(group) <= gap)
    rows = rows.withColumn("_follows", F.coalesce(follows, F.lit(False)))
    # an anchor is what a sibling comes after: rows are sorted once and told apart by their neighbours
    begin = F.last(F.when(~F.col("_follows"), F.struct("page_idx", "block_idx")), ignorenulls=True).over(group.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_next", F.coalesce(F.lead("_follows").over(group), F.lit(False))).withColumn("_begin", begin)
    role = F.when(F.col("_follows"), "sibling").when(F.col("_next"), "anchor").otherwise("single")
    return rows.withColumn("merge_role", role).withColumn("merge_group_id", F.format_string("p%d-b%d", "_begin.page_idx", "_begin.block_idx")).drop("has_caption", "_follows", "_next", "_begin")


def resolve_anchor(tables: DataFrame) -> DataFrame:
    """Siblings' anchors: the last earlier table with the heading and header that is no sibling."""
    key = F.struct("page_idx", "block_idx")
    order = W.partitionBy("source_id", "heading_path", "header").orderBy("page_idx", "block_idx").rowsBetween(W.unboundedPreceding, -1)
    return tables.withColumn("anchor", F.when(F.col("merge_role") == "sibling", F.last(F.when(F.col("merge_role") != "sibling", key), ignorenulls=True).over(order)))


def table_rows(tables: DataFrame, once: bool = False) -> DataFrame:
    """One row for each table row with its strong key: cells without tags, references and white space. With `once` only the first of rows that a table repeats."""
    raw = F.regexp_extract_all("content", F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0))
    raw = F.array_distinct(raw) if once else raw
    own = ["source_id", "merge_group_id", "merge_role", "page_idx", "block_idx"]
    cells = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?is)</t[dh]>", "\u0001"), r"(?s)<[^>]*>", "")
    # references are decoded in Python; tables without any don't go there, and their keys are made once, before rows are filtered
    coded = F.contains(F.col("content"), F.lit("&"))
    plain = tables.where(~coded).select(*own, F.posexplode(F.transform(raw, lambda x: F.struct(x.alias("raw"), bare_strong(cells(x)).alias("row_key")))).alias("row_idx", "_r")).select(*own, "row_idx", "_r.raw", "_r.row_key")
    return plain.unionByName(tables.where(coded).select(*own, F.posexplode(raw).alias("row_idx", "raw")).withColumn("row_key", norm_strong(cells(F.col("raw")))))


def table_extension(tables: DataFrame) -> DataFrame:
    """What siblings add to their anchor: rows it doesn't have, in order, as they are. One row for each group."""
    keys = ["source_id", "merge_group_id"]
    rows = table_rows(tables.where(F.col("merge_role").isin("sibling", "anchor")), once=True).where(F.regexp_replace("row_key", "\u0001", "") != "")
    first = F.min(F.struct("page_idx", "block_idx", "row_idx", "raw")).alias("_first")
    extra = rows.groupBy(*keys, "row_key").agg(first, F.bool_or(F.col("merge_role") == "anchor").alias("_own")).where("not _own")
    return extra.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_first")), lambda x: x["raw"]), "").alias("extension"))


def merge_panels(media: DataFrame) -> DataFrame:
    """Figures without caption join the next figure of their page and heading that has a numbered caption.

    A caption without a figure number is skipped over; another heading in between ends the search. Adds merge_role
    (anchor, sibling, standalone) and merge_group_id.
    """
    page = W.partitionBy("source_id", "page_idx").orderBy("block_idx")
    turn = (~F.col("heading_path").eqNullSafe(F.lag("heading_path").over(page))).cast("int")
    rows = media.withColumn("_island", F.sum(turn).over(page))
    caption = F.array_join("caption", " ")
    rows = rows.withColumn("_real", F.coalesce(F.rlike(caption, F.lit(r"图\s*\d")), F.lit(False))).withColumn("_none", F.trim(caption) == "")
    ahead = W.partitionBy("source_id", "page_idx", "_island").orderBy("block_idx").rowsBetween(1, W.unboundedFollowing)
    nxt = F.first(F.when(F.col("_real"), F.col("block_idx")), ignorenulls=True).over(ahead)
    rows = rows.withColumn("_anchor", F.when(F.col("_none"), nxt))
    group = F.coalesce("_anchor", "block_idx")
    rows = rows.withColumn("merge_group_id", F.format_string("p%d-b%d", "page_idx", group)).withColumn("_size", F.count("*").over(W.partitionBy("source_id", "page_idx", group)))
    role = F.when(F.col("_anchor").isNotNull(), "sibling").when(F.col("_size") > 1, "anchor").otherwise("standalone")
    return rows.withColumn("merge_role", role).drop("_island", "_real", "_none", "_anchor", "_size")


def route_media_work(manifest: DataFrame, extensions: DataFrame | None = None) -> DataFrame:
    """What to do with each medium before enrichment: a duplicate's and a sibling's body is in its anchor, orphans are
    skipped. With extensions (source_id, merge_group_id, extension) an anchor's content ends with its siblings' rows, and
    with an image_path column an anchor's image_paths are those of its whole group, in order."""
    status = F.when(F.col("merge_role") == "duplicate", "duplicate_of_anchor").when(F.col("merge_role") == "sibling", "merged_into_anchor").when(F.col("heading_path").isNull(), "skip_orphan").otherwise("todo")
    out = manifest.withColumn("work", status)
    anchor = F.col("merge_role") == "anchor"
    if extensions is not None:
        out = out.join(extensions, ["source_id", "merge_group_id"], "left")
        out = out.withColumn("content", F.when(anchor & F.col("extension").isNotNull(), F.concat_ws("\n", F.coalesce("content", F.lit("")), "extension")).otherwise(F.col("content"))).drop("extension")
    if "image_path" in manifest.columns:
        group = W.partitionBy("source_id", "merge_group_id")
        every = F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "block_idx", "image_path")).over(group)), lambda x: x["image_path"])
        out = out.withColumn("image_paths", F.when(anchor, every).otherwise(F.array("image_path")))
    return out


def validate_enrichment(rows: DataFrame) -> DataFrame:
    """reasons why an enrichment is no good; an empty list is a good one."""
    size = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit(""))))
    questions = F.size(F.filter(F.coalesce("questions", F.array().cast("array<string>")), lambda q: F.trim(q) != ""))
    checks = {"statement_short": size("statement") < 30, "title_size": ~size("title").between(1, 60), "summary_empty": size("summary") == 0, "no_question": questions < 1}
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in checks.items()])))


def eligible_media(media: DataFrame, enrichment: DataFrame, on: list[str]) -> DataFrame:
    """Media with the one reason for which they are skipped, in this order; null is eligible."""
    both = media.join(enrichment.select(*on, F.col("status").alias("_s")), on, "left")
    reason = F.when(F.col("heading_path").isNull(), "orphan").when(F.col("merge_role").isin("sibling", "duplicate"), "merged").when(F.col("_s").isNull(), "no_enrichment").when(F.col("_s") != "ok", "failed")
    return both.withColumn("skip_reason", reason).drop("_s")


def build_vector_records(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vector records of chunks that aren't parents, and the media without the statement that they need.

    One original record, a summary record if there is one, and one for each question that isn't blank; a question
    keeps the number of its place.
    """
    rows = chunks.where("chunk_type <> 'parent'")
    bad = rows.where(F.col("chunk_type").isin("table", "figure") & (F.coalesce(F.trim("medical_statement"), F.lit("")) == ""))
    good = rows.join(bad.select("chunk_id"), "chunk_id", "left_anti")
    body = F.when(F.col("chunk_type") == "child", F.col("chunk_raw_text")).otherwise(F.col("medical_statement"))
    record = lambda suffix, kind, text: F.struct(F.concat(F.col("chunk_id"), suffix).alias("id"), F.lit(kind).alias("vector_type"), text.alias("text"))
    original = F.array(record(F.lit(""), "original", F.concat_ws("\n", F.when(F.trim("title") != "", F.col("title")), body)))
    summary = F.array(record(F.lit("_summary"), "summary", F.col("summary")))
    questions = F.transform(F.coalesce("hypothetical_questions", F.array().cast("array<string>")), lambda q, i: record(F.concat(F.lit("_q"), i.cast("string")), "question", q))
    every = F.filter(F.concat(original, summary, questions), lambda r: F.trim(r["text"]) != "")
    return good.select(F.col("chunk_id").alias("source_chunk_id"), "source_id", F.explode(every).alias("r")).select("r.*", "source_chunk_id", "source_id"), bad


def drop_redundant_media(media: DataFrame, text: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Media whose vector isn't nearly that of a text of their own section."""
    from ..functions.text import cosine

    m, t = media.alias("m"), text.alias("t")
    near = (F.col("m.heading_path_id") == F.col("t.heading_path_id")) & (cosine(F.col("m.vector"), F.col("t.vector")) > threshold)
    return m.join(t, near, "left_anti")
