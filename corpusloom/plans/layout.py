"""Blocks, media, sections and contents over the provided tables.

Documents stand for parsed books: their lines are blocks, ten lines are a page, and kinds, captions and levels follow from
a line's place and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import blocks as bl
from ..operators import sections as sc
from ..sources.documents import BLOCK
from ..sources.shared import stored
from .content import _LINES, lines
from .registry import Tables, query

_KINDS = "list_value('title', 'paragraph', 'list', 'table', 'chart', 'equation_interline', 'image')[CAST(pos % 7 AS INTEGER) + 1]"


def _pages(t: Tables) -> DataFrame:
    """Raw documents (source_id, pages): each line a block whose content depends on its kind. A document's text makes its pages where it is read; doc_id is unique."""
    kinds = F.array(*[F.lit(k) for k in ("title", "paragraph", "list", "table", "chart", "equation_interline", "image")])
    item = lambda *texts: F.array(*[F.struct(F.lit("text").alias("type"), x.alias("content")) for x in texts], F.struct(F.lit("image").alias("type"), F.lit("not read").alias("content")))
    entry = lambda x: F.struct(F.lit("text").alias("item_type"), item(x).alias("item_content"))

    def block(text: Column, pos: Column) -> Column:
        half = F.floor(F.length(text) / 2).cast("int")
        first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
        fields = {
            "title_content": item(text), "paragraph_content": item(first, second), "list_type": F.when(pos % 2 == 0, "ordered_list").otherwise("bullet"), "list_items": F.array(entry(first), entry(F.lit(" ")), entry(second)),
            "table_caption": item(F.lit("Table")), "table_footnote": item(F.lit("")), "html": F.concat(F.lit("<table><tr><td>"), text, F.lit("</td></tr></table>")), "table_type": None, "chart_caption": item(F.lit("Chart")), "chart_footnote": None,
            "image_caption": None, "image_footnote": None, "content": text, "math_content": text, "image_source": None,
        }
        content = F.struct(*[(F.lit(None) if v is None else v).alias(k) for k, v in fields.items()])
        return F.struct(F.element_at(kinds, (pos % 7 + 1).cast("int")).alias("type"), F.lit(None).alias("sub_type"), F.lit(None).alias("bbox"), content.alias("content")).cast(BLOCK)

    def page(all_: Column, at: Column) -> Column:
        rows = F.transform(F.slice(all_, at + 1, F.lit(10)), lambda x, i: F.struct(x.alias("text"), (at + i).alias("pos")))
        return F.transform(F.filter(rows, lambda r: F.trim(r["text"]) != ""), lambda r: block(r["text"], r["pos"]))

    # exploded, so that conditions on the lines or pages don't make them once more
    rows = t.documents.where("text is not null").select(F.col("doc_id").alias("source_id"), F.explode(F.array(F.split("text", "\n"))).alias("_lines"))
    pages = F.transform(F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(10)), lambda at: page(F.col("_lines"), at))
    return rows.select("source_id", F.explode(F.array(F.filter(pages, lambda x: F.size(x) > 0))).alias("pages"))


_PLACED = f"""{_LINES}, kinds AS (SELECT source_id, pos, text, len, {_KINDS} AS type, dense_rank() OVER (PARTITION BY source_id ORDER BY pos // 10) - 1 AS page_idx, row_number() OVER (PARTITION BY source_id, pos // 10 ORDER BY pos) - 1 AS block_idx FROM lines)"""
_HALVES = "substr(text, 1, len // 2) AS a, substr(text, len // 2 + 1) AS b"


@query(f"""WITH {_PLACED}, h AS (SELECT *, {_HALVES}, CASE WHEN pos % 2 = 0 THEN '1. ' ELSE '- ' END AS m1, CASE WHEN pos % 2 = 0 THEN '3. ' ELSE '- ' END AS m2 FROM kinds),
x AS (SELECT source_id, page_idx, block_idx, type, CASE type WHEN 'title' THEN text WHEN 'paragraph' THEN a || b WHEN 'list' THEN concat_ws(chr(10), CASE WHEN trim(a) <> '' THEN m1 || trim(a) END, CASE WHEN trim(b) <> '' THEN m2 || trim(b) END)
  WHEN 'table' THEN 'Table' || chr(10) || '<table><tr><td>' || text || '</td></tr></table>' WHEN 'chart' THEN 'Chart' || chr(10) || text WHEN 'equation_interline' THEN text END AS text FROM h)
SELECT source_id, page_idx, block_idx, type, sha256(text) AS text_hash FROM x WHERE type <> 'image'""")
def block_texts(t: Tables) -> DataFrame:
    """SRC-02, PRJ-01..04, FLT-01, UDF-06: texts of the blocks of nested pages by their types."""
    blocks, _ = bl.explode_blocks(_pages(t))
    out = bl.filter_block_types(bl.extract_block_text(blocks))
    return out.select("source_id", F.col("page_idx").cast("long").alias("page_idx"), F.col("block_idx").cast("long").alias("block_idx"), "type", F.sha2("text", 256).alias("text_hash"))


@query(f"""WITH RECURSIVE {_PLACED}, s AS (SELECT source_id, text AS snippet, row_number() OVER (PARTITION BY source_id ORDER BY page_idx, block_idx) AS n FROM kinds WHERE type = 'image' AND length(text) >= 20),
r AS (SELECT doc_id AS source_id, text AS clean, 0 AS n FROM documents UNION ALL SELECT r.source_id, replace(clean, snippet, ''), s.n FROM r JOIN s ON s.source_id = r.source_id AND s.n = r.n + 1),
e AS (SELECT source_id, arg_max(clean, n) AS clean FROM r GROUP BY 1), l AS (SELECT s.source_id, count(*) FILTER (contains(clean, snippet)) AS leftovers FROM s JOIN e ON e.source_id = s.source_id GROUP BY 1)
SELECT source_id, length(clean) AS n_left, sha256(clean) AS text_hash, CAST(coalesce(leftovers, 0) AS INTEGER) AS leftovers FROM e LEFT JOIN l USING (source_id)""")
def stripped_images(t: Tables) -> DataFrame:
    """FLT-02, FLT-03: what was made for images goes from the blocks and from the whole text."""
    blocks, _ = bl.explode_blocks(_pages(t))
    _, snippets = bl.strip_image_content(blocks)
    out = bl.strip_snippets(t.documents.select(F.col("doc_id").alias("source_id"), "text"), snippets)
    return out.select("source_id", F.length("clean_text").cast("long").alias("n_left"), F.sha2("clean_text", 256).alias("text_hash"), F.col("leftovers").cast("int").alias("leftovers"))


_MEDIA = """media AS (SELECT source_id, pos // 10 AS page_idx, pos AS block_idx, text, len, list_value('table', 'chart', 'image', 'paragraph')[CAST(len % 4 AS INTEGER) + 1] AS type,
CASE pos % 3 WHEN 0 THEN [] WHEN 1 THEN ['图 ' || pos] ELSE ['表 1', 'of 图 2'] END AS caption, CASE WHEN pos % 2 = 0 THEN '' ELSE text END AS html, 's' || (pos // 4) AS heading_path FROM lines)"""


def _media(t: Tables) -> DataFrame:
    """Lines as blocks with a kind by their length, a caption by their place, a box by their length and a section of four lines."""
    types = F.array(*[F.lit(k) for k in ("table", "chart", "image", "paragraph")])
    none = F.array().cast("array<string>")
    caption = F.when(F.col("pos") % 3 == 0, none).when(F.col("pos") % 3 == 1, F.array(F.concat(F.lit("图 "), F.col("pos").cast("string")))).otherwise(F.array(F.lit("表 1"), F.lit("of 图 2")))
    return lines(t).select(
        "source_id", F.col("page").alias("page_idx"), F.col("pos").alias("block_idx"), "text", "len", F.element_at(types, (F.col("len") % 4 + 1).cast("int")).alias("type"), F.when(F.col("pos") % 2 == 0, "flowchart").alias("sub_type"), caption.alias("caption"),
        F.when(F.col("pos") % 2 == 0, "").otherwise(F.col("text")).alias("html"), F.array(F.lit(0.0), F.lit(0.0), F.col("len") * 10.0, F.col("len") * 8.0).alias("bbox"), F.concat(F.lit("s"), F.floor(F.col("pos") / 4).cast("string")).alias("heading_path"),
    )


@query(f"""WITH {_LINES}, {_MEDIA}, p AS (SELECT *, max(CASE WHEN type = 'paragraph' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, page_idx) AS texted FROM media),
k AS (SELECT *, CASE WHEN type IN ('table', 'chart') THEN type WHEN type = 'image' AND block_idx % 2 = 0 THEN 'figure' END AS kind, array_to_string(caption, ' ') AS c FROM p WHERE NOT (type = 'table' AND trim(html) = '' AND len * 10 > 800 AND len * 8 > 700 AND texted = 0))
SELECT source_id, block_idx, kind AS original_chunk_kind, CASE WHEN kind = 'table' AND block_idx % 3 = 1 THEN 'figure' ELSE kind END AS chunk_kind, row_number() OVER (PARTITION BY source_id, page_idx, kind ORDER BY block_idx) - 1 AS kind_ordinal FROM k WHERE kind IS NOT NULL""")
def media_kinds(t: Tables) -> DataFrame:
    """FLT-04..06, WIN-01: media by kind without cover pages; tables captioned as figures become figures, once."""
    rows = bl.with_ordinal(bl.classify_media(bl.drop_cover_tables(_media(t))).withColumn("original_chunk_kind", F.lit(None).cast("string")))
    out = bl.reroute_kind(bl.reroute_kind(rows))
    return out.select("source_id", F.col("block_idx").cast("long").alias("block_idx"), "original_chunk_kind", "chunk_kind", F.col("kind_ordinal").cast("long").alias("kind_ordinal"))


@query(f"""WITH {_LINES}, {_MEDIA}, i AS (SELECT *, sum(CASE WHEN heading_path IS DISTINCT FROM lag_h THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, page_idx ORDER BY block_idx) AS island FROM (SELECT *, lag(heading_path) OVER (PARTITION BY source_id, page_idx ORDER BY block_idx) AS lag_h FROM media)),
n AS (SELECT *, CASE WHEN block_idx % 3 = 0 THEN min(CASE WHEN block_idx % 3 <> 0 THEN block_idx END) OVER (PARTITION BY source_id, page_idx, island ORDER BY block_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS anchor FROM i)
SELECT source_id, block_idx, 'p' || page_idx || '-b' || coalesce(anchor, block_idx) AS merge_group_id, CASE WHEN anchor IS NOT NULL THEN 'sibling' WHEN count(*) OVER (PARTITION BY source_id, page_idx, coalesce(anchor, block_idx)) > 1 THEN 'anchor' ELSE 'standalone' END AS merge_role FROM n""")
def panel_groups(t: Tables) -> DataFrame:
    """WIN-07: figures without caption join the next one that has a number."""
    return bl.merge_panels(_media(t)).select("source_id", F.col("block_idx").cast("long").alias("block_idx"), "merge_group_id", "merge_role")


_TABLES = """parts AS (SELECT l_orderkey, l_returnflag || l_linestatus AS k, '<tr><td><b>' || l_returnflag || '</b> </td><td> ' || l_linestatus || '</td></tr>' AS raw, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
tabs AS (SELECT o_orderpriority AS source_id, o_orderstatus AS heading_path, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS page_idx, o_orderkey AS block_idx, o_totalprice > 200000 AS captioned FROM orders),
isl AS (SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, heading_path ORDER BY page_idx, block_idx) AS island FROM (SELECT *, coalesce(NOT captioned AND page_idx - lag(page_idx) OVER (PARTITION BY source_id, heading_path ORDER BY page_idx, block_idx) <= 2, false) AS follows FROM tabs)),
merged AS (SELECT source_id, heading_path, page_idx, block_idx, CASE WHEN follows THEN 'sibling' WHEN count(*) OVER (PARTITION BY source_id, heading_path, island) > 1 THEN 'anchor' ELSE 'single' END AS merge_role,
  'p' || first_value(page_idx) OVER g || '-b' || first_value(block_idx) OVER g AS merge_group_id FROM isl WINDOW g AS (PARTITION BY source_id, heading_path, island ORDER BY page_idx, block_idx))"""


def _tables(t: Tables) -> DataFrame:
    """Orders as tables of books (priorities) and headings (states): a day is a page, the lines are the rows."""
    row = F.concat(F.lit("<tr><td><b>"), "l_returnflag", F.lit("</b> </td><td> "), "l_linestatus", F.lit("</td></tr>"))
    body = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    caption = F.when(F.col("o_totalprice") > 200_000, F.array(F.lit("Table"))).otherwise(F.array(F.lit(" ")))
    tables = t.orders.join(body, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    content = F.concat(F.lit("<table><tr><th>Flag</th><th>Status</th></tr>"), F.coalesce("rows", F.lit("")), F.lit("</table>"))
    return tables.select(F.col("o_orderpriority").alias("source_id"), F.col("o_orderstatus").alias("heading_path"), F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("page_idx"), F.col("o_orderkey").alias("block_idx"), caption.alias("caption"), content.alias("content"))


@query(f"""WITH {_TABLES} SELECT source_id, block_idx, merge_role, merge_group_id, CASE WHEN merge_role = 'sibling' THEN merge_group_id END AS anchor FROM merged""")
def crosspage_tables(t: Tables) -> DataFrame:
    """WIN-04, WIN-05: tables that go on over the next pages, and the table that each belongs to."""
    out = bl.resolve_anchor(bl.crosspage_siblings(_tables(t)))
    return out.select("source_id", "block_idx", "merge_role", "merge_group_id", F.when(F.col("anchor").isNotNull(), F.format_string("p%d-b%d", "anchor.page_idx", "anchor.block_idx")).alias("anchor"))


@query(f"""WITH {_TABLES}, r AS (SELECT m.*, k, raw, n FROM merged m JOIN parts ON l_orderkey = block_idx),
x AS (SELECT *, row_number() OVER (PARTITION BY source_id, merge_group_id, k ORDER BY page_idx, block_idx, n) AS f FROM r s WHERE merge_role = 'sibling' AND NOT EXISTS (SELECT 1 FROM r a WHERE a.source_id = s.source_id AND a.merge_group_id = s.merge_group_id AND a.k = s.k AND a.merge_role = 'anchor')),
e AS (SELECT source_id, merge_group_id, string_agg(raw, '' ORDER BY page_idx, block_idx, n) AS extension FROM x WHERE f = 1 GROUP BY 1, 2),
b AS (SELECT l_orderkey, string_agg(raw, '' ORDER BY n) AS body FROM parts GROUP BY 1)
SELECT m.source_id, m.block_idx, CASE merge_role WHEN 'sibling' THEN 'merged_into_anchor' ELSE 'todo' END AS work, length('<table><tr><th>Flag</th><th>Status</th></tr>' || coalesce(body, '') || '</table>') + CASE WHEN merge_role = 'anchor' AND extension IS NOT NULL THEN 1 + length(extension) ELSE 0 END AS content_len,
CASE WHEN merge_role = 'anchor' THEN count(*) OVER (PARTITION BY m.source_id, m.merge_group_id) ELSE 1 END AS n_images FROM merged m LEFT JOIN e ON e.source_id = m.source_id AND e.merge_group_id = m.merge_group_id LEFT JOIN b ON l_orderkey = m.block_idx""")
def media_work(t: Tables) -> DataFrame:
    """WIN-06, PRJ-15: siblings' new rows at the end of their anchor, and what is left to do."""
    merged = stored(bl.crosspage_siblings(_tables(t)).withColumn("image_path", F.col("block_idx").cast("string")))
    out = bl.route_media_work(merged, bl.table_extension(merged))
    return out.select("source_id", "block_idx", "work", F.length("content").cast("long").alias("content_len"), F.size("image_paths").cast("long").alias("n_images"))


@query(f"""WITH {_LINES}, h AS (SELECT source_id, pos, 'S' || (pos // 3) AS sp, left(text, 5) AS head, lag(pos // 3) OVER (PARTITION BY source_id ORDER BY pos) AS b FROM lines)
SELECT source_id, pos, CASE WHEN pos % 20 = 7 THEN 'given' WHEN b = pos // 3 THEN sp || ' > ' || head ELSE sp END AS heading_path FROM h""")
def part_paths(t: Tables) -> DataFrame:
    """WIN-03: parts of one section take their head along; overrides win."""
    rows = lines(t).select("source_id", F.col("pos").alias("position"), F.concat(F.lit("S"), F.floor(F.col("pos") / 3).cast("string")).alias("section_path"), F.substring("text", 1, 5).alias("head"))
    given = rows.where("position % 20 = 7").select("source_id", "position", F.lit("given").alias("heading_path"))
    return bl.heading_paths(rows, given).select("source_id", F.col("position").cast("long").alias("pos"), "heading_path")


@query(f"""WITH {_LINES}, s AS (SELECT *, pos // 8 AS section FROM lines), m AS (SELECT *, min(CASE WHEN regexp_matches(trim(text), '^[DT]') THEN pos END) OVER (PARTITION BY source_id) AS stop, min(CASE WHEN regexp_matches(trim(text), '^[A-E]') THEN pos END) OVER (PARTITION BY source_id, section) AS rest FROM s)
SELECT source_id, pos FROM m WHERE (stop IS NULL OR pos < stop) AND (rest IS NULL OR pos < rest)""")
def truncated_bodies(t: Tables) -> DataFrame:
    """WIN-10: lines before the end marker of their document and of their section."""
    rows = lines(t).withColumn("section", F.floor(F.col("pos") / 8))
    return sc.truncate_body(rows, "^[DT]", "^[A-E]").select("source_id", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {_LINES}, p AS (SELECT source_id, pos // 3 AS page, max(CASE WHEN regexp_matches(text, '^[EI]') THEN 1 ELSE 0 END) AS seed FROM lines GROUP BY 1, 2),
w AS (SELECT *, max(CASE WHEN seed = 1 THEN page END) OVER (PARTITION BY source_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS b, min(CASE WHEN seed = 1 THEN page END) OVER (PARTITION BY source_id ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM p)
SELECT source_id, page FROM w WHERE seed = 1 OR a - b - 1 <= 2""")
def contents_pages(t: Tables) -> DataFrame:
    """WIN-11: pages with a marker and the small gaps between them."""
    rows = lines(t).withColumn("page", F.floor(F.col("pos") / 3))
    return sc.contents_pages(rows, "^[EI]").select("source_id", F.col("page").cast("long").alias("page"))


@query(f"""WITH {_LINES}, k AS (SELECT source_id, pos, text, ['table', 'chart', 'figure'][CAST(pos % 3 AS INTEGER) + 1] AS chunk_kind FROM lines),
s AS (SELECT source_id, pos, chunk_kind, unnest([1, 2, 3, 4]) AS place, unnest([text, '  ', CASE WHEN pos % 5 = 0 THEN text || chr(10) || text WHEN chunk_kind = 'table' THEN '<table><tr><td>' || text || '</td></tr></table>' WHEN chunk_kind = 'chart' THEN '|a|b|' || chr(10) || '|' || text || '|1|' ELSE 'graph TD ' || text END, chunk_kind]) AS said FROM k),
f AS (SELECT *, CASE chunk_kind WHEN 'table' THEN contains(said, '<table') OR contains(said, '<td>') WHEN 'chart' THEN length(said) - length(replace(said, '|', '')) >= 4 AND contains(said, chr(10)) ELSE contains(lower(said), 'mermaid') OR contains(said, 'graph TD') OR contains(said, 'graph LR') END AS fits FROM s WHERE trim(said) <> '')
SELECT k.source_id, k.pos, k.chunk_kind, CASE WHEN b.said IS NULL THEN 'none' ELSE 'second' END AS content_source, sha256(b.said) AS content_hash FROM k LEFT JOIN (SELECT source_id, pos, arg_min(said, place) AS said FROM f WHERE fits GROUP BY 1, 2) b USING (source_id, pos)""")
def nested_bodies(t: Tables) -> DataFrame:
    """JN-01: missing bodies of tables, charts and figures from strings somewhere in the nested block of a second source."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("table", "chart", "figure")]), (F.col("pos") % 3 + 1).cast("int"))
    rows = lines(t).select("source_id", F.col("pos").alias("page_idx"), kind.alias("chunk_kind"), F.lit(0).alias("kind_ordinal"), "text")
    body = F.when(F.col("page_idx") % 5 == 0, F.concat_ws("\n", "text", "text")).when(F.col("chunk_kind") == "table", F.concat(F.lit("<table><tr><td>"), "text", F.lit("</td></tr></table>"))).when(F.col("chunk_kind") == "chart", F.concat(F.lit("|a|b|\n|"), "text", F.lit("|1|"))).otherwise(F.concat(F.lit("graph TD "), "text"))
    span = F.struct(F.lit("  ").alias("blank"), body.alias("body"), F.array(F.lit(1.5), F.lit(2.0)).alias("box"))
    block = F.to_json(F.struct(F.array("text").alias("caption"), F.array(F.struct(F.array(span).alias("spans"))).alias("lines"), F.col("chunk_kind").alias("type")))
    second = bl.nested_bodies(rows.withColumn("block", block))
    out = bl.recover_content(rows.drop("text").withColumn("content", F.lit(" ")), second)
    return out.select("source_id", F.col("page_idx").cast("long").alias("pos"), "chunk_kind", "content_source", F.when(F.col("content_source") == "second", F.sha2("content", 256)).alias("content_hash"))


_TITLED = """titled AS (SELECT source_id, pos, CASE WHEN pos % 4 = 1 THEN '第' || (pos // 4 + 1) || '章' WHEN pos % 4 = 2 THEN '第' || (pos // 4 + 1) || '节 ' || left(text, 8) ELSE left(text, 8) END AS text, text AS line FROM lines)"""


def _titled(t: Tables) -> DataFrame:
    """Lines as titles: of four, one is a bare chapter number and one a numbered section."""
    n = (F.floor(F.col("pos") / 4) + 1).cast("string")
    text = F.when(F.col("pos") % 4 == 1, F.concat(F.lit("第"), n, F.lit("章"))).when(F.col("pos") % 4 == 2, F.concat(F.lit("第"), n, F.lit("节 "), F.substring("text", 1, 8))).otherwise(F.substring("text", 1, 8))
    return lines(t).select("source_id", "pos", "page", text.alias("text"), F.col("text").alias("line"))


@query(f"""WITH {_LINES}, {_TITLED}, x AS (SELECT *, regexp_matches(text, '^第[0-9]+章$') AS bare, lead(text) OVER w AS nxt, lag(text) OVER w AS prv FROM titled WINDOW w AS (PARTITION BY source_id ORDER BY pos))
SELECT source_id, pos, CASE WHEN bare AND nxt IS NOT NULL AND NOT regexp_matches(nxt, '^第[0-9]+章$') THEN text || ' ' || nxt ELSE text END AS title FROM x WHERE NOT coalesce(regexp_matches(prv, '^第[0-9]+章$'), false) OR bare""")
def merged_titles(t: Tables) -> DataFrame:
    """WIN-12: a bare chapter number takes the next title along."""
    return sc.merge_split_titles(_titled(t)).select("source_id", F.col("pos").cast("long").alias("pos"), F.col("text").alias("title"))


_TOC = f"""{_LINES}, {_TITLED}, toc AS (SELECT source_id, pos, CASE WHEN pos % 4 = 1 THEN 1 WHEN pos % 4 = 2 THEN 2 ELSE 3 END AS level, text, regexp_replace(text, '\\s+', '', 'g') AS key FROM titled WHERE regexp_matches(text, '^(第[0-9]+章|第[0-9]+节|[A-DÀ-Ý])')),
anc AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level <= 2 THEN pos END) OVER w AS p2 FROM toc WINDOW w AS (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dict AS (SELECT a.source_id, a.pos, a.level, a.text, a.key, concat_ws('|', CASE WHEN a.level > 1 THEN x.text END, CASE WHEN a.level > 2 AND y.level = 2 THEN y.text END) AS path,
  CASE WHEN a.level > 2 AND y.level = 2 THEN y.text WHEN a.level > 1 THEN x.text END AS parent FROM anc a LEFT JOIN toc x ON x.source_id = a.source_id AND x.pos = a.p1 LEFT JOIN toc y ON y.source_id = a.source_id AND y.pos = a.p2)"""
_LEVELS = ["^第[0-9]+章", "^第[0-9]+节", "^[A-DÀ-Ý]"]


def _toc(t: Tables) -> DataFrame:
    return sc.contents_dictionary(_titled(t).select("source_id", "pos", "text"), _LEVELS)


@query(f"WITH {_TOC} SELECT source_id, pos, level, key, path FROM dict")
def contents_dictionary(t: Tables) -> DataFrame:
    """CHK-01, FN-06: contents lines with their levels, keys and the titles above them."""
    return _toc(t).select("source_id", F.col("pos").cast("long").alias("pos"), "level", "key", F.array_join("ancestors", "|").alias("path"))


# contents with names that come back in many chapters, as read line by line: a place takes the entry whose path is the stack
_NAMED = f"""{_LINES}, named AS (SELECT source_id, pos, len, CASE pos % 4 WHEN 1 THEN '第' || (pos // 4 + 1) || '章' WHEN 2 THEN '节' || left(text, 1) ELSE left(text, 1) END AS text FROM lines),
toc AS (SELECT *, CASE pos % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS level FROM named WHERE regexp_matches(text, '^(第[0-9]+章|节|[A-Za-z])$|^节[A-Za-z]$')),
above AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level <= 2 THEN pos END) OVER w AS p2 FROM toc WINDOW w AS (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
entries AS (SELECT a.source_id, a.pos, a.level, a.text, concat_ws('|', CASE WHEN a.level > 1 THEN x.text END, CASE WHEN a.level > 2 AND y.level = 2 THEN y.text END) AS path FROM above a LEFT JOIN toc x ON x.source_id = a.source_id AND x.pos = a.p1 LEFT JOIN toc y ON y.source_id = a.source_id AND y.pos = a.p2),
cands AS MATERIALIZED (SELECT source_id, text, list({{'pos': pos, 'level': level, 'path': path}} ORDER BY pos) AS c FROM entries GROUP BY 1, 2),
body AS MATERIALIZED (SELECT n.source_id, n.pos, n.len, n.text, c, row_number() OVER (PARTITION BY n.source_id ORDER BY n.pos) AS i FROM named n LEFT JOIN cands k ON k.source_id = n.source_id AND k.text = n.text WHERE n.pos % 9 <> 4),
picked AS (SELECT source_id, 0::BIGINT AS i, NULL::BIGINT AS pos, [NULL, NULL, NULL]::VARCHAR[] AS stack, NULL::STRUCT(pos BIGINT, "level" INTEGER, path VARCHAR) AS hit FROM (SELECT DISTINCT source_id FROM body) UNION ALL
  SELECT source_id, i, pos, CASE WHEN hit IS NULL THEN stack ELSE list_transform([1, 2, 3], lambda j: CASE WHEN j < hit.level THEN stack[j] WHEN j = hit.level THEN text END) END, hit FROM
  (SELECT b.source_id, b.i, b.pos, b.text, p.stack, CASE WHEN len(c) = 1 THEN c[1] ELSE coalesce(list_filter(c, lambda e: e.path = concat_ws('|', CASE WHEN e.level > 1 THEN p.stack[1] END, CASE WHEN e.level > 2 THEN p.stack[2] END))[1], c[1]) END AS hit FROM picked p JOIN body b ON b.source_id = p.source_id AND b.i = p.i + 1))"""


def _named(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as titles with short names under numbered chapters; their contents table; and the body, in which some titles are lost."""
    first = F.substring("text", 1, 1)
    text = F.when(F.col("pos") % 4 == 1, F.concat(F.lit("第"), (F.floor(F.col("pos") / 4) + 1).cast("string"), F.lit("章"))).when(F.col("pos") % 4 == 2, F.concat(F.lit("节"), first)).otherwise(first)
    rows = lines(t).select("source_id", "pos", "len", text.alias("text"))
    toc = sc.contents_dictionary(rows.select("source_id", "pos", "text"), ["^第[0-9]+章$", "^节[A-Za-z]$", "^[A-Za-z]$"])
    return rows, toc, rows.where("pos % 9 <> 4")


@query(f"WITH RECURSIVE {_NAMED} SELECT source_id, pos, hit.pos AS toc_pos FROM picked WHERE i > 0")
def matched_titles(t: Tables) -> DataFrame:
    """JN-20: titles with their contents entry; of several with one name, that of the chapter and section the title stands in."""
    _, toc, body = _named(t)
    out = sc.match_titles(body, toc, 3)
    return out.select("source_id", F.col("pos").cast("long").alias("pos"), F.col("match.toc_pos").cast("long").alias("toc_pos"))


@query(f"""WITH RECURSIVE {_NAMED}, c AS (SELECT p.source_id, p.pos, e.level, concat_ws('|', nullif(e.path, ''), e.text) AS path, list_value('exact', 'merged', 'page_header', 'exact')[CAST(b.len % 4 AS INTEGER) + 1] AS action FROM picked p JOIN entries e ON e.source_id = p.source_id AND e.pos = p.hit.pos JOIN body b ON b.source_id = p.source_id AND b.pos = p.pos),
u AS (SELECT source_id, pos, sum(len) OVER (PARTITION BY source_id ORDER BY pos) AS upto FROM named),
g AS (SELECT c.*, coalesce(lead(upto) OVER (PARTITION BY c.source_id ORDER BY c.pos) - upto, 2147483648) AS gap FROM c JOIN u USING (source_id, pos)),
w AS (SELECT *, CASE WHEN action = 'merged' OR (action = 'exact' AND gap >= 50) THEN 2 WHEN action <> 'page_header' THEN 1 ELSE 0 END AS weight FROM g)
SELECT source_id, level, path, arg_max(pos, weight * 1000000 + pos) AS pos FROM w GROUP BY 1, 2, 3""")
def section_starts(t: Tables) -> DataFrame:
    """WIN-08: the true start of each section, by its level and full path, among the places that read like it."""
    rows, toc, body = _named(t)
    actions = F.array(*[F.lit(a) for a in ("exact", "merged", "page_header", "exact")])
    candidates = body.select("source_id", "pos", tx.strict_key(F.col("text")).alias("key"), F.element_at(actions, (F.col("len") % 4 + 1).cast("int")).alias("action"))
    return sc.section_starts(candidates, toc, rows, 3).select("source_id", "level", F.array_join("path", "|").alias("path"), F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {_TOC}, b AS (SELECT DISTINCT source_id, level, lower(key) AS key FROM dict), t AS (SELECT DISTINCT source_id, level, key FROM dict)
SELECT source_id, level, key, CASE WHEN t.k IS NULL THEN 'body_only' ELSE 'contents_only' END AS side FROM (SELECT *, 1 AS k FROM t) t FULL JOIN (SELECT *, 1 AS k FROM b) b USING (source_id, level, key) WHERE t.k IS NULL OR b.k IS NULL""")
def title_differences(t: Tables) -> DataFrame:
    """JN-27: keys that only the contents or only the (here lower-case) body has."""
    toc = _toc(t)
    return sc.title_differences(toc, toc.withColumn("key", F.lower("key")))


@query(f"""WITH {_TOC}, r AS (SELECT source_id, pos, level, CASE WHEN key = '第1章' THEN '第1章 起' ELSE text END AS text, 0 AS after FROM dict), k AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS key FROM r),
i AS (SELECT source_id, min(pos) AS pos, 2 AS level, '新节' AS text, 1 AS after FROM k WHERE key = '第2章' GROUP BY 1), u AS (SELECT source_id, pos, level, text, after FROM k UNION ALL SELECT * FROM i),
n AS (SELECT source_id, level, text, row_number() OVER (PARTITION BY source_id ORDER BY pos, after, text) - 1 AS pos FROM u),
a AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level <= 2 THEN pos END) OVER w AS p2 FROM n WINDOW w AS (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT a.source_id, a.pos, a.level, a.text AS title, concat_ws('|', CASE WHEN a.level > 1 THEN x.text END, CASE WHEN a.level > 2 AND y.level = 2 THEN y.text END) AS path FROM a LEFT JOIN n x ON x.source_id = a.source_id AND x.pos = a.p1 LEFT JOIN n y ON y.source_id = a.source_id AND y.pos = a.p2""")
def patched_contents(t: Tables) -> DataFrame:
    """FN-08: a corrected title, an entry put in after its anchor, and paths built anew."""
    spark = t.documents.sparkSession
    replace = spark.createDataFrame([("第1章", "第1章 起")], "key string, title string")
    insert = spark.createDataFrame([("第2章", 2, "新节")], "anchor_key string, level int, title string")
    out = sc.apply_patches(_toc(t), replace, insert, 3)
    return out.select("source_id", F.col("pos").cast("long").alias("pos"), "level", F.col("text").alias("title"), F.array_join("ancestors", "|").alias("path"))


@query(f"""WITH {_LINES}, {_TITLED}, ty AS (SELECT source_id, pos, pos // 10 AS page, CASE pos % 5 WHEN 0 THEN 'paragraph' WHEN 4 THEN 'page_header' ELSE 'title' END AS type, CASE WHEN pos % 5 = 0 THEN text || ' ' || pos ELSE text END AS text FROM titled),
toc AS (SELECT DISTINCT source_id, text, regexp_replace(text, '\\s+', '', 'g') AS key FROM titled WHERE pos % 3 <> 0), known AS (SELECT DISTINCT source_id, key FROM toc),
ti AS (SELECT source_id, pos, text, regexp_matches(text, '^第[0-9]+章$') AS bare, lead(text) OVER w AS nxt, lag(text) OVER w AS prv FROM ty WHERE type = 'title' WINDOW w AS (PARTITION BY source_id ORDER BY pos)),
ex AS (SELECT source_id, pos, regexp_replace(text, '\\s+', '', 'g') AS key, 'exact' AS action FROM ti SEMI JOIN known k ON k.source_id = ti.source_id AND k.key = regexp_replace(ti.text, '\\s+', '', 'g')),
mt AS (SELECT source_id, pos, regexp_replace(CASE WHEN bare AND nxt IS NOT NULL AND NOT regexp_matches(nxt, '^第[0-9]+章$') THEN text || ' ' || nxt ELSE text END, '\\s+', '', 'g') AS key FROM ti WHERE NOT coalesce(regexp_matches(prv, '^第[0-9]+章$'), false) OR bare),
me AS (SELECT source_id, pos, key, 'merged' AS action FROM mt SEMI JOIN known USING (source_id, key) ANTI JOIN ex USING (source_id, pos)),
nk AS (SELECT source_id, pos, regexp_replace(text, '\\s+', '', 'g') AS key FROM ti), lo AS (SELECT * FROM nk ANTI JOIN known USING (source_id, key)),
ba AS (SELECT source_id, regexp_replace(regexp_replace(text, '^第[0-9]+[章节]\\s*', ''), '\\s+', '', 'g') AS key, min(key) AS whole FROM toc WHERE regexp_matches(text, '^第[0-9]+[章节]\\s*') GROUP BY 1, 2),
re AS (SELECT source_id, pos, whole AS key, 'rebuilt' AS action FROM lo JOIN ba USING (source_id, key)),
pa AS (SELECT source_id, pos, regexp_replace(regexp_replace(trim(text), '\\s(\\d+)$', ''), '\\s+', '', 'g') AS key, 'contents_line' AS action FROM ty WHERE type = 'paragraph'), mi AS (SELECT * FROM pa SEMI JOIN known USING (source_id, key)),
hd AS (SELECT source_id, page, pos, regexp_replace(text, '\\s+', '', 'g') AS key FROM ty WHERE type = 'page_header'), he AS (SELECT source_id, arg_min(pos, (page, pos)) AS pos, key, 'page_header' AS action FROM hd SEMI JOIN known USING (source_id, key) GROUP BY source_id, key)
SELECT * FROM ex UNION ALL SELECT * FROM me UNION ALL SELECT * FROM re UNION ALL SELECT * FROM mi UNION ALL SELECT source_id, pos, key, action FROM he""")
def title_candidates(t: Tables) -> DataFrame:
    """CHK-02, WIN-16: places where a contents entry may start, by what shows it."""
    rows = _titled(t)
    kind = F.when(F.col("pos") % 5 == 0, "paragraph").when(F.col("pos") % 5 == 4, "page_header").otherwise("title")
    blocks = rows.select("source_id", "pos", "page", kind.alias("type"), F.when(F.col("pos") % 5 == 0, F.concat_ws(" ", "text", F.col("pos").cast("string"))).otherwise(F.col("text")).alias("text"))
    toc = rows.where("pos % 3 <> 0").select("source_id", "text", tx.strict_key(F.col("text")).alias("key")).distinct()
    return sc.title_candidates(blocks, toc).select("source_id", F.col("pos").cast("long").alias("pos"), "key", "action")


@query("""WITH n AS (SELECT l_orderkey AS source_id, l_linenumber AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS pos FROM lineitem), e AS (SELECT *, coalesce(lag(number) OVER (PARTITION BY source_id ORDER BY pos) + 1, 1) AS expected FROM n)
SELECT source_id, pos, number, expected FROM e WHERE number <> expected""")
def numbering_gaps(t: Tables) -> DataFrame:
    """WIN-13: lines of an order, by part, whose number doesn't follow the one before."""
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber"))
    entries = t.lineitem.select(F.col("l_orderkey").alias("source_id"), F.lit("p").alias("parent"), pos.cast("long").alias("pos"), F.col("l_linenumber").alias("number"))
    return sc.numbering_gaps(entries).select("source_id", "pos", "number", "expected")


@query("""WITH o AS (SELECT l_orderkey AS source_id, l_partkey AS parsed_page, l_partkey - CASE WHEN l_quantity > 40 THEN CAST(l_quantity AS BIGINT) ELSE l_linenumber // 3 END AS printed_page FROM lineitem),
f AS (SELECT source_id, parsed_page, parsed_page - printed_page AS off FROM o), c AS (SELECT source_id, off, count(*) AS n FROM f GROUP BY 1, 2), u AS (SELECT source_id, arg_min(off, (-n, off)) AS usual FROM c GROUP BY 1)
SELECT source_id, parsed_page, off AS "offset", usual FROM f JOIN u USING (source_id) WHERE abs(off - usual) > 5""")
def page_offsets(t: Tables) -> DataFrame:
    """WIN-14: entries whose page offset is far from the usual one."""
    printed = F.col("l_partkey") - F.when(F.col("l_quantity") > 40, F.col("l_quantity").cast("long")).otherwise(F.floor(F.col("l_linenumber") / 3).cast("long"))
    entries = t.lineitem.select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("parsed_page"), printed.alias("printed_page"))
    return sc.offset_outliers(entries).select("source_id", "parsed_page", "offset", "usual")


@query("""WITH s AS (SELECT o_custkey AS source_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS toc_pos, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS pos FROM orders),
h AS (SELECT *, max(pos) OVER (PARTITION BY source_id ORDER BY toc_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s) SELECT source_id, toc_pos, pos, before FROM h WHERE pos <= before""")
def order_violations(t: Tables) -> DataFrame:
    """WIN-15: orders that are older than an earlier one of their customer."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    starts = t.orders.select(F.col("o_custkey").alias("source_id"), place.alias("toc_pos"), F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long").alias("pos"))
    return sc.order_violations(starts).select("source_id", "toc_pos", "pos", "before")


@query(f"""WITH RECURSIVE {_LINES}, flat AS (SELECT source_id, pos, pos // 10 AS page, trim(text) AS text FROM lines), par AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY pos) - 1 AS i, page, left(text, 30) AS head FROM flat WHERE pos % 4 = 0),
c AS (SELECT p.source_id, i, pos FROM par p JOIN flat f ON f.source_id = p.source_id AND f.page = p.page AND starts_with(f.text, head)),
loc AS (SELECT source_id, -1::BIGINT AS i, -1::BIGINT AS pos FROM (SELECT DISTINCT source_id FROM par) UNION ALL SELECT loc.source_id, loc.i + 1, min(c.pos) FROM loc JOIN c ON c.source_id = loc.source_id AND c.i = loc.i + 1 AND c.pos > loc.pos GROUP BY loc.source_id, loc.i)
SELECT source_id, i AS parent_idx, pos AS start, lead(pos) OVER (PARTITION BY source_id ORDER BY i) AS "end" FROM loc WHERE i >= 0""")
def located_parents(t: Tables) -> DataFrame:
    """JN-03: starts of parents (every fourth line) found again by page and the first 30 characters."""
    from pyspark.sql import Window as W

    flat = lines(t).select("source_id", "pos", "page", "text")
    index = F.row_number().over(W.partitionBy("source_id").orderBy("pos")) - 1
    parents = flat.where("pos % 4 = 0").select("source_id", index.alias("parent_idx"), "page", F.substring(F.trim("text"), 1, 30).alias("head"))
    return sc.locate_parents(parents, flat)


@query(f"""WITH {_LINES} SELECT source_id, pos, CASE WHEN pos % 3 = 0 THEN 'path ' || pos ELSE 'path ' || (pos - pos % 3) END AS section_path FROM lines WHERE (source_id, pos - pos % 3) IN (SELECT (source_id, pos) FROM lines)""")
def aligned_sections(t: Tables) -> DataFrame:
    """JN-04: lines as parts of sections (three lines each) matched to the ordered list, which has absorbed sections in between."""
    rows = lines(t)
    head = F.col("pos") - F.col("pos") % 3
    own = rows.select("source_id", head.alias("h")).join(rows.select("source_id", F.col("pos").alias("h")), ["source_id", "h"], "left_semi").distinct()
    sections = own.select("source_id", F.col("h").alias("pos"), F.lit(1).alias("level"), F.concat(F.lit("t"), F.col("h").cast("string")).alias("title"), F.concat(F.lit("path "), F.col("h").cast("string")).alias("path"))
    absorbed = own.select("source_id", (F.col("h") + 1).alias("pos"), F.lit(2).alias("level"), F.lit("absorbed").alias("title"), F.lit("none").alias("path"))
    parents = rows.withColumn("h", head).join(own, ["source_id", "h"], "left_semi").select("source_id", "pos", F.lit(1).alias("level"), F.concat(F.lit("t"), F.col("h").cast("string")).alias("title"))
    return sc.align_sections(parents, sections.unionByName(absorbed))
