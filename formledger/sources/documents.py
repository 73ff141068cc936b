"""Word-processing documents: containers to node rows, and facts from nodes.

``scan`` reads files as binary rows and flattens the XML of the parts in Python, one file at a time (the only step that
built-in functions can't express); what isn't a document becomes a row of ``problems``.  Everything after that is joins,
windows and aggregations over nodes.  Millions of small files are better kept as rows of a table (file, content): ``flattened`` and
``parts_of`` take these, with no file for each to be listed, opened and scheduled.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import facts

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARTS = ("word/document.xml", "word/styles.xml", "word/numbering.xml", "word/settings.xml")
MAX_NODES = 200_000  #: of one document; larger ones become a problem row
MAX_BYTES = 256 << 20
TOGETHER = 8192  #: nodes of small documents that go to Spark at once
NODES = "doc_id string, file string, part_name string, pos long, path string, parent_path string, node_type string, text string, attributes map<string,string>, problem string, size_bytes long"


def _walk(part: str, root: ElementTree.Element) -> Iterator[tuple]:
    """Nodes in document order: path with 1-based steps among siblings of a type, type, own text, attributes."""
    stack = [(root, "", "/" + root.tag.rpartition("}")[2])]
    while stack:
        node, parent, path = stack.pop()
        kind = node.tag.rpartition("}")[2]
        attributes = {k.rpartition("}")[2]: v for k, v in node.attrib.items()}
        yield part, path, parent, kind, node.text if kind in ("t", "instrText") else None, attributes
        seen: dict[str, int] = {}
        below = []
        for child in node:
            name = child.tag.rpartition("}")[2]
            seen[name] = seen.get(name, 0) + 1
            below.append((child, path, f"{path}/{name}[{seen[name]}]"))
        stack += reversed(below)


def _file_rows(doc_id: str, path: str, content: bytes) -> list[tuple]:
    bad = lambda why: [(doc_id, path, None, 0, None, None, None, None, None, why, len(content))]
    if len(content) > MAX_BYTES:
        return bad("too_large")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as box:
            names = set(box.namelist())
            if PARTS[0] not in names:
                return bad("no_document_part")
            nodes = [n for p in PARTS if p in names for n in _walk(p, ElementTree.fromstring(box.read(p)))]
    except zipfile.BadZipFile:
        return bad("not_a_container")
    except ElementTree.ParseError:
        return bad("broken_xml")
    if len(nodes) > MAX_NODES:
        return bad("too_many_nodes")
    return [(doc_id, path, part, i, p, up, kind, text, attributes, None, len(content)) for i, (part, p, up, kind, text, attributes) in enumerate(nodes)]


def _nodes_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    counts, keys, values = [0], [], []
    missing = []
    for a in columns[8]:
        missing.append(a is None)
        keys += a or ()
        values += a.values() if a else ()
        counts.append(len(keys))
    offsets = pa.array(counts, pa.int32()) if not any(missing) else pa.array([None if m else c for c, m in zip(counts, [*missing, False])], pa.int32())
    maps = pa.MapArray.from_arrays(offsets, pa.array(keys, pa.string()), pa.array(values, pa.string()))
    kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in NODES.split(", ")]
    arrays = [maps if i == 8 else pa.array(c, kinds[i]) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in NODES.split(", ")])


def files_below(spark: SparkSession, folder: str, glob: str = "*.docx") -> DataFrame:
    """file, content of all files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("file"), "content")


def flattened(files: DataFrame) -> DataFrame:
    """``NODES`` rows of files (file, content): a node each, or one row with a problem; the id of a document is the hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for doc_id, path, content in zip(*batch.columns):
                held += _file_rows(doc_id.as_py(), path.as_py(), content.as_py())
                if len(held) >= TOGETHER:
                    yield _nodes_batch(held)
                    held = []
        if held:
            yield _nodes_batch(held)

    return files.select(F.sha2("content", 256).alias("doc_id"), "file", "content").mapInArrow(run, NODES)


def told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, problems) of ``flattened`` rows."""
    return rows.where("problem IS NULL").drop("problem"), rows.where("problem IS NOT NULL").select("doc_id", "file", "problem", "size_bytes")


def format_nodes(rows: DataFrame, texts: bool = True) -> DataFrame:
    """Of ``flattened`` rows what ``paragraphs``, ``styles`` and ``paragraph_formats`` take, the first node of each document, and problems.

    Without ``texts`` the paragraphs' previews are empty; most of the bytes of a document are its texts and runs.
    """
    kind, up = F.col("node_type"), F.col("parent_path")
    body = (F.col("part_name") == PARTS[0]) & (kind.isin("p", "pStyle", *["t"] * texts) | up.rlike(r"/p\[[0-9]+\]/pPr\[1\]$"))
    style = (F.col("part_name") == PARTS[1]) & (kind.isin("style", "name", "basedOn") | up.rlike(r"/[pr]Pr\[1\]$"))
    return rows.where(body | style | (F.col("pos") == 0) | F.col("problem").isNotNull())


def scan(spark: SparkSession, folder: str, glob: str = "*.docx") -> tuple[DataFrame, DataFrame]:
    """(nodes, problems) of all files below a folder; the id of a document is the hash of its bytes."""
    return told_apart(flattened(files_below(spark, folder, glob)))


def _under(nodes: DataFrame, kind: str, *keep: str) -> DataFrame:
    return nodes.where(F.col("node_type") == kind).select("doc_id", *keep)


def styles(nodes: DataFrame) -> DataFrame:
    """doc_id, style_id, style_type, style_name, based_on."""
    style = nodes.where((F.col("node_type") == "style") & (F.col("part_name") == PARTS[1])).select("doc_id", F.col("path").alias("at"), F.col("attributes")["styleId"].alias("style_id"), F.col("attributes")["type"].alias("style_type"))
    child = nodes.where(F.col("node_type").isin("name", "basedOn") & (F.col("part_name") == PARTS[1])).select("doc_id", F.col("parent_path").alias("at"), "node_type", F.col("attributes")["val"].alias("val"))
    wide = child.groupBy("doc_id", "at").agg(F.max(F.when(F.col("node_type") == "name", F.col("val"))).alias("style_name"), F.max(F.when(F.col("node_type") == "basedOn", F.col("val"))).alias("based_on"))
    return style.join(wide, ["doc_id", "at"], "left").drop("at")


def paragraphs(nodes: DataFrame) -> DataFrame:
    """doc_id, element_id, paragraph_index, style_id, text_preview, in_cell: in document order, those in cells too."""
    body = nodes.where(F.col("part_name") == PARTS[0])
    p = body.where("node_type = 'p'").select("doc_id", "path", "pos")
    paragraph = F.regexp_extract("path", r"^(.*/p\[[0-9]+\])/", 1)
    text = body.where("node_type = 't'").select("doc_id", paragraph.alias("path"), "pos", "text")
    texts = text.groupBy("doc_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))
    style = body.where("node_type = 'pStyle'").select("doc_id", F.regexp_extract("path", r"^(.*/p\[[0-9]+\])/pPr", 1).alias("path"), F.col("attributes")["val"].alias("style_id"))
    rows = p.join(texts, ["doc_id", "path"], "left").join(style, ["doc_id", "path"], "left")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("paragraph_index", index).select("doc_id", scalars.paragraph_id(F.col("paragraph_index")).alias("element_id"), "paragraph_index", "style_id", scalars.preview(F.coalesce("text", F.lit(""))).alias("text_preview"), F.col("path").contains("/tc[").alias("in_cell"), "path")


def cells(nodes: DataFrame) -> DataFrame:
    """doc_id, cell_id, table_index, row_index, column_index, cell_role; nested tables have numbers of their own."""
    body = nodes.where(F.col("part_name") == PARTS[0])
    tables = body.where("node_type = 'tbl'").select("doc_id", "path", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("table_index"))
    rows = body.where("node_type = 'tc'").select("doc_id", "path", F.regexp_extract("path", r"^(.*/tbl\[[0-9]+\])/tr\[[0-9]+\]/tc\[[0-9]+\]$", 1).alias("table"), *[F.regexp_extract("path", r"/tr\[([0-9]+)\]/tc\[([0-9]+)\]$", i).cast("int").alias(n) for i, n in ((1, "row_index"), (2, "column_index"))])
    out = rows.join(tables.withColumnRenamed("path", "table"), ["doc_id", "table"])
    return out.select("doc_id", scalars.cell_id(F.col("table_index"), F.col("row_index"), F.col("column_index")).alias("cell_id"), "table_index", "row_index", "column_index", scalars.cell_role(F.col("row_index"), F.col("column_index")).alias("cell_role"))


def cell_paragraphs(nodes: DataFrame) -> DataFrame:
    """doc_id, cell_id, vertical_alignment, fact_id, element_id, style_id, text_preview: the paragraphs below each cell, those of tables inside it too.

    A paragraph belongs to each cell around it and is numbered there in document order.
    """
    body = nodes.where(F.col("part_name") == PARTS[0])
    vertical = body.where((F.col("node_type") == "vAlign") & F.col("parent_path").endswith("/tcPr[1]")).select("doc_id", F.regexp_replace("parent_path", r"/tcPr\[1\]$", "").alias("cell_path"), F.col("attributes")["val"].alias("vertical_alignment"))
    around = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/")), lambda x: x.rlike(r"/tc\[[0-9]+\]$"))
    inner = paragraphs(nodes).where("in_cell").withColumn("cell_path", F.explode(around))
    places = body.where("node_type = 'tc'").select("doc_id", F.col("path").alias("cell_path"), F.regexp_extract("path", r"^(.*/tbl\[[0-9]+\])/tr\[[0-9]+\]/tc\[[0-9]+\]$", 1).alias("table"), *[F.regexp_extract("path", r"/tr\[([0-9]+)\]/tc\[([0-9]+)\]$", i).cast("int").alias(n) for i, n in ((1, "r"), (2, "c"))])
    tables = body.where("node_type = 'tbl'").select("doc_id", F.col("path").alias("table"), F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("t"))
    named = places.join(tables, ["doc_id", "table"]).select("doc_id", "cell_path", scalars.cell_id(F.col("t"), F.col("r"), F.col("c")).alias("cell_id"))
    rows = named.join(vertical, ["doc_id", "cell_path"], "left").join(inner, ["doc_id", "cell_path"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "cell_id").orderBy("paragraph_index"))
    return rows.select("doc_id", "cell_id", "vertical_alignment", F.format_string("%s-p%03d", F.col("cell_id"), nth).alias("fact_id"), "element_id", "style_id", "text_preview")


def document_summary(nodes: DataFrame) -> DataFrame:
    """doc_id, counts of nodes, parts, paragraphs, tables and sections, and whether a document has a table of contents, forms, revisions, protection."""
    kind, a = F.col("node_type"), F.col("attributes")
    is_toc = (kind == "instrText") & F.upper(F.trim("text")).startswith("TOC") | (kind == "fldSimple") & F.upper(F.trim(a["instr"])).startswith("TOC") | (kind == "docPartGallery") & (a["val"] == "Table of Contents")
    has = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    here = F.col("part_name") == PARTS[0]
    count = lambda k: F.count_if((kind == k) & here)
    return nodes.groupBy("doc_id").agg(
        F.count("*").alias("n_nodes"),
        F.countDistinct("part_name").alias("n_parts"),
        count("p").alias("n_paragraphs"),
        count("tbl").alias("n_tables"),
        count("sectPr").alias("n_sections"),
        has(is_toc).alias("has_toc"),
        has(kind.isin("sdt", "ffData")).alias("has_forms"),
        has(kind.isin("ins", "del", "moveFrom", "moveTo", "rPrChange", "pPrChange")).alias("has_revisions"),
        has((kind == "documentProtection") & ~F.coalesce(a["enforcement"], F.lit("1")).isin("0", "false")).alias("has_protection"),
    )


def parts(spark: SparkSession, folder: str, glob: str = "*.docx") -> DataFrame:
    """file, part_name, sha256, size_bytes of every part of every container below a folder; other files have none."""
    return parts_of(files_below(spark, folder, glob))


def parts_of(files: DataFrame) -> DataFrame:
    """The same of files (file, content)."""
    schema = pa.schema([("file", pa.string()), ("part_name", pa.string()), ("sha256", pa.string()), ("size_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, content in zip(*batch.columns):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as box:
                        found += [(path.as_py(), n, hashlib.sha256(c := box.read(n)).hexdigest(), len(c)) for n in box.namelist()]
                except zipfile.BadZipFile:
                    pass
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return files.select("file", "content").mapInArrow(run, "file string, part_name string, sha256 string, size_bytes long")


def table_shapes(cell_rows: DataFrame) -> DataFrame:
    return cell_rows.groupBy("doc_id", "table_index").agg(F.max("row_index").alias("n_rows"), F.max("column_index").alias("n_columns"), F.count("*").alias("n_cells"))


def sections(nodes: DataFrame) -> DataFrame:
    """doc_id, section_id, page_orientation, page_number_format and sizes; a document without sections has one default row."""
    body = nodes.where(F.col("part_name") == PARTS[0])
    sect = body.where("node_type = 'sectPr'").select("doc_id", "path", "pos")
    child = body.where(F.col("node_type").isin("pgSz", "pgMar", "pgNumType")).select("doc_id", F.col("parent_path").alias("path"), "node_type", "attributes")
    of = lambda kind, key: F.max(F.when(F.col("node_type") == kind, F.col("attributes")[key]))
    wide = child.groupBy("doc_id", "path").agg(of("pgSz", "orient").alias("orient"), of("pgSz", "w").alias("w"), of("pgSz", "h").alias("h"), of("pgMar", "top").alias("top"), of("pgMar", "left").alias("left"), of("pgNumType", "fmt").alias("fmt"))
    rows = sect.join(wide, ["doc_id", "path"], "left").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    out = nodes.select("doc_id").distinct().join(rows, "doc_id", "left")
    return out.select(
        "doc_id", scalars.section_id(F.coalesce("n", F.lit(1))).alias("section_id"), scalars.orientation(F.col("orient")).alias("page_orientation"), F.col("fmt").alias("page_number_format"),
        scalars.safe_int(F.col("w")).alias("page_width_twips"), scalars.safe_int(F.col("h")).alias("page_height_twips"), scalars.twips_to_cm(F.col("top")).alias("margin_top_cm"), scalars.twips_to_cm(F.col("left")).alias("margin_left_cm"),
    )


def _slots(props: DataFrame) -> DataFrame:
    """Format children (type and attributes) as long slot rows; line spacing is derived here, in its own layer."""
    a, kind = F.col("attributes"), F.col("node_type")
    spacing = scalars.line_spacing(a["line"], a["lineRule"])
    pairs = [
        (kind == "rFonts", "font_east_asia", a["eastAsia"]),
        (kind == "rFonts", "font_ascii", a["ascii"]),
        (kind == "sz", "font_size_pt", scalars.half_points_to_pt(a["val"]).cast("string")),
        (kind == "b", "bold", scalars.three_valued(F.lit(True), a["val"]).cast("string")),
        (kind == "i", "italic", scalars.three_valued(F.lit(True), a["val"]).cast("string")),
        (kind == "jc", "alignment", scalars.alignment(a["val"])),
        (kind == "outlineLvl", "outline_level", (scalars.safe_int(a["val"]) + 1).cast("string")),
        (kind == "ind", "first_line_indent_cm", scalars.twips_to_cm(a["firstLine"]).cast("string")),
        (kind == "ind", "left_indent_cm", scalars.twips_to_cm(a["left"]).cast("string")),
        (kind == "spacing", "space_before_pt", scalars.twentieths_to_pt(a["before"]).cast("string")),
        (kind == "spacing", "space_after_pt", scalars.twentieths_to_pt(a["after"]).cast("string")),
        (kind == "spacing", "line_spacing_multiple", spacing["multiple"].cast("string")),
        (kind == "spacing", "line_spacing_pt", spacing["points"].cast("string")),
    ]
    items = F.array_compact(F.array(*[F.when(c & v.isNotNull(), F.struct(F.lit(s).alias("slot"), v.alias("value_str"))) for c, s, v in pairs]))
    return props.withColumn("x", F.explode(items)).select(*[c for c in props.columns if c not in ("attributes", "node_type")], "x.slot", "x.value_str")


def _style_slots(nodes: DataFrame, kinds: str = "pr") -> DataFrame:
    """doc_id, ancestor (a style's id), slot, value_str of each style's own formats: of paragraphs (p), runs (r) or both."""
    in_styles = nodes.where(F.col("part_name") == PARTS[1])
    named = in_styles.where("node_type = 'style'").select("doc_id", F.col("path").alias("style_path"), F.col("attributes")["styleId"].alias("ancestor"))
    formats = in_styles.where(F.col("parent_path").rlike(rf"/style(\[[0-9]+\])?/[{kinds}]Pr\[1\]$")).select("doc_id", F.regexp_replace("parent_path", r"/[pr]Pr\[1\]$", "").alias("style_path"), "node_type", "attributes")
    return _slots(formats.join(named, ["doc_id", "style_path"]).select("doc_id", "ancestor", "node_type", "attributes"))


def _default_slots(nodes: DataFrame, kinds: str = "pr") -> DataFrame:
    """doc_id, slot, value_str of the document's defaults."""
    default = nodes.where((F.col("part_name") == PARTS[1]) & F.col("parent_path").rlike(rf"/docDefaults(\[1\])?/[{kinds}]PrDefault\[1\]/[{kinds}]Pr\[1\]$"))
    return _slots(default.select("doc_id", "node_type", "attributes"))


def paragraph_formats(nodes: DataFrame) -> DataFrame:
    """doc_id, element_id, slot, value_str, source, confidence: defaults, then the style chain (base first), then direct formats."""
    own = paragraphs(nodes).select("doc_id", "path", "element_id", "style_id")
    direct = nodes.where((F.col("part_name") == PARTS[0]) & F.col("parent_path").rlike(r"/p\[[0-9]+\]/pPr\[1\]$"))
    direct = direct.select("doc_id", F.regexp_replace("parent_path", r"/pPr\[1\]$", "").alias("path"), "node_type", "attributes").join(own, ["doc_id", "path"])
    layers = _slots(direct.select("doc_id", "element_id", "node_type", "attributes")).select("*", F.lit("direct").alias("source"), F.lit(1 << 20).alias("precedence"))
    chains = facts.style_chains(styles(nodes))
    styled = own.where("style_id IS NOT NULL").join(chains, ["doc_id", "style_id"]).join(_style_slots(nodes), ["doc_id", "ancestor"])
    layers = layers.unionByName(styled.select("doc_id", "element_id", "slot", "value_str", F.lit("style_inherit").alias("source"), (F.lit(1 << 19) - F.col("level")).alias("precedence")))
    everywhere = own.select("doc_id", "element_id").join(_default_slots(nodes), "doc_id").select("doc_id", "element_id", "slot", "value_str", F.lit("doc_defaults").alias("source"), F.lit(0).alias("precedence"))
    return facts.layered(layers.unionByName(everywhere), "doc_id", "element_id")


def runs(nodes: DataFrame) -> DataFrame:
    """doc_id, element_id (of the paragraph), run_index (from 1), run_style_id, text_preview, style_id (of the paragraph), path: runs right below paragraphs."""
    body = nodes.where(F.col("part_name") == PARTS[0])
    run = body.where((F.col("node_type") == "r") & F.col("path").rlike(r"/p\[[0-9]+\]/r\[[0-9]+\]$"))
    run = run.select("doc_id", "path", F.regexp_replace("path", r"/r\[[0-9]+\]$", "").alias("paragraph"), F.regexp_extract("path", r"/r\[([0-9]+)\]$", 1).cast("int").alias("run_index"))
    text = body.where("node_type = 't'").groupBy("doc_id", F.col("parent_path").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))
    style = body.where("node_type = 'rStyle'").select("doc_id", F.regexp_replace("parent_path", r"/rPr\[1\]$", "").alias("path"), F.col("attributes")["val"].alias("run_style_id"))
    own = paragraphs(nodes).select("doc_id", F.col("path").alias("paragraph"), "element_id", "style_id")
    rows = run.join(text, ["doc_id", "path"], "left").join(style, ["doc_id", "path"], "left").join(own, ["doc_id", "paragraph"])
    return rows.select("doc_id", "element_id", "run_index", "run_style_id", scalars.preview(F.coalesce("text", F.lit("")), 80).alias("text_preview"), "style_id", "path")


def run_formats(nodes: DataFrame) -> DataFrame:
    """doc_id, element_id, run_index, slot, value_str, source, confidence: defaults, the paragraph's style, the run's style, direct formats."""
    own = runs(nodes)
    keys = ["doc_id", "element_id", "run_index"]
    direct = nodes.where((F.col("part_name") == PARTS[0]) & F.col("parent_path").rlike(r"/r\[[0-9]+\]/rPr\[1\]$"))
    direct = direct.select("doc_id", F.regexp_replace("parent_path", r"/rPr\[1\]$", "").alias("path"), "node_type", "attributes").join(own.select(*keys, "path"), ["doc_id", "path"])
    layers = _slots(direct.select(*keys, "node_type", "attributes")).select("*", F.lit("direct").alias("source"), F.lit(1 << 20).alias("precedence"))
    chains, by_style = facts.style_chains(styles(nodes)), _style_slots(nodes, "r")
    for column, strongest in (("run_style_id", 1 << 19), ("style_id", 1 << 18)):
        styled = own.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("own_style"))
        styled = styled.join(chains.withColumnRenamed("style_id", "own_style"), ["doc_id", "own_style"]).join(by_style, ["doc_id", "ancestor"])
        layers = layers.unionByName(styled.select(*keys, "slot", "value_str", F.lit("style_inherit").alias("source"), (F.lit(strongest) - F.col("level")).alias("precedence")))
    everywhere = own.select(*keys).join(_default_slots(nodes, "r"), "doc_id").select(*keys, "slot", "value_str", F.lit("doc_defaults").alias("source"), F.lit(0).alias("precedence"))
    return facts.layered(layers.unionByName(everywhere), *keys)


def cell_formats(nodes: DataFrame) -> DataFrame:
    """doc_id, cell (path), has_bold, fonts and sizes (sorted, distinct) of the runs directly formatted in each cell."""
    inner = F.regexp_extract("path", r"^(.*/tc\[[0-9]+\])/", 1)
    props = nodes.where((F.col("part_name") == PARTS[0]) & F.col("parent_path").endswith("/rPr[1]") & (inner != "")).select("doc_id", inner.alias("cell"), "node_type", "attributes")
    slots = _slots(props)
    return slots.groupBy("doc_id", "cell").agg(
        F.bool_or((F.col("slot") == "bold") & (F.col("value_str") == "true")).alias("has_bold"),
        F.array_sort(F.collect_set(F.when(F.col("slot").isin("font_east_asia", "font_ascii"), F.col("value_str")))).alias("fonts"),
        F.array_sort(F.collect_set(F.when(F.col("slot") == "font_size_pt", F.col("value_str").cast("double")))).alias("sizes"),
    )
