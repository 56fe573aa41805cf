"""HTML pages to chunks, facts, key relationships and a node tree; corpus statistics.

One Arrow-batched function turns a page into nested arrays; exploding, numbering, identifiers, trees and statistics are
DataFrame operations keyed by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import html as H
from ..functions.text import identifier_slug, token_estimate
from .retrieval import sliced

TARGET, HARD_LIMIT, NEAR_EMPTY = 3200, 4800, 200
PAGE_BYTES = 1 << 20
UNAVAILABLE = "present_but_unavailable"
def _rows(*names: str) -> ArrayType:
    return ArrayType(StructType([StructField(n, IntegerType() if n == "ordinal" else StringType()) for n in names]))


#: What a page becomes.
PARSED = StructType([
    StructField("title", StringType()),
    StructField("chunks", _rows("category", "heading_path", "text", "logical_id")),
    StructField("facts", _rows("heading_path", "fact")),
    StructField("keys", _rows("source_table", "source_column", "target_table", "target_column", "ordinal", "heading_path")),
])


def split_text(text: str, limit: int = TARGET) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at the last space that fits, without edge spaces and bars."""
    rest, pieces = text.strip(), []
    while len(rest) > limit:
        cut = rest.rfind(" ", 0, limit + 1)
        cut = cut if cut >= 1 else limit
        if piece := rest[:cut].strip():
            pieces.append(piece)
        rest = rest[cut:].lstrip(" |").strip()
    return pieces + [rest] * bool(rest)


@pandas_udf(ArrayType(StringType()))
def text_pieces(text: pd.Series) -> pd.Series:
    return text.map(lambda t: split_text(t) if t else [])


def _line(cells: list[H.Element]) -> str:
    """A row's cells; labels end with a colon."""
    texts = [(H.cell_text(c), "T1Head" in c.classes) for c in cells]
    return " ".join(f"{t}:" if label else t for t, label in texts if t)


def _category(table: H.Element) -> str:
    names = {"SubList": "column_info", "List": "table_data", "KeyValue": "metadata"}
    return next((names[c] for c in names if c in table.classes), "table_generic")


def _table_chunks(table: H.Element, category: str, heading: str) -> Iterator[dict]:
    """Rows in batches up to the target size, each with the header rows in front."""
    rows = [(_line(cells), any(c.name == "th" for c in cells)) for r in H.owned_rows(table) if (cells := H.owned_cells(r))]
    header = " | ".join(t for t, head in rows if t and head)
    body = [t for t, head in rows if t and not head]
    batches: list[list[str]] = [[]]
    size = len(header)
    for row in body:
        if batches[-1] and size + len(row) + 3 > TARGET:
            batches.append([])
            size = len(header)
        batches[-1].append(row)
        size += len(row) + 3
    for batch in batches:
        joined = " | ".join([header] * bool(header) + batch)
        if joined:
            yield {"category": category, "heading_path": heading, "text": joined, "logical_id": None}


def _column_chunks(table: H.Element, document: str, heading: str) -> Iterator[dict]:
    """A row that starts with a label defines a column; unlabelled rows after it describe that column."""
    current: list[str] = []
    name = ""

    def record() -> Iterator[dict]:
        if current:
            logical = "__".join((_slug(document.partition(" - ")[0]), "COLUMN", _slug(name)))
            yield {"category": "column_info", "heading_path": f"{heading} > {name}", "text": " | ".join(current), "logical_id": logical}

    for row in H.owned_rows(table):
        cells = H.owned_cells(row)
        line = _line(cells)
        if not line:
            continue
        labelled = [c for c in cells if "T1Head" in c.classes]
        if labelled and len(cells) > 1:
            yield from record()
            current, name = [line], H.cell_text(cells[cells.index(labelled[0]) + 1]) if cells.index(labelled[0]) + 1 < len(cells) else H.cell_text(labelled[0])
        else:
            current.append(line)
    yield from record()


def _slug(text: str) -> str:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text).split()
    return "_".join(words).upper() or "UNNAMED"


def _keys(table: H.Element, source: str, heading: str) -> Iterator[dict]:
    """Numbered rows of a foreign-key table; a destination with a link holds for the rows its rowspan covers."""
    target, left = None, 0
    for row in H.owned_rows(table):
        cells = H.owned_cells(row)
        values = [H.cell_text(c) for c in cells]
        if any(c.name == "th" for c in cells) or len(values) < 3 or not values[0].isdigit():
            continue
        if cells[2].find("a"):
            target, span = values[2].upper(), cells[2].attributes.get("rowspan", "")
            left, column = (max(int(span) - 1, 0) if span.isdigit() else 0), values[3].upper() if len(values) > 3 else ""
        elif target and left:
            left, column = left - 1, values[2].upper()
        else:
            continue
        if values[1] and target and column:
            yield {"source_table": source.upper(), "source_column": values[1].upper(), "target_table": target, "target_column": column, "ordinal": int(values[0]), "heading_path": heading}


def parse_page(html: str, fallback: str) -> dict:
    """Title, chunks, facts and keys of one page. Pages without the documented structure are one chunk of their text."""
    root = H.parse(html or "")
    titles = root.find("title")
    title = titles[0].text() if titles else fallback
    chunks: list[dict] = []
    facts: list[dict] = []
    keys: list[dict] = []
    structured = False
    order = {id(e): k for k, e in enumerate(root.walk())}
    headers = root.find("div", "header")
    for content in (d for d in root.find("div") if d.attributes.get("id") == "oContent"):
        before = [h for h in headers if order[id(h)] < order[id(content)]]
        document = before[-1].text() if before else title
        if metadata := content.find("table", "KeyValue"):
            text = " | ".join(t for r in H.owned_rows(metadata[0]) if (t := _line(H.owned_cells(r))))
            chunks += [{"category": "metadata", "heading_path": document, "text": text, "logical_id": None}] * bool(text)
        for sub in content.find("table", "SubHeader3"):
            structured = True
            named = next((c for c in sub.find("td") if "id" in c.attributes), None)
            section = (named.attributes["id"] if named else "unnamed").strip("_")
            heading, value = f"{document} > {section}", sub.following()
            absent = value is None or (isinstance(value, str) and value.strip() == "None") or (isinstance(value, H.Element) and value.name == "span" and "NA" in value.classes)
            if absent:
                facts.append({"heading_path": heading, "fact": UNAVAILABLE})
            elif isinstance(value, H.Element) and value.name == "table":
                category = _category(value)
                plain = section.replace("-", " ").casefold()
                chunks += _column_chunks(value, document, heading) if category == "column_info" and plain == "column information" else _table_chunks(value, category, heading)
                if plain == "foreign key information":
                    keys += _keys(value, document.partition(" - ")[0], heading)
    if not chunks and not structured and (text := root.text()):
        chunks.append({"category": "document", "heading_path": title, "text": text, "logical_id": None})
    bounded = []
    for chunk in chunks:
        pieces = split_text(chunk["text"])
        for k, piece in enumerate(pieces, 1):
            logical = f"{chunk['logical_id']}__PART_{k}" if chunk["logical_id"] and len(pieces) > 1 else chunk["logical_id"]
            bounded.append(chunk | {"text": piece, "logical_id": logical})
    return {"title": title, "chunks": bounded, "facts": facts, "keys": keys}


def parse_documents(pages: DataFrame) -> DataFrame:
    """doc_id, source_path, source_hash, title, chunks, facts, keys from pages (source_path, source_hash, html).

    A worker takes PAGE_BYTES of HTML at once and sends their rows before it parses more, however many pages Spark puts in a batch.
    """
    names = [f.name for f in PARSED]
    result = StructType([StructField("source_path", StringType()), pages.schema["source_hash"], *PARSED.fields])
    types = [to_arrow_type(f.dataType) for f in PARSED]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, PAGE_BYTES, 2):
                rows = [parse_page(h, f) for h, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                parsed = [pa.array([r[n] for r in rows], kind) for n, kind in zip(names, types, strict=True)]
                yield pa.record_batch([batch.column(0), batch.column(1), *parsed], names=result.names)

    stem = F.regexp_extract("source_path", r"([^/]+?)(\.html)?$", 1)
    parsed = pages.select("source_path", "source_hash", "html", stem.alias("stem")).mapInArrow(parse, result)
    return parsed.select(F.sha2("source_path", 256).alias("doc_id"), *result.names)


def chunk_table(parsed: DataFrame) -> DataFrame:
    """One row per chunk: content-addressed ids, hashes, token estimates. Equal headings are numbered in page order."""
    rows = parsed.select("doc_id", "source_path", "title", F.posexplode("chunks").alias("chunk_index", "c")).select("doc_id", "source_path", "title", "chunk_index", "c.*")
    order = Window.partitionBy("doc_id", "heading_path", "category").orderBy("chunk_index")
    hashed = rows.withColumns({"text_hash": F.sha2("text", 256), "occurrence": F.row_number().over(order) - 1})
    content = F.sha2(F.concat_ws(":", "doc_id", "heading_path", "category", "occurrence", "text_hash"), 256)
    return hashed.withColumns({"chunk_id": F.coalesce("logical_id", content), "token_count": token_estimate(F.col("text"))}).drop("logical_id", "occurrence")


def fact_table(parsed: DataFrame) -> DataFrame:
    """First fact of each heading of a document."""
    rows = parsed.select("doc_id", F.posexplode("facts").alias("place", "f"))
    return rows.groupBy("doc_id", "f.heading_path").agg(F.min_by("f.fact", "place").alias("fact"))


def key_table(parsed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Foreign keys with the first chunk of their section as evidence."""
    rows = parsed.select(F.col("doc_id").alias("source_doc_id"), F.explode("keys").alias("k")).select("source_doc_id", "k.*")
    evidence = chunks.groupBy(F.col("doc_id").alias("source_doc_id"), "heading_path").agg(F.min_by("chunk_id", "chunk_index").alias("evidence_chunk_id"))
    ids = F.sha2(F.concat_ws(":", "source_doc_id", "source_column", "target_table", "target_column", "ordinal"), 256)
    return rows.join(evidence, ["source_doc_id", "heading_path"], "left").withColumns({"relationship_id": ids, "relationship_type": F.lit("foreign_key")})


def node_table(chunks: DataFrame) -> DataFrame:
    """Documents, sections (prefixes of heading paths) and chunks as a tree. Children are placed by first appearance."""
    parts = F.transform(F.split("heading_path", ">"), lambda p: F.trim(p))
    placed = chunks.select("doc_id", "source_path", "chunk_id", "chunk_index", parts.alias("path"))
    prefixes = placed.select("doc_id", "chunk_index", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"))
    sections = prefixes.groupBy("doc_id", F.slice("path", F.lit(1), F.col("depth")).alias("path"), "depth").agg(F.min("chunk_index").alias("first"))

    def section_id(path: Column) -> Column:
        return F.sha2(F.concat_ws(":", F.lit("section"), "doc_id", F.to_json(path)), 256)

    root = F.sha2(F.concat_ws(":", F.lit("document"), "doc_id"), 256)
    parent = F.when(F.col("depth") > 1, section_id(F.slice("path", F.lit(1), F.col("depth") - 1))).otherwise(root)
    named = sections.select(section_id(F.col("path")).alias("node_id"), parent.alias("parent_id"), F.col("doc_id").alias("document_id"), "depth", F.element_at("path", -1).alias("name"), "first", F.lit("section").alias("kind"), F.lit(0).alias("leaf"))
    leaves = placed.select(F.sha2(F.concat_ws(":", F.lit("chunk"), "chunk_id"), 256).alias("node_id"), section_id(F.col("path")).alias("parent_id"), F.col("doc_id").alias("document_id"), (F.size("path") + 1).alias("depth"), F.col("chunk_id").alias("name"), F.col("chunk_index").alias("first"), F.lit("chunk").alias("kind"), F.lit(1).alias("leaf"))
    tops = placed.groupBy("doc_id").agg(F.first("source_path").alias("name")).select(root.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("depth"), "name", F.lit(0).alias("first"), F.lit("document").alias("kind"), F.lit(0).alias("leaf"))
    every = tops.unionByName(named).unionByName(leaves)
    place = F.row_number().over(Window.partitionBy("document_id", "parent_id").orderBy("first", "leaf", "node_id")) - 1
    return every.withColumn("position", F.when(F.col("kind") == "document", 0).otherwise(place)).drop("first", "leaf")


def build_index(pages: DataFrame, version: str) -> dict[str, DataFrame]:
    """All relations of the index. Chunks are needed by several of them, so callers may store them first."""
    parsed = parse_documents(pages)
    chunks = chunk_table(parsed)
    relations = {"docs": parsed.select("doc_id", "source_path", "title", "source_hash"), "chunks": chunks, "section_facts": fact_table(parsed), "table_relationships": key_table(parsed, chunks), "nodes": node_table(chunks)}
    metadata = pages.sparkSession.createDataFrame([("version", version)], "key string, value string")
    counts = [frame.agg(F.lit(f"{name}_count").alias("key"), F.count(F.lit(1)).cast("string").alias("value")) for name, frame in relations.items()]
    for count in counts:
        metadata = metadata.unionByName(count)
    return relations | {"index_metadata": metadata}


def with_expansions(chunks: DataFrame, expansions: DataFrame) -> DataFrame:
    """Chunks with generated_queries; an expansion without a chunk is an error."""
    if expansions.join(chunks, "chunk_id", "left_anti").limit(1).count():
        raise ValueError("expansion corpus names unknown chunks")
    return chunks.drop("generated_queries").join(expansions.withColumnRenamed("queries", "generated_queries"), "chunk_id", "left")


def corpus_audit(chunks: DataFrame) -> DataFrame:
    """One row: counts, nearest-rank percentiles of length, empty and over-long chunks, repeated texts."""
    length = F.length("text")
    ranks = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY length(text))").cast("int").alias(f"p{p}") for p in (50, 90, 95, 99)]
    n = F.count(F.lit(1))
    return chunks.agg(n.alias("chunks"), *ranks, F.max(length).alias("longest"), F.count_if(length == 0).alias("empty"), F.count_if(length < NEAR_EMPTY).alias("near_empty"), F.count_if(length > HARD_LIMIT).alias("over_limit"), (n - F.count_distinct(F.sha2("text", 256))).alias("repeated"))


def by_category(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("category").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


def repeated_texts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def description(text: Column) -> tuple[Column, Column]:
    """What follows "Description::", and whether it is present, empty or missing."""
    found = F.regexp_extract(text, r"(?s)Description::(.*)$", 1)
    status = F.when(~text.contains("Description::"), "missing").when(F.trim(found) == "", "empty").otherwise("present")
    return F.when(status == "present", F.trim(F.regexp_replace(found, r"(?U)\s+", " "))), status


def metadata_records(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: description, status and embedding text of its one metadata chunk; other numbers of chunks are faults."""
    own = chunks.where("category = 'metadata'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "chunk_index").alias("text"), F.min_by("heading_path", "chunk_index").alias("heading_path"))
    words, status = description(F.col("text"))
    joined = docs.join(own, "doc_id", "left").withColumn("fault", F.when(F.col("n").isNull(), "no_metadata").when(F.col("n") > 1, "many_metadata"))
    described = joined.withColumns({"description": words, "status": F.when(F.col("fault").isNull(), status)})
    table = identifier_slug(F.regexp_extract("source_path", r"([^/]+?)(\.html)?$", 1))
    return described.select("doc_id", "source_path", "fault", "status", "description", table.alias("table_name"), F.when(F.col("status") == "present", F.concat(table, F.lit(": "), F.col("description"))).alias("embedding_text"))


def repeated_ids(chunks: DataFrame) -> DataFrame:
    """Chunk ids that more than one chunk has: an index with any is refused."""
    return chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def record_faults(chunks: DataFrame) -> DataFrame:
    """Chunks that break the record rules: untrimmed or empty text, blank heading, malformed hash, too long."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    rule = F.when(blank, "empty_text").when(F.col("text") != F.trim("text"), "untrimmed_text").when(F.coalesce(F.trim("heading_path"), F.lit("")) == "", "blank_heading")
    rule = rule.when(~F.col("text_hash").rlike("^[0-9a-f]{64}$"), "malformed_hash").when(F.length("text") > HARD_LIMIT, "over_limit")
    return chunks.withColumn("fault", rule).where("fault is not null").select("chunk_id", "fault")


def extraction_report(records: DataFrame) -> DataFrame:
    """Per status or fault: documents, and up to twenty of their paths in order."""
    outcome = F.coalesce("fault", "status").alias("outcome")
    order = Window.partitionBy("outcome").orderBy("source_path")
    sample = records.select(outcome, "source_path").withColumn("n", F.row_number().over(order)).where("n <= 20")
    paths = sample.groupBy("outcome").agg(F.array_sort(F.collect_list("source_path")).alias("paths"))
    return records.groupBy(outcome).agg(F.count(F.lit(1)).alias("documents")).join(paths, "outcome")


def index_version(chunks: DataFrame, expansions: DataFrame | None = None) -> str:
    """A hash of all chunk ids and texts, and of the expansions, that does not depend on their order."""
    rows = chunks.select(F.xxhash64("chunk_id", "text_hash").alias("h"))
    if expansions is not None:
        rows = rows.unionByName(expansions.select(F.xxhash64("chunk_id", "queries").alias("h")))
    mark = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum((F.col("h") % 1000003).cast("long")).alias("s")).first()
    return hashlib.sha256(f"{mark['n']}:{mark['x']}:{mark['s']}".encode()).hexdigest()


def citation_label(title: Column, heading: Column, path: Column) -> Column:
    """Title and heading, or the file's name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", name).otherwise(F.concat_ws(" — ", title, F.when(F.trim(heading) != "", heading)))
