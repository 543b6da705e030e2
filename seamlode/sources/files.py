"""File sources: JSON batches and facts, glossaries, Markdown, DOCX, front matter, matrices, listings.

Files are read by Spark's readers, so any store that it knows will do. What is malformed is
kept apart with the reason instead of stopping a load.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seamlode.functions import pages
from seamlode.functions import text as T

# Extensions that can be parsed, with their media types, and those of archives.
MEDIA_TYPES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "html": "text/html", "htm": "text/html", "md": "text/markdown", "csv": "text/csv", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet", "odp": "application/vnd.oasis.opendocument.presentation",
    "asciidoc": "text/asciidoc", "adoc": "text/asciidoc", "epub": "application/epub+zip", "latex": "application/x-latex", "tex": "application/x-tex", "vtt": "text/vtt",
}
ARCHIVES = ["001", "002", "003", "004", "005", "7z", "arj", "bz2", "cab", "cpio", "deb", "dmg", "gz", "iso", "lha", "lzh", "rar", "rpm", "tar", "tbz2", "tgz", "txz", "xz", "z", "zip"]
LABELS = ["MATERIAL", "PROCESS", "EQUIPMENT", "PROPERTY", "EXPERT", "FACILITY", "PUBLICATION", "EXPERIMENT", "UNKNOWN"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def media_type(path: Column) -> Column:
    from seamlode.functions.numeric import lookup

    return lookup(MEDIA_TYPES, extension(path))


def is_input(path: Column) -> Column:
    return extension(path).isin(*MEDIA_TYPES) & ~extension(path).isin(*ARCHIVES)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def whole_texts(spark: SparkSession, folder: str, suffixes: list[str], recursive: bool = True) -> DataFrame:
    """(path, text) of text files; bytes that are no UTF-8 are replaced."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", F.regexp_replace(F.decode(F.try_validate_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8"), "^﻿", "").alias("text"), "content").select("path", F.coalesce("text", _replaced(F.col("content"))).alias("text"))


def _replaced(content: Column) -> Column:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda x: None if x is None else bytes(x).decode("utf-8-sig", "replace"))

    return run(content)


def _broken(rows: DataFrame) -> DataFrame:
    """Malformed files; Spark wants a query of them to read some other column as well."""
    read = F.to_json(F.struct(*(c for c in rows.columns if c not in ("_broken", "path"))))
    return rows.where(F.col("_broken").isNotNull() & (F.length(read) >= 0)).select("path", F.lit("malformed JSON").alias("reason"))


def json_batches(spark: SparkSession, folder: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """(batches, rejects) of a folder of JSON files, one object each; files whose name begins with _ are left out."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*kind.fields, *StructType.fromDDL("_broken string").fields])
    rows = spark.read.schema(whole).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "[!_]*.json").json(folder)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    return rows.where("_broken is null").drop("_broken"), _broken(rows)


FACTS = "doc_id string, entities array<struct<text:string,label:string,start_char:int,end_char:int>>, relations array<struct<source:string,source_type:string,relation:string,target:string,target_type:string,verb:string>>"


def json_facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(facts, rejects) of all JSON files below a folder; a file without a doc_id is named by its stem."""
    kind = StructType([*StructType.fromDDL(FACTS).fields, *StructType.fromDDL("_broken string").fields])
    rows = spark.read.schema(kind).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder).withColumn("path", F.col("_metadata.file_path"))
    return rows.where("_broken is null").drop("_broken").withColumn("doc_id", F.coalesce("doc_id", _stem(F.col("path")))), _broken(rows)


def _seed(rows: DataFrame) -> DataFrame:
    """(term, label, lang, path): terms trimmed, unknown labels UNKNOWN, a language by their letters."""
    label = F.upper(F.trim(F.coalesce("label", F.lit(""))))
    rows = rows.select(F.trim(F.coalesce("term", F.lit(""))).alias("term"), F.when(label.isin(LABELS), label).otherwise("UNKNOWN").alias("label"), F.nullif("lang", F.lit("")).alias("lang"), "path")
    return rows.where("term <> ''").withColumn("lang", F.coalesce("lang", T.language(F.col("term"), 0.3, None)))


def csv_terms(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Terms of a table with the columns term, label and lang, in any case and order."""
    rows = spark.read.option("header", True).option("sep", separator).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip().lower() for c in rows.columns))
    column = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)
    return _seed(rows.select(column("term"), column("label"), column("lang"), F.col("_metadata.file_path").alias("path") if "_metadata" in rows.columns else F.input_file_name().alias("path")))


def jsonl_terms(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("term string, label string, lang string").json(path)
    return _seed(rows.select("*", F.input_file_name().alias("path")))


def json_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a JSON file: {label: [terms]} or [{term, label, lang}]."""
    texts = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"), F.input_file_name().alias("path"))
    by_label = texts.where(F.trim("v").startswith("{")).select("path", F.explode(F.from_json("v", "map<string,array<string>>")).alias("label", "terms"))
    a = by_label.select(F.explode("terms").alias("term"), "label", F.lit(None).cast("string").alias("lang"), "path")
    b = texts.where(F.trim("v").startswith("[")).select("path", F.explode(F.from_json("v", "array<struct<term:string,label:string,lang:string>>")).alias("t")).select("t.term", "t.label", "t.lang", "path")
    return _seed(a.unionByName(b))


def seed_terms(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Terms of several glossaries by their extensions, one of each term and language, case aside: a known label before UNKNOWN, then the first file by name."""
    readers = {"csv": csv_terms, "tsv": lambda s, p: csv_terms(s, p, "\t"), "tab": lambda s, p: csv_terms(s, p, "\t"), "json": json_terms, "jsonl": jsonl_terms}
    rows = None
    for p in sorted(paths):
        if (kind := p.rsplit(".", 1)[-1].lower()) in readers:
            part = readers[kind](spark, p)
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return spark.createDataFrame([], "term string, label string, lang string")
    order = F.struct((F.col("label") == "UNKNOWN").alias("u"), "path", "term", "label")
    return rows.groupBy(F.lower("term").alias("key"), "lang").agg(F.min(order).alias("o")).select("o.term", "o.label", "lang")


def synonym_groups(spark: SparkSession, path: str, most: int = 12, least: int = 3) -> DataFrame:
    """(forms) of a YAML file of ``key: [form, ...]`` or ``key:`` and ``- form`` lines; groups that mix scripts, of 2 to ``most`` forms."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(_groups(F.col("value"))).alias("forms"))
    low = F.array_distinct(F.filter(F.transform("forms", lambda f: F.lower(F.trim(F.regexp_replace(f, r"\s+", " ")))), lambda f: F.length(f) >= least))
    whole = F.array_join("forms", " ")
    return lines.select(F.array_sort(low).alias("forms")).where(F.size("forms").between(2, most) & whole.rlike("[а-яё]") & whole.rlike("[a-z]"))


def _groups(value: Column) -> Column:
    @F.pandas_udf("array<array<string>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda x: [[k.replace("_", " "), *map(str, v)] for k, v in mapping(x).items() if isinstance(v, list) and v])

    return run(value)


def mapping(block: str) -> dict:
    """A YAML mapping of scalars, lists and mappings, by indentation; what front matter and glossaries use of YAML."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in block.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def scalar(s: str):
        s = s.strip()
        if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", s[1:-1]) if x.strip()]
        s = re.sub(r"\s+#.*$", "", s)
        if s in ("", "~", "null"):
            return None
        if s in ("true", "false"):
            return s == "true"
        return int(s) if re.fullmatch(r"[-+]?\d+", s) else float(s) if re.fullmatch(r"[-+]?\d+\.\d+", s) else s

    def read(at: int, depth: int):
        out: dict | list | None = None
        while at < len(lines) and lines[at][0] >= depth:
            indent, line = lines[at]
            if line.startswith("- ") or line == "-":
                out = [] if out is None else out
                if not isinstance(out, list):
                    raise ValueError(f"a list among keys: {line}")
                out.append(scalar(line[1:]))
                at += 1
                continue
            key, colon, rest = line.partition(":")
            if not colon or isinstance(out, list):
                raise ValueError(f"no key: {line}")
            out = {} if out is None else out
            at += 1
            if rest.strip():
                out[scalar(key)] = scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("-"))):
                out[scalar(key)], at = read(at, lines[at][0])
            else:
                out[scalar(key)] = None
        return out, at

    found, at = read(0, lines[0][0]) if lines else ({}, 0)
    if not isinstance(found, dict) or at < len(lines):
        raise ValueError("not a mapping")
    return found


# -- front matter ------------------------------------------------------------------------


def split_front_matter(text: str) -> tuple[dict, str, str | None]:
    """(fields, body, error) of a document with a YAML header between --- lines; the field ``type`` is required."""
    if not text.startswith("---"):
        return {}, text, "NO_FRONTMATTER"
    end = text.find("\n---", 3)
    if end < 0:
        return {}, text, "UNCLOSED_FRONTMATTER"
    body = text[end + 4 :].removeprefix("\n")
    try:
        fields = mapping(text[4:end])
    except ValueError:
        return {}, body, "INVALID_YAML"
    return fields, body, None if fields.get("type") else "MISSING_TYPE"


def okf(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): path, type, title, fields as JSON and body of Markdown files with front matter; rejects with an error code."""

    @F.pandas_udf("struct<type:string,title:string,fields:string,body:string,error:string>")
    def parsed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import json

        for p in parts:
            rows = []
            for x in p:
                fields, body, error = split_front_matter(x or "")
                rows.append((str(fields.get("type") or "") or None, fields.get("title"), json.dumps(fields, ensure_ascii=False, sort_keys=True, default=str), body, error))
            yield pd.DataFrame(rows, columns=["type", "title", "fields", "body", "error"])

    rows = whole_texts(spark, folder, ["md"]).select("path", parsed("text").alias("d")).select("path", "d.*")
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("path", "error")


def okf_text(fields: dict[str, Column], body: Column) -> Column:
    """A document with a front matter of the fields, nulls left out."""
    lines = F.filter(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), F.to_json(F.struct(v.cast("string").alias("v")))).alias(k)) for k, v in fields.items())), lambda x: x.isNotNull())
    quoted = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r'\{"v":', ""), r"\}$", ""))
    return F.concat(F.lit("---\n"), F.array_join(quoted, "\n"), F.lit("\n---\n"), body)


# -- documents ---------------------------------------------------------------------------


def markdown_corpus(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """(doc_id, text) of Markdown and text files below a folder as plain text, empty ones left out; with ``most`` only the first files by path."""
    rows = whole_texts(spark, folder, ["md", "markdown", "txt"])
    rows = rows if most is None else rows.orderBy("path").limit(most)
    return rows.select(F.col("path").alias("doc_id"), T.without_markdown(F.col("text")).alias("text")).where("text <> ''")


def markdown_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(path, locator, text) of the paragraphs of Markdown files."""
    rows = whole_texts(spark, folder, ["md", "markdown"])
    return rows.select("path", F.explode(pages.paragraphs(F.col("text"))).alias("b")).select("path", "b.locator", "b.text")


def docx_paragraphs(data: bytes) -> list[tuple[str, str]]:
    """(locator, text) of a DOCX file's paragraphs of three signs and more."""
    import html

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "ignore")
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", p))).strip() for p in xml.split("</w:p>"))
    return [(f"para:{i}", t) for i, t in enumerate(texts) if len(t) >= 3]


def pdf_pages(data: bytes) -> list[tuple[str, str]]:
    """(locator, text) of a PDF file's pages of ten signs and more; needs the optional pypdf."""
    from pypdf import PdfReader

    texts = (re.sub(r"\s+", " ", p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages)
    return [(f"p{i}", t) for i, t in enumerate(texts, 1) if len(t) >= 10]


def table_sentences(table: list[list[str | None]]) -> list[str]:
    """Rows of a table as sentences of its headers and their cells."""
    if len(table) < 2:
        return []
    head = [(h or "").strip() for h in table[0]]
    rows = ([f"{h} {(c or '').strip()}".strip() for h, c in zip(head, row) if (c or "").strip()] for row in table[1:])
    return [", ".join(r) + "." for r in rows if r]


def office_blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(blocks(path, locator, text), rejects(path, reason)) of the DOCX and PDF files below a folder."""

    @F.pandas_udf("struct<blocks:array<struct<locator:string,text:string>>,reason:string>")
    def parsed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, contents in parts:
            rows = []
            for name, data in zip(names, contents):
                try:
                    found = (pdf_pages if name.lower().endswith(".pdf") else docx_paragraphs)(bytes(data))
                    rows.append(([{"locator": a, "text": b} for a, b in found], None))
                except Exception as e:  # a damaged file, or a parser that isn't there, is one reject
                    rows.append((None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["blocks", "reason"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,docm,pdf}").option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", parsed("path", "content").alias("p")).select("path", "p.*")
    return rows.where("reason is null").select("path", F.explode("blocks").alias("b")).select("path", "b.locator", "b.text"), rows.where("reason is not null").select("path", "reason")


def aligned_matrix(spark: SparkSession, rows_path: str, matrix_path: str) -> DataFrame:
    """Rows of a JSONL file, in order, with the rows of a NumPy matrix as ``embedding``; unequal numbers are an error."""
    import numpy as np

    files = spark.read.format("binaryFile").load(matrix_path).select("content").collect()  # one file, of a size that one task can read
    matrix = np.load(io.BytesIO(files[0]["content"]))
    lines = spark.read.json(rows_path).coalesce(1).withColumn("at", F.monotonically_increasing_id())
    if lines.count() != len(matrix):
        raise ValueError(f"{lines.count()} rows and {len(matrix)} vectors")
    vectors = spark.createDataFrame(pd.DataFrame({"at": range(len(matrix)), "embedding": [v.astype(float).tolist() for v in matrix]}), "at long, embedding array<double>")
    return lines.join(vectors, "at").drop("at")


# -- listings ----------------------------------------------------------------------------


def raw_listing(files: DataFrame, outputs: DataFrame, source: str, search: str = "", ext: str = ".pdf", unparsed_only: bool = True) -> DataFrame:
    """(path, filename, stage0_done, stage1_done), by path, of files(path) of a source; outputs(path) are the stages' files."""
    ext = f".{ext.lower().lstrip('.')}" if ext else ""
    rows = files.where(F.col("path").startswith(f"{source}/") & F.lower("path").endswith(ext) & F.contains(F.lower("path"), F.lit(search.lower())))
    done = outputs.select("path").distinct()
    for n, folder in enumerate(("00_docling_raw", "01_docling_clean00")):
        of = done.where(F.col("path").startswith(folder + "/")).select(F.regexp_replace(F.substring("path", len(folder) + 2, 1 << 20), r"\.md$", "").alias("path"), F.lit(True).alias(f"d{n}"))
        rows = rows.join(of, "path", "left").withColumn(f"stage{n}_done", F.coalesce(f"d{n}", F.lit(False))).drop(f"d{n}")
    rows = rows.where("not stage0_done") if unparsed_only else rows
    return rows.select("path", T.base_name(F.col("path")).alias("filename"), "stage0_done", "stage1_done").orderBy("path")


def tree(files: DataFrame, root: str = "", depth: int = 6) -> DataFrame:
    """(path, parent, name, type, level) of the files and folders below a root, sorted by path; names that begin with a dot and locks are hidden."""
    if not 0 <= depth <= 10:
        raise ValueError("a depth of 0 to 10")
    base, _ = T.subtree_root(root)
    rows = files.select(F.regexp_replace("path", "^/+|/+$", "").alias("path")).where(F.col("path").startswith(f"{base}/") if base else F.lit(True))
    parts = F.split(F.substring("path", len(base) + (2 if base else 1), 1 << 20), "/")
    rows = rows.select("path", parts.alias("parts")).where(~F.exists("parts", lambda p: p.startswith(".") | p.endswith(".lock")))
    steps = F.transform(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(depth + 1))), lambda k: F.struct(F.array_join(F.slice("parts", 1, k), "/").alias("path"), F.element_at("parts", k).alias("name"), F.when(k == F.size("parts"), "file").otherwise("dir").alias("type"), (k - 1).alias("level")))
    nodes = rows.select(F.explode(steps).alias("s")).select("s.*").distinct()
    return nodes.withColumn("parent", F.when(F.col("level") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")).orderBy("path")


def first_existing(wanted: DataFrame, existing: DataFrame, most: int = 3) -> DataFrame:
    """(key, path): of each key's candidate paths, in order, the first that exists; of several keys of one path the first, ``most`` at most by order."""
    from pyspark.sql import Window

    rows = wanted.select("key", "place", F.posexplode("candidates").alias("at", "path")).join(existing.select("path").distinct(), "path", "left_semi")
    one = rows.groupBy("key", "place").agg(F.min_by("path", "at").alias("path"))
    once = one.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("place", "key"))).where("r = 1")
    return once.orderBy("place", "key").limit(most).select("key", "path")


# -- literature --------------------------------------------------------------------------


def literature(works: DataFrame) -> DataFrame:
    """Records of raw works(doi, title, display_name, authorships, publication_year, abstract, abstract_inverted_index, pdf_url, cited_by_count).

    An abstract is put together from its inverted index; without a DOI and a link to a PDF a record is skipped, else pending.
    """
    authors = F.array_join(F.filter(F.transform(F.coalesce("authorships", F.array()), lambda a: a["author"]["display_name"]), lambda n: n.isNotNull()), ", ")
    doi = F.nullif(F.regexp_replace(F.coalesce("doi", F.lit("")), r"^https?://(dx\.)?doi\.org/", ""), F.lit(""))
    rows = works.select(
        doi.alias("doi"), F.coalesce(F.nullif("title", F.lit("")), "display_name", F.lit("(без названия)")).alias("title"), F.coalesce(F.nullif(authors, F.lit("")), F.lit("Unknown")).alias("authors"),
        F.col("publication_year").alias("year"), F.coalesce("abstract", T.from_positions(F.col("abstract_inverted_index")), F.lit("")).alias("abstract"), "pdf_url", F.col("cited_by_count").alias("citation_count"),
    )
    return rows.withColumn("fetch_status", F.when(F.col("doi").isNull() & F.col("pdf_url").isNull(), "SKIPPED").otherwise("PENDING"))


def library_articles(articles: DataFrame, base_url: str) -> DataFrame:
    """Records of a library's articles(name, annotation, authors array, year, link, ocr array): tags removed, the text joined."""
    year = F.col("year").cast("string")
    return articles.select(
        F.lit(None).cast("string").alias("doi"), T.without_tags(F.col("name")).alias("title"), F.coalesce(F.nullif(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", "), F.lit("")), F.lit("Unknown")).alias("authors"),
        F.when(year.rlike(r"^\d+$"), year.cast("int")).alias("year"), T.without_tags(F.col("annotation")).alias("abstract"),
        T.without_tags(F.array_join(F.coalesce("ocr", F.array().cast("array<string>")), "\n")).alias("fulltext"), F.concat(F.lit(base_url), F.coalesce("link", F.lit(""))).alias("url"),
    )


def paper_key(doi: Column, title: Column) -> Column:
    """Key by which papers are the same: the DOI, else the title, case and blanks aside; null for neither."""
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " ")))
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("doi:"), F.lower(doi))).otherwise(F.concat(F.lit("title:"), F.nullif(flat, F.lit(""))))


def redirected(pages_: DataFrame, redirects: DataFrame, most: int = 6) -> DataFrame:
    """pages(title) with ``target``: where redirects(src, dst) lead in ``most`` steps at most."""
    rows = pages_.select("title", F.col("title").alias("target"))
    hop = redirects.groupBy(F.col("src").alias("target")).agg(F.min("dst").alias("to"))
    for _ in range(most):
        rows = rows.join(hop, "target", "left").select("title", F.coalesce("to", "target").alias("target"))
    return rows
