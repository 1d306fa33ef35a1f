"""Document sources: every loader gives (source_root, relative_source, file_type,
position, title, text) rows, read in parallel by Spark's own readers."""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from taleweave.functions import text as T

# File extensions and their types.
TYPES = {
    "txt": "text", "text": "text", "log": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "csv": "csv", "json": "json", "jsonl": "jsonl", "pdf": "pdf", "docx": "docx",
}
EXCLUDED = (".git", ".venv", "__pycache__", ".pytest_cache", "node_modules")


def file_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), ext)


def files(spark: SparkSession, root: str, pattern: str = "*", extensions: list[str] | None = None, exclude_dirs: tuple[str, ...] = EXCLUDED, strict: bool = False) -> DataFrame:
    """(source_root, relative_source, file_type, size, modified_at, sha256, content) of a
    folder tree in the order of paths. Excluded folder names are tested on the relative
    path. A file of unknown type is left out, or with strict raises."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = re.escape(root.rstrip("/").removeprefix("file:"))
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), rf"^.*?{base}/", "")
    x = raw.select(F.lit(root).alias("source_root"), rel.alias("relative_source"), file_type(F.col("path")).alias("file_type"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("sha256"), "content")
    parts = F.slice(F.split("relative_source", "/"), F.lit(1), F.greatest(F.size(F.split("relative_source", "/")) - 1, F.lit(0)))
    x = x.filter(~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in exclude_dirs])))
    if extensions:
        x = x.filter(F.lower(F.regexp_extract("relative_source", r"(\.[^./]+)$", 1)).isin(*[e if e.startswith(".") else "." + e for e in extensions]))
    if strict:
        return x.withColumn("file_type", F.when(F.col("file_type").isNull(), F.raise_error(F.concat(F.lit("unsupported file: "), "relative_source"))).otherwise(F.col("file_type")))
    return x.filter("file_type is not null")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.skip, self.in_title = [], "", 0, False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.in_title = tag == "title" or self.in_title

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(data.strip())
            if self.in_title:
                self.title += data.strip()


def html_text(page: str) -> str:
    """Text nodes without scripts and styles, one per line; the title stays in it."""
    p = _Text()
    p.feed(page)
    p.close()
    return "\n".join(p.parts)


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8")
    out = []
    for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S):
        t = html.unescape("".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.S)))
        if t.strip():
            out.append(t)
    return "\n\n".join(out)


@F.pandas_udf(StringType())
def _html(pages: pd.Series) -> pd.Series:
    return pages.map(html_text, na_action="ignore")


@F.pandas_udf(StringType())
def _docx(contents: pd.Series) -> pd.Series:
    def one(c):
        try:
            return docx_text(c)
        except Exception:
            return None  # an unreadable file is a null text

    return contents.map(one, na_action="ignore")


def html_title(page: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def csv_rows(content: bytes) -> list[tuple[int, str]]:
    """(row number from 1, 'column: value' lines without empty values) of each record."""
    rows = csv.DictReader(io.StringIO(content.decode("utf-8-sig", "replace")))
    return [(i, "\n".join(f"{k}: {v}" for k, v in r.items() if k and isinstance(v, str) and v.strip())) for i, r in enumerate(rows, 1)]


def extracted(loaded: DataFrame, kind: str, extract: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """(source_root, relative_source, file_type, position, title, text) of the files of a
    type by a function from the content to (position, text) parts, such as the pages of
    a PDF or the lines an image reader finds. A file it fails on gives a null text."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for root, rel, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    parts = extract(content)
                except Exception:
                    parts = [(0, None)]
                title = re.sub(r"\.[^./]*$", "", rel.rsplit("/", 1)[-1]).translate(str.maketrans("_-", "  "))
                out += [(root, rel, kind, int(p), title, t) for p, t in parts]
            cols = list(zip(*out)) or [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.string()) for i, c in enumerate(cols)], ["source_root", "relative_source", "file_type", "position", "title", "text"])

    rows = loaded.filter(F.col("file_type") == kind).select("source_root", "relative_source", "content")
    return rows.mapInArrow(run, "source_root string, relative_source string, file_type string, position int, title string, text string")


def documents(loaded: DataFrame) -> DataFrame:
    """(source_root, relative_source, file_type, position, title, text) of files().
    Whole-file types give one row, JSON lists one per item (position from 0), JSON
    lines one per line, CSV one per record (position from 1)."""
    ids = ["source_root", "relative_source", "file_type"]
    raw = F.decode("content", "UTF-8")
    whole = loaded.filter(F.col("file_type").isin("text", "markdown", "html", "docx"))
    stem = F.translate(T.source_key(F.col("relative_source")), "_-", "  ")
    plain = whole.filter("file_type in ('text', 'markdown')").select(*ids, F.lit(0).alias("position"), F.coalesce(F.when(F.col("file_type") == "markdown", T.first_heading(raw)), stem).alias("title"), raw.alias("text"))
    pages = whole.filter("file_type = 'html'").select(*ids, F.lit(0).alias("position"), F.coalesce(html_title(raw), stem).alias("title"), _html(raw).alias("text"))
    word = whole.filter("file_type = 'docx'").select(*ids, F.lit(0).alias("position"), stem.alias("title"), _docx("content").alias("text"))
    json_ = loaded.filter("file_type = 'json'").withColumn("_v", F.try_parse_json(raw))
    items = json_.select(*ids, stem.alias("title"), F.posexplode(F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), F.array("_v"))).alias("position", "_i")).select(*ids, "position", "title", F.to_json("_i").alias("text"))
    rows = loaded.filter("file_type = 'jsonl'").select(*ids, stem.alias("title"), F.posexplode(F.split(raw, r"\r?\n")).alias("position", "text")).filter("trim(text) <> ''").select(*ids, "position", "title", "text")
    return plain.unionByName(pages).unionByName(word).unionByName(items).unionByName(rows).unionByName(extracted(loaded, "csv", csv_rows))


def row_documents(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, text): each row as 'column: value' lines; empty and null values are left out."""
    cols = columns or [c for c in df.columns if c != key]
    parts = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in cols]
    return df.select(F.col(key).alias("key"), F.concat_ws("\n", *parts).alias("text"))


def csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per CSV record, every column read as text."""
    df = spark.read.csv(path, header=True)
    parts = [F.when(F.trim(F.col(f"`{c}`")) != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in df.columns]
    return df.select(F.col("_metadata.file_path").alias("source"), F.concat_ws("\n", *parts).alias("text"))


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Question cases from JSON lines; missing lists are empty."""
    schema = "id string, question string, answer string, sources array<string>, evidence array<string>, tags array<string>"
    none = F.array().cast("array<string>")
    df = spark.read.schema(schema).json(path)
    return df.select("id", "question", "answer", *[F.coalesce(c, none).alias(c) for c in ("sources", "evidence", "tags")])
