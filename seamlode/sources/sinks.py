"""Sinks: idempotent loads, documents by id, vectors, glossaries, reports, a folder of objects.

A table is a folder of versions; a new one is written whole beside the others and then named in one
small file, so readers see the old or the new one, and a load that is lost halfway leaves nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamlode.operators import graph


class Store:
    """Files of any store that Spark's Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark.sparkContext._jvm

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def put(self, name: str, data: bytes) -> None:
        """Write under another name, then rename, so that no reader sees a part of it."""
        fs, path = self._at(name)
        _, part = self._at(f"{name}.{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if fs.exists(path):
            fs.delete(path, False)
        if not fs.rename(part, path):
            raise OSError(f"can't rename to {name}")

    def put_text(self, name: str, text: str) -> None:
        self.put(name, text.encode())

    def get(self, name: str) -> bytes | None:
        rows = self.spark.read.format("binaryFile").load(f"{self.root}/{name}").select("content").collect() if self.exists(name) else []
        return bytes(rows[0]["content"]) if rows else None

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def delete(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.delete(path, True)


class Table:
    """A table that keyed loads go into."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, key: list[str]):
        self.spark, self.schema, self.key = spark, schema, key
        self.store, self.name = Store(spark, f"{root.rstrip('/')}/{name}"), name

    def read(self) -> DataFrame:
        version = self.store.get("current")
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.store.root}/{version.decode()}")

    def replace(self, rows: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.root}/{version}")
        before = self.store.get("current")
        self.store.put_text("current", version)
        if before is not None:
            self.store.delete(before.decode())

    def insert_new(self, rows: DataFrame) -> dict[str, int]:
        """Rows whose key isn't there; loading them again adds nothing. Gives what was read and what was added."""
        now = self.read()
        had = now.count()
        self.replace(graph.upsert_new(now, rows.select(*now.columns), self.key))
        return {"read": rows.count(), "added": self.read().count() - had}

    def put(self, rows: DataFrame) -> None:
        """Rows in the place of those of their key."""
        now = self.read()
        others = [c for c in now.columns if c not in self.key]
        one = rows.groupBy(*self.key).agg(F.max(F.struct(*others)).alias("r")).select(*self.key, "r.*") if others else rows.select(*self.key).distinct()
        self.replace(now.join(one.select(*self.key), self.key, "left_anti").unionByName(one.select(*now.columns)))

    def get(self, keys: list) -> DataFrame:
        """Rows of the keys, empty and null ones aside."""
        wanted = [k for k in dict.fromkeys(keys) if k not in (None, "")]
        return self.read().where(F.col(self.key[0]).isin(wanted)) if wanted else self.read().limit(0)

    def supersede(self, rows: DataFrame, id_col: str, by_col: str = "superseded_by") -> None:
        """Add rows(old_id, and a row) and mark the old versions with the new ones' ids."""
        now, new = self.read(), rows.drop("old_id")
        marks = rows.where("old_id is not null").select(F.col("old_id").alias(id_col), F.col(id_col).alias("_by"))
        marked = now.join(marks, id_col, "left").withColumn(by_col, F.coalesce("_by", by_col)).select(*now.columns)
        self.replace(marked.unionByName(new.select(*now.columns)))


def vector_rows(docs: DataFrame, most: int = 8000) -> DataFrame:
    """(id, document, path) as a vector store keeps them: an id from the path, the text cut."""
    return docs.select(F.left(F.sha2("path", 256), F.lit(16)).alias("id"), F.left("text", F.lit(most)).alias("document"), "path")


def content_id(namespace_hex: str, *parts: Column) -> Column:
    """An id of what a row says, so that a row met again in another place has the id that it had."""
    from seamlode.functions.text import uuid5

    return uuid5(namespace_hex, F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def write_glossary(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a folder of JSON lines."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")


def write_facts(facts: dict[str, DataFrame], folder: str) -> None:
    """Documents, entities and relations as Parquet, entities by label."""
    for name, df in facts.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("label") if name == "entities" and "label" in df.columns else writer).parquet(f"{folder.rstrip('/')}/{name}")


def write_report(store: Store, results: DataFrame, name: str = "report") -> None:
    """The report of a run as Markdown, HTML and JSON."""
    import html
    import json

    from seamlode.operators import quality

    md = quality.report(results)
    store.put_text(f"{name}.md", md)
    store.put_text(f"{name}.html", f"<!DOCTYPE html><meta charset=utf-8><pre>{html.escape(md)}</pre>\n")
    store.put_text(f"{name}.json", json.dumps(quality.summary(results).first().asDict(), ensure_ascii=False))
