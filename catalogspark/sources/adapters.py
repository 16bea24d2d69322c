"""Catalog tables derived from the driver's tables, and the same derivation as SQL.

Each view is a function of whole tables; `SQL` holds DuckDB's form of the same views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import classify_kind, fingerprint

NOW = "2024-03-01 00:00:00"
EXTS = ["txt", "md", "pdf", "png", "jpg", "mp4", "json", "fig", "zip", "xyz"]
STATES = ["pending", "failed", "missing", "unsupported"] + ["indexed"] * 7


class Catalog:
    """The catalog over one data folder. Attributes are lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.now = F.to_timestamp(F.lit(NOW))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def files(self) -> DataFrame:
        d, lab = self.table("documents"), self.table("labels")
        picks = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
        i = F.col("doc_id")
        rows = d.join(lab, "doc_id", "left").withColumns(
            {
                "file_id": i,
                "folder_id": F.col("source"),
                "folder_path": F.concat(F.lit("/archive/"), F.col("source")),
                "ext": picks(EXTS, 10),
            }
        )
        rows = rows.withColumn("name", F.concat(F.when(i % 7 == 0, "Screenshot ").otherwise("IMG_"), i.cast("string"), F.lit("."), "ext"))
        kind = classify_kind(F.col("name"), F.col("ext"), F.col("folder_path"))
        created = F.timestamp_seconds(F.lit(1704067200) + i * 3600)
        rows = rows.withColumns(
            {
                "kind": kind,
                "path": F.concat("folder_path", F.lit("/"), "name"),
                "bytes": F.col("n_chars") * 1024,
                "created_at": created,
                "modified_at": F.timestamp_seconds(F.lit(1704067200) + i * 3600 + (i % 5) * 86400),
            }
        )
        picture = F.col("kind").isin("photo", "screenshot")
        return rows.select(
            "file_id",
            "folder_id",
            "folder_path",
            "path",
            "name",
            "ext",
            "kind",
            "bytes",
            F.when(picture, 400 + (i * 37) % 4000).alias("width"),
            F.when(picture, 300 + (i * 53) % 3000).alias("height"),
            "created_at",
            "modified_at",
            fingerprint(F.col("bytes"), F.col("modified_at")).alias("hash"),
            F.coalesce(F.col("quality") == 1, F.lit(False)).alias("favorite"),
            picks(STATES, 11).alias("index_state"),
            picks(["none", "analysed", "described", "failed"], 4).alias("analysis_state"),
            (i % 5).alias("attempts"),
            picks(["none", "extracted", "pending", "failed", "unavailable"], 5).alias("ocr_state"),
            F.timestamp_seconds(F.lit(1704067260) + i * 3600).alias("indexed_at"),
            F.when(i % 3 == 0, "scanned").otherwise("none").alias("faces_state"),
            F.when(i % 6 == 0, "ollama:any").alias("engine"),
            F.when(i % 13 < 3, F.concat(F.lit("p"), (i % 13).cast("string"))).alias("project_id"),
            F.substring("text", 1, 40).alias("title"),
            F.substring("text", 41, 120).alias("description"),
            F.col("lang").alias("label"),
            F.col("text").alias("ocr_text"),
        )

    @property
    def file_tags(self) -> DataFrame:
        d, lab = self.table("documents"), self.table("labels")
        made = lambda df, tag, source: df.select(F.col("doc_id").alias("file_id"), tag.alias("tag"), F.lit(source).alias("source"))
        return (
            made(d.where("lang is not null"), F.col("lang"), "vision")
            .unionAll(made(lab.where("quality = 1"), F.lit("quality"), "user"))
            .unionAll(made(lab.where("toxic = 1"), F.lit("toxic"), "ocr"))
        )

    @property
    def faces(self) -> DataFrame:
        e = self.table("embeddings")
        n = self.table("documents").agg(F.count(F.lit(1)).alias("n"))
        return e.crossJoin(F.broadcast(n)).select(
            F.col("vec_id").alias("face_id"),
            (F.col("vec_id") % F.col("n")).alias("file_id"),
            ((F.col("vec_id") * 7919) % 1000 / 10.0).alias("quality"),
            F.col("label").cast("long").alias("person_id"),
            F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        )

    @property
    def people(self) -> DataFrame:
        p = self.faces.select("person_id").distinct()
        return p.select(
            "person_id",
            F.when(F.col("person_id") % 2 == 0, F.concat(F.lit("Person "), F.col("person_id").cast("string"))).alias("label"),
            (F.col("person_id") % 5 == 4).alias("hidden"),
        )

    @property
    def file_collections(self) -> DataFrame:
        i = F.col("file_id")
        return self.files.where(i % 17 == 0).select(F.lit("col-a").alias("collection_id"), "file_id").unionAll(
            self.files.where(i % 19 == 0).select(F.lit("col-b").alias("collection_id"), "file_id")
        )

    @property
    def observations(self) -> DataFrame:
        """One row per event: a path of a user's folder was seen, changed or removed."""
        return self.table("events").select(
            "event_id",
            "ts",
            F.concat(F.lit("folder"), (F.col("user_id") % 7).cast("string")).alias("folder"),
            F.concat(F.lit("/f/"), F.col("user_id").cast("string"), F.lit(".png")).alias("path"),
            F.when(F.col("event_type") == "error", "removed").otherwise("seen").alias("op"),
            (F.col("event_id") % 97 * 1000).alias("bytes"),
        )

    @property
    def edits(self) -> DataFrame:
        return self.table("events").select(
            "ts",
            F.col("event_id").alias("seq"),
            F.col("user_id").alias("key"),
            F.col("event_type").alias("field"),
            F.round("value", 4).cast("string").alias("value"),
        )


SQL = """
files AS (
  SELECT d.doc_id AS file_id, d.source AS folder_id, '/archive/' || d.source AS folder_path,
         '/archive/' || d.source || '/' || CASE WHEN d.doc_id % 7 = 0 THEN 'Screenshot ' ELSE 'IMG_' END || d.doc_id || '.'
           || ['txt','md','pdf','png','jpg','mp4','json','fig','zip','xyz'][d.doc_id % 10 + 1] AS path,
         CASE WHEN d.doc_id % 7 = 0 THEN 'Screenshot ' ELSE 'IMG_' END || d.doc_id || '.'
           || ['txt','md','pdf','png','jpg','mp4','json','fig','zip','xyz'][d.doc_id % 10 + 1] AS name,
         ['txt','md','pdf','png','jpg','mp4','json','fig','zip','xyz'][d.doc_id % 10 + 1] AS ext,
         CASE d.doc_id % 10 WHEN 0 THEN 'document' WHEN 1 THEN 'document' WHEN 2 THEN 'document' WHEN 6 THEN 'document'
              WHEN 5 THEN 'video' WHEN 7 THEN 'design' WHEN 8 THEN 'archive' WHEN 9 THEN 'other'
              ELSE CASE WHEN d.doc_id % 7 = 0 THEN 'screenshot' ELSE 'photo' END END AS kind,
         d.n_chars * 1024 AS bytes,
         CASE WHEN d.doc_id % 10 IN (3, 4) THEN 400 + (d.doc_id * 37) % 4000 END AS width,
         CASE WHEN d.doc_id % 10 IN (3, 4) THEN 300 + (d.doc_id * 53) % 3000 END AS height,
         make_timestamp((1704067200 + d.doc_id * 3600) * 1000000) AS created_at,
         make_timestamp((1704067200 + d.doc_id * 3600 + (d.doc_id % 5) * 86400) * 1000000) AS modified_at,
         coalesce(l.quality = 1, false) AS favorite,
         ['pending','failed','missing','unsupported','indexed','indexed','indexed','indexed','indexed','indexed','indexed']
           [d.doc_id % 11 + 1] AS index_state,
         ['none','analysed','described','failed'][d.doc_id % 4 + 1] AS analysis_state,
         d.doc_id % 5 AS attempts,
         ['none','extracted','pending','failed','unavailable'][d.doc_id % 5 + 1] AS ocr_state,
         make_timestamp((1704067260 + d.doc_id * 3600) * 1000000) AS indexed_at,
         CASE WHEN d.doc_id % 3 = 0 THEN 'scanned' ELSE 'none' END AS faces_state,
         CASE WHEN d.doc_id % 6 = 0 THEN 'ollama:any' END AS engine,
         CASE WHEN d.doc_id % 13 < 3 THEN 'p' || (d.doc_id % 13) END AS project_id,
         substring(d.text, 1, 40) AS title, substring(d.text, 41, 120) AS description, d.lang AS label, d.text AS ocr_text
  FROM documents d LEFT JOIN labels l USING (doc_id)
), file_tags AS (
  SELECT doc_id AS file_id, lang AS tag, 'vision' AS source FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT doc_id, 'quality', 'user' FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'toxic', 'ocr' FROM labels WHERE toxic = 1
), faces AS (
  SELECT vec_id AS face_id, vec_id % (SELECT count(*) FROM documents) AS file_id, (vec_id * 7919) % 1000 / 10.0 AS quality,
         CAST(label AS BIGINT) AS person_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings
), people AS (
  SELECT DISTINCT person_id, CASE WHEN person_id % 2 = 0 THEN 'Person ' || person_id END AS label,
         person_id % 5 = 4 AS hidden FROM faces
), file_collections AS (
  SELECT 'col-a' AS collection_id, file_id FROM files WHERE file_id % 17 = 0
  UNION ALL SELECT 'col-b', file_id FROM files WHERE file_id % 19 = 0
), observations AS (
  SELECT event_id, ts, 'folder' || (user_id % 7) AS folder, '/f/' || user_id || '.png' AS path,
         CASE WHEN event_type = 'error' THEN 'removed' ELSE 'seen' END AS op, event_id % 97 * 1000 AS bytes FROM events
), edits AS (
  SELECT ts, event_id AS seq, user_id AS key, event_type AS field, value FROM events
)
"""


def oracle(body: str) -> str:
    """DuckDB SQL over the views."""
    return f"WITH {SQL}\n{body}"
