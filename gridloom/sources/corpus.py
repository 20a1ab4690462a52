"""Saved corpora: identity, JSON files and the cache of requests."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import blocks as b
from ..schemas import BLOCK, CORPUS_VERSION


@dataclass(frozen=True)
class SavedCorpus:
    corpus_path: Path
    blocks_path: Path
    sources_path: Path
    request_key: str
    content_key: str
    source_count: int


def digest16(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def table_json() -> Column:
    """A table block without page and box as canonical JSON: keys sorted, nothing between."""
    return F.to_json(F.struct("caption", "headers", "heading_path", "page", "rows", "source_name", "source_url", "table_id", "type"), {"ignoreNullFields": "false"})


def content_keys(tables: DataFrame) -> DataFrame:
    """(corpus_id, content_key) of corpora of table blocks."""
    parts = F.array_sort(F.collect_list(F.struct("block_pos", table_json().alias("j"))))
    return tables.groupBy("corpus_id").agg(digest16(F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: p["j"]), ","), F.lit("]"))).alias("content_key"))


def as_dict(row: dict) -> dict:
    """A block row as the JSON object that it is saved as; fields of other kinds are left out."""
    kind = ("table_id", "caption", "headers", "rows") if row["type"] == "table" else ("text",)
    out = {k: row[k] for k in ("type", "source_name", "source_url", "page", "heading_path", *kind)}
    return out | ({"bbox": row["bbox"]} if row.get("bbox") is not None else {})


def write_atomically(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    began = path.with_name(path.name + ".tmp")
    began.write_text(text, encoding="utf-8")
    os.replace(began, path)


def save_corpus(blocks: DataFrame, sources: list[dict], root: str | Path, request_key: str, version: str = CORPUS_VERSION) -> SavedCorpus:
    """Saves one corpus as blocks.json, corpus.txt and sources.json in a folder
    named after its contents.  This is an export to single files; large sets of
    corpora are written with ``DataFrame.write`` instead."""
    rows = b.validated(b.usable(b.associate_headings(blocks)))
    shown = rows.select("*", b.rendered().alias("_shown")).orderBy("block_pos").collect()
    if not shown:
        raise ValueError("no readable text or table rows were found")
    values = [as_dict(r.asDict(recursive=True)) for r in shown]
    content = hashlib.sha256(json.dumps(values, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    folder = Path(root) / hashlib.sha256("|".join((version, request_key, content)).encode()).hexdigest()[:16]
    saved = SavedCorpus(folder / "corpus.txt", folder / "blocks.json", folder / "sources.json", request_key, content, len(sources))
    write_atomically(saved.corpus_path, "\n\n".join(r["_shown"] for r in shown).strip() + "\n")
    write_atomically(saved.blocks_path, json.dumps(values, indent=2, ensure_ascii=False))
    write_atomically(saved.sources_path, json.dumps(sources, indent=2, ensure_ascii=False))
    return saved


def load_blocks(spark: SparkSession, path: str | Path, corpus_id: str = "corpus") -> DataFrame:
    """Block rows of a blocks.json, checked."""
    values = json.loads(Path(path).read_text(encoding="utf-8"))
    return b.validated(blocks_from(spark, values, corpus_id))


def blocks_from(spark: SparkSession, values: list[dict], corpus_id: str = "corpus") -> DataFrame:
    if not isinstance(values, list):
        raise b.BlockError("blocks must be a JSON list")
    rows = []
    for i, v in enumerate(values):
        if not isinstance(v, dict):
            raise b.BlockError(f"Block {i}: must be a JSON object")
        page = v.get("page")
        if page is not None and (isinstance(page, bool) or not isinstance(page, int)):
            raise b.BlockError(f"Block {i}: page must be a positive integer or null")
        row = {"corpus_id": corpus_id, "block_pos": i, "source_url": "", "heading_path": []} | {k: v[k] for k in BLOCK.names if k in v}
        row["bbox"] = [float(x) for x in row["bbox"]] if row.get("bbox") is not None else None
        try:
            rows.append(tuple(row.get(k) for k in BLOCK.names))
        except TypeError as e:
            raise b.BlockError(f"Block {i}: {e}") from e
    try:
        return spark.createDataFrame(rows, BLOCK)
    except Exception as e:
        raise b.BlockError(f"a field has another type than the contract gives: {e}") from e


def pointer_path(root: str | Path, request_key: str) -> Path:
    return Path(root) / "_requests" / f"{request_key}.json"


def save_pointer(root: str | Path, saved: SavedCorpus) -> None:
    value = {"folder": saved.blocks_path.parent.name, "content_key": saved.content_key, "source_count": saved.source_count}
    write_atomically(pointer_path(root, saved.request_key), json.dumps(value))


def cached(root: str | Path, request_key: str) -> SavedCorpus | None:
    """The corpus of an earlier request; anything missing or malformed is a miss."""
    try:
        value = json.loads(pointer_path(root, request_key).read_text(encoding="utf-8"))
        folder = Path(root) / value["folder"]
        saved = SavedCorpus(folder / "corpus.txt", folder / "blocks.json", folder / "sources.json", request_key, str(value["content_key"]), int(value["source_count"]))
        return saved if all(p.is_file() for p in (saved.corpus_path, saved.blocks_path, saved.sources_path)) else None
    except (OSError, ValueError, KeyError, TypeError):
        return None


def readable(blocks: DataFrame) -> DataFrame:
    return b.corpus_text(b.usable(b.associate_headings(blocks))).withColumn("characters", F.length(t.strip(F.col("text"))))
