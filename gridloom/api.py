"""The engine's entry points."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Sequence
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from .functions import jsonschema
from .operators import chunking, model_year
from .operators.blocks import BlockError
from .sources import corpus, html, pdf, urls

Progress = Callable[[str], None]
__all__ = ["BlockError", "build_chunks", "build_model_year_options", "extract_corpus", "extract_model_year_options", "link_model_year_options", "web_corpus"]

link_model_year_options = model_year.link
build_model_year_options = model_year.build


def _is_url(source: object) -> bool:
    return urlsplit(str(source)).scheme.lower() in ("http", "https")


def kind_of(sources: Sequence, source_type: str = "auto") -> str:
    """``html`` or ``pdf``: what was asked for, or what all of the sources are."""
    if not sources:
        raise ValueError("give at least one source")
    if source_type == "auto":
        if all(map(_is_url, sources)):
            return "html"
        if all(Path(str(s)).suffix.casefold() == ".pdf" and not _is_url(s) for s in sources):
            return "pdf"
        raise ValueError("sources must be all URLs or all PDF files, or have a source_type")
    if source_type not in ("html", "pdf"):
        raise ValueError(f"there is no source_type {source_type!r}")
    return source_type


def extract_corpus(
    spark: SparkSession, sources, output_directory: str | Path, *, source_type: str = "auto", max_pdf_files: int = 10, max_pdf_file_bytes: int = 50_000_000, max_url_pages: int = 20,
    url_timeout_seconds: float = 20.0, max_url_page_bytes: int = 5_000_000, progress: Progress | None = None,
) -> corpus.SavedCorpus:
    """Reads PDF files or web pages and saves their corpus."""
    given = [s for s in (sources if isinstance(sources, list | tuple) else [sources]) if s is not None and str(s).strip()]
    if kind_of(given, source_type) == "pdf":
        return pdf.prepare_pdf_corpus(spark, given, output_directory, max_pdf_files, max_pdf_file_bytes, progress)
    found = urls.parse_url_list("\n".join(map(str, given)), max_url_pages)
    return web_corpus(spark, urls.fetch(found, url_timeout_seconds, max_url_page_bytes, progress), output_directory, urls.url_request_key(found))


def web_corpus(spark: SparkSession, pages: Sequence[tuple[str, str, str]], root: str | Path, request_key: str) -> corpus.SavedCorpus:
    """Saves pages (requested URL, final URL, html) as one corpus."""
    rows = spark.createDataFrame([(i, final, body) for i, (_, final, body) in enumerate(pages)], "page_id long, url string, html string")
    texts = {r.page_id: r for r in html.html_text(rows).collect()}
    sources = []
    for i, (asked, final, _) in enumerate(pages):
        if not texts[i].text.strip():
            raise ValueError(f"{final} has no readable text; it may need JavaScript")
        sources.append({"source": i + 1, "kind": "html", "requested_url": asked, "final_url": final, "title": texts[i].title or final, "characters": len(texts[i].text)})
    return corpus.save_corpus(html.html_blocks(rows, corpus="web"), sources, root, request_key)


def build_chunks(
    spark: SparkSession, blocks: DataFrame | Sequence[dict] | str | Path, output_path: str | Path | None = None, *, strategy: str = "words", chunk_size: int = 450, chunk_overlap: int = 60,
    min_text_chunk_size: int = 100, max_text_page_span: int = 2,
) -> DataFrame:
    """Chunks of blocks, given as a DataFrame, a list or a blocks.json; with
    ``output_path`` they are written to one JSON file too."""
    if isinstance(blocks, str | Path):
        blocks = corpus.load_blocks(spark, blocks)
    elif not isinstance(blocks, DataFrame):
        blocks = corpus.blocks_from(spark, list(blocks))
    chunks = chunking.build_chunks(blocks, strategy, chunk_size, chunk_overlap, min_text_chunk_size, max_text_page_span)
    if output_path is not None:
        values = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None and k != "corpus_id"} for r in chunks.orderBy("corpus_id", "id").collect()]
        if not values:
            raise ValueError("no chunks could be made")
        corpus.write_atomically(Path(output_path), json.dumps(values, indent=2, ensure_ascii=False))
    return chunks


def extract_model_year_options(
    spark: SparkSession, pdf_path: str | Path, *, output_path: str | Path | None = None, schema: dict | None = None, schema_path: str | Path | None = None, profile: str = "auto", name: str | None = None,
    valid_from: str | None = None, max_pdf_file_bytes: int = 50_000_000,
) -> dict:
    """The linked document of a brochure PDF."""
    if schema is not None and schema_path is not None:
        raise ValueError("give schema or schema_path, not both")
    with tempfile.TemporaryDirectory() as folder:
        saved = extract_corpus(spark, str(pdf_path), folder, source_type="pdf", max_pdf_files=1, max_pdf_file_bytes=max_pdf_file_bytes)
        built = model_year.build(json.loads(saved.blocks_path.read_text(encoding="utf-8")), Path(pdf_path).name, profile, name, valid_from)
    wanted = schema if schema is not None else json.loads(Path(schema_path).read_text(encoding="utf-8")) if schema_path else None
    if wanted is not None:
        jsonschema.validate(built, wanted)
    if output_path is not None:
        corpus.write_atomically(Path(output_path), json.dumps(built, indent=2, ensure_ascii=False))
    return built
