"""A small HTTP service over one Spark session, on the standard library."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable
from datetime import UTC, datetime
from email.message import Message
from email.parser import BytesParser
from email.policy import default as mail_policy
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import BinaryIO
from urllib.parse import parse_qsl

from pyspark.sql import SparkSession

from . import __version__, api
from .functions import jsonschema
from .functions.jsonschema import SchemaError
from .sources.corpus import SavedCorpus


def positive(name: str, default, kind: type = int):
    """A positive number of the environment."""
    raw = os.environ.get(name)
    if raw is None:
        return default
    try:
        value = kind(raw)
    except ValueError:
        value = 0
    if value <= 0:
        raise RuntimeError(f"{name} must be a positive {'integer' if kind is int else 'number'}")
    return value


def flag(name: str, default: bool = False) -> bool:
    return default if name not in os.environ else os.environ[name].strip().casefold() in ("1", "true", "yes", "on")


def build_info(commit: str, time: str) -> dict:
    """Seven digits of the commit and its time in UTC; ``unknown`` stays."""
    commit, time = commit.strip(), time.strip()
    if commit != "unknown":
        if not re.fullmatch(r"[0-9a-fA-F]{7,64}", commit):
            raise ValueError("the commit must have at least seven hexadecimal digits")
        commit = commit[:7].lower()
    if time != "unknown":
        at = datetime.fromisoformat(time.replace("Z", "+00:00"))
        if at.tzinfo is None:
            raise ValueError("the commit's time must have an offset")
        time = at.astimezone(UTC).isoformat().replace("+00:00", "Z")
    return {"commit": commit, "commitTime": time}


#: Bytes of an upload that are held at once.
PIECE = 1 << 20


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


class Limits:
    """Read from the environment once, when the service starts."""

    def __init__(self):
        self.files = positive("GRIDLOOM_MAX_PDF_FILES", 10)
        self.file_bytes = positive("GRIDLOOM_MAX_PDF_FILE_BYTES", 50_000_000)
        self.urls = positive("GRIDLOOM_MAX_URL_PAGES", 20)
        self.page_bytes = positive("GRIDLOOM_MAX_URL_PAGE_BYTES", 5_000_000)
        self.timeout = positive("GRIDLOOM_URL_TIMEOUT_SECONDS", 20.0, float)
        self.allow_urls = flag("GRIDLOOM_ALLOW_URLS")


def extract(spark: SparkSession, limits: Limits, files: list[tuple[str, Path]], urls: list[str]) -> dict:
    if bool(files) == bool(urls):
        raise Refused(422, "give either files or urls")
    with tempfile.TemporaryDirectory() as folder:
        if urls:
            if len(urls) > limits.urls:
                raise Refused(413, f"at most {limits.urls} URLs are accepted")
            if not limits.allow_urls:
                raise Refused(403, "URLs are switched off")
            sources = urls
        else:
            if len(files) > limits.files:
                raise Refused(413, f"at most {limits.files} files are accepted")
            sources = []
            for i, (name, path) in enumerate(files, 1):
                if not name.casefold().endswith(".pdf"):
                    raise Refused(422, f"{name} is no PDF file")
                if path.stat().st_size > limits.file_bytes:
                    raise Refused(413, f"{name} has more than {limits.file_bytes} bytes")
                target = Path(folder, f"{i:02}", Path(name).name)
                target.parent.mkdir()
                path.replace(target)
                sources.append(str(target))
        saved = api.extract_corpus(spark, sources, Path(folder, "out"), source_type="html" if urls else "pdf", max_pdf_files=limits.files, max_pdf_file_bytes=limits.file_bytes, max_url_pages=limits.urls, url_timeout_seconds=limits.timeout, max_url_page_bytes=limits.page_bytes)
        return artifacts(saved)


def artifacts(saved: SavedCorpus) -> dict:
    """A saved corpus as one answer."""
    read = lambda path: path.read_text(encoding="utf-8")
    keys = {"corpus_id": saved.blocks_path.parent.name, "request_key": saved.request_key, "content_key": saved.content_key, "source_count": saved.source_count}
    return keys | {"blocks": json.loads(read(saved.blocks_path)), "corpus_text": read(saved.corpus_path), "sources": json.loads(read(saved.sources_path))}


def chunk_options(body: dict) -> dict:
    """The options of a chunk request, checked."""
    if not isinstance(body.get("blocks"), list):
        raise Refused(422, "blocks must be a JSON list")
    found = {"strategy": body.get("strategy", "words")}
    for name, default, least in (("chunk_size", 450, 1), ("chunk_overlap", 60, 0), ("min_text_chunk_size", 100, 0), ("max_text_page_span", 2, 1)):
        value = found[name] = body.get(name, default)
        if isinstance(value, bool) or not isinstance(value, int) or value < least:
            raise Refused(422, f"{name} must be a whole number of at least {least}")
    if found["chunk_overlap"] >= found["chunk_size"]:
        raise Refused(422, "chunk_overlap must be below chunk_size")
    return found


def chunks(spark: SparkSession, body: dict) -> dict:
    rows = api.build_chunks(spark, body.get("blocks"), **chunk_options(body))
    found = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None and k != "corpus_id"} for r in rows.orderBy("id").collect()]
    if not found:
        raise Refused(422, "no chunks could be made")
    return {"count": len(found), "chunks": found}


def handle(spark: SparkSession, limits: Limits, path: str, body: dict, files: list[tuple[str, Path]] = (), urls: list[str] = ()) -> dict:
    try:
        if path == "/v1/extract":
            return extract(spark, limits, list(files), list(urls))
        if path == "/v1/chunks":
            return chunks(spark, body)
        if path == "/v1/model-year-options":
            if not isinstance(body.get("blocks"), list):
                raise Refused(422, "blocks must be a JSON list")
            built = api.build_model_year_options(body["blocks"], body.get("source_name"), body.get("profile", "auto"), body.get("name"), body.get("valid_from"))
            if body.get("schema") is not None:
                jsonschema.validate(built, body["schema"])
            return built
    except Refused:
        raise
    except (ValueError, TypeError, KeyError, AttributeError, SchemaError) as e:
        raise Refused(422, str(e)) from e
    except Exception as e:
        raise Refused(500, str(e)) from e
    raise Refused(404, "there is no such path")


def form(kind: str, stream: BinaryIO, size: int, folder: Path, limits: Limits) -> tuple[list[tuple[str, Path]], list[str]]:
    """Files and URLs of a multipart form.  Files go to ``folder`` in pieces of
    at most PIECE bytes, so a large one is never held; too many and too large
    ones are refused as they come."""
    head = Message()
    head["Content-Type"] = kind
    mark = head.get_boundary()
    if not mark:
        raise Refused(422, "the form has no boundary")
    mark = b"\r\n--" + mark.encode()
    held, left = bytearray(b"\r\n"), size

    def more() -> None:
        nonlocal left
        data = stream.read(min(PIECE, left))
        if not data:
            raise Refused(422, "the form ends within a part")
        left -= len(data)
        held.extend(data)

    def until(end: bytes, take: Callable[[bytes], object]) -> None:
        while (at := held.find(end)) < 0:
            spare = max(0, len(held) - len(end) + 1)
            take(bytes(held[:spare]))
            del held[:spare]
            more()
        take(bytes(held[:at]))
        del held[: at + len(end)]

    files, urls = [], []
    until(mark, lambda _: None)
    while True:
        while len(held) < 2:
            more()
        if held[:2] == b"--":
            return files, urls
        lines = bytearray()
        until(b"\r\n\r\n", lines.extend)
        about = BytesParser(policy=mail_policy).parsebytes(bytes(lines).lstrip() + b"\r\n\r\n", headersonly=True)
        if about.get_filename():
            if len(files) == limits.files:
                raise Refused(413, f"at most {limits.files} files are accepted")
            path = folder / f"part-{len(files)}"
            with path.open("wb") as out:

                def put(data: bytes, out=out, name=about.get_filename()) -> None:
                    if out.tell() + len(data) > limits.file_bytes:
                        raise Refused(413, f"{name} has more than {limits.file_bytes} bytes")
                    out.write(data)

                until(mark, put)
            files.append((about.get_filename(), path))
        else:
            value = bytearray()
            until(mark, value.extend)
            if about.get_param("name", header="content-disposition") == "urls":
                urls.append(value.decode().strip())


def parts(kind: str, stream: BinaryIO, size: int, folder: Path, limits: Limits) -> tuple[dict, list[tuple[str, Path]], list[str]]:
    """JSON, or the files and URLs of a form."""
    if kind.startswith("multipart/"):
        return {}, *form(kind, stream, size, folder, limits)
    body = stream.read(size)
    if kind.startswith("application/json"):
        try:
            value = json.loads(body)
        except ValueError as e:
            raise Refused(422, f"the body is no JSON: {e}") from e
        if not isinstance(value, dict):
            raise Refused(422, "the body must be a JSON object")
        return value, [], []
    if kind.startswith("application/x-www-form-urlencoded"):
        return {}, [], [v for k, v in parse_qsl(body.decode()) if k == "urls"]
    raise Refused(422, f"a body of {kind or 'no kind'} can't be read")


def server(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    limits = Limits()
    build = build_info(os.environ.get("GRIDLOOM_COMMIT", "unknown"), os.environ.get("GRIDLOOM_COMMIT_TIME", "unknown"))

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, value: dict) -> None:
            data = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            found = {"/health": {"status": "ok"}, "/status": {"status": "UP", "git": {"commit": {"id": {"abbrev": build["commit"]}, "time": build["commitTime"]}}, "version": __version__, "build": build}}.get(self.path)
            self.answer(200 if found else 404, found or {"detail": "there is no such path"})

        def do_POST(self):
            try:
                size = int(self.headers.get("Content-Length", 0))
                if size > limits.files * limits.file_bytes + (1 << 20):
                    raise Refused(413, "the request is too large")
                with tempfile.TemporaryDirectory() as folder:
                    self.answer(200, handle(spark, limits, self.path, *parts(self.headers.get("Content-Type", ""), self.rfile, size, Path(folder), limits)))
            except Refused as e:
                self.answer(e.status, {"detail": str(e)})

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
