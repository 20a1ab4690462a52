import json
import threading
import urllib.error
import urllib.request

import pytest

from gridloom import __main__ as cli
from gridloom import api, service
from gridloom.plans import queries as plans
from gridloom.sources import html, pdf
from gridloom.streaming import chunks as streaming


def test_sources_are_routed_and_limited(spark, tmp_path):
    for bad, said in [([], "at least one"), (["https://a.org", "x.pdf"], "all URLs"), (["x.txt"], "all URLs"), (["x.pdf"], "no file")]:
        with pytest.raises(ValueError, match=said):
            api.extract_corpus(spark, bad, tmp_path)
    with pytest.raises(ValueError, match="source_type"):
        api.extract_corpus(spark, ["x"], tmp_path, source_type="other")
    a, b, c = (tmp_path / n for n in ("a.pdf", "b.PDF", "c.pdf"))
    for p in (a, b):
        p.write_bytes(b"%PDF-1.7 same")
    c.write_bytes(b"not one")
    assert pdf.pdf_paths([a, str(a), b]) == [a.resolve(), b.resolve()]
    assert pdf.pdf_request_key([a]) == pdf.pdf_request_key([b]) != pdf.pdf_request_key([a, b])
    for bad, options in [([c], {}), ([a], {"max_file_bytes": 3}), ([a, b], {"max_files": 1}), (None, {})]:
        with pytest.raises(ValueError):
            pdf.pdf_paths(bad, **options)
    files = pdf.pdf_files(spark, str(tmp_path))
    assert {r.path[-5:]: r.is_pdf for r in files.collect()} == {"a.pdf": True, "b.PDF": True, "c.pdf": False}
    key = pdf.file_keys(files.filter("is_pdf").selectExpr("1 as g", "path", "length", "content"), "g", "path").first().request_key
    assert key == pdf.pdf_request_key([a, b])


def test_pages_to_corpus_to_chunks(spark, tmp_path):
    saved = api.web_corpus(spark, [("https://a", "https://a/", "<title>T</title><p>one two three four</p>")], tmp_path, "k")
    assert json.loads(saved.sources_path.read_text())[0]["title"] == "T"
    with pytest.raises(ValueError, match="JavaScript"):
        api.web_corpus(spark, [("https://a", "https://a/", "")], tmp_path, "k")
    target = tmp_path / "chunks.json"
    api.build_chunks(spark, saved.blocks_path, target, chunk_size=3, chunk_overlap=1)
    assert [c["text"] for c in json.loads(target.read_text())] == ["T one two", "two three four"]
    with pytest.raises(ValueError, match="no chunks"):
        api.build_chunks(spark, [], target)


def test_the_service_answers(spark, monkeypatch):
    web = service.server(spark, port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{web.server_address[1]}"

    def ask(path, body=None, kind="application/json"):
        data = body if body is None or isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data, {"Content-Type": kind})) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert ask("/health") == (200, {"status": "ok"}) and ask("/status")[1]["build"]["commit"] == "unknown"
    block = {"type": "paragraph", "text": "one two three four", "source_name": "s"}
    status, got = ask("/v1/chunks", {"blocks": [block], "chunk_size": 3, "chunk_overlap": 1})
    assert status == 200 and [c["text"] for c in got["chunks"]] == ["one two three", "three four"]
    assert ask("/v1/chunks", {"blocks": [block], "chunk_size": 3, "chunk_overlap": 3})[0] == 422
    assert ask("/v1/chunks", {"blocks": [{"type": 1}]})[0] == 422 and ask("/v1/chunks", b"{")[0] == 422
    assert ask("/v1/model-year-options", {"blocks": []})[0] == 422
    form = "application/x-www-form-urlencoded"
    assert ask("/v1/extract", b"", form)[0] == 422 and ask("/v1/extract", b"urls=https%3A%2F%2Fa.org", form)[0] == 403
    mark = b'--x\r\nContent-Disposition: form-data; name="files"; filename="a.%s"\r\n\r\n%%PDF-\r\n--x--\r\n'
    assert ask("/v1/extract", mark % b"txt", "multipart/form-data; boundary=x")[0] == 422
    assert ask("/v1/extract", mark % b"pdf", "multipart/form-data; boundary=x")[0] in (422, 500)
    assert ask("/other")[0] == 404
    web.shutdown()
    for bad in ("0", "x"):
        monkeypatch.setenv("GRIDLOOM_MAX_PDF_FILES", bad)
        with pytest.raises(RuntimeError, match="positive integer"):
            service.Limits()


def test_build_info_and_command_line(tmp_path):
    assert service.build_info("ABCDEF0123", "2026-01-01T02:00:00+02:00") == {"commit": "abcdef0", "commitTime": "2026-01-01T00:00:00Z"}
    assert service.build_info("unknown", "unknown") == {"commit": "unknown", "commitTime": "unknown"}
    for bad in (("xyz", "unknown"), ("abcdef0", "2026-01-01")):
        with pytest.raises(ValueError):
            service.build_info(*bad)
    draft = tmp_path / "d.json"
    draft.write_text(json.dumps({"versions": [{"versionData": {"marketingName": "A"}}], "options": []}))
    assert cli.main(["link", str(draft), str(tmp_path / "o.json"), "--codes", "x y"]) == 0
    assert json.loads((tmp_path / "o.json").read_text())["versions"][0]["versionData"]["versionCode"] == "X_Y"
    assert cli.main(["link", str(tmp_path / "none.json"), str(tmp_path / "o.json")]) == 1


def test_streamed_corpora_are_chunked_once(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<h1>Head {i}</h1><p>text of page {i}</p>") for i in range(3)], "page_id long, url string, html string")
    html.html_blocks(pages).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = streaming.stream_chunks(streaming.read_blocks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), least=0)
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("corpus_id").distinct().count() == 3 and got.count() == 3


def test_every_oracle_has_its_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())
