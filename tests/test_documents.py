import hashlib
import io
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as t
from gridloom.operators import blocks as b
from gridloom.operators import chunking, layout
from gridloom.plans import queries
from gridloom.sources import corpus, html, urls


def text(x, page=None, path=(), kind="paragraph", source="s"):
    return {"type": kind, "text": x, "source_name": source, "page": page, "heading_path": list(path)}


def table(headers, rows, page=None, path=(), caption="", tid="t"):
    return {"type": "table", "table_id": tid, "caption": caption, "headers": headers, "rows": rows, "source_name": "s", "page": page, "heading_path": list(path)}


def chunks(spark, values, size=30, overlap=0, **options):
    return chunking.chunk_blocks(corpus.blocks_from(spark, values), size, overlap, **options).orderBy("id").collect()


def test_words_and_windows(spark):
    row = spark.createDataFrame([("Hello, World! Isn't this Dr. Watson? a_b",)], "x string")
    assert row.select(t.tokens(row.x).alias("w")).first().w == ["Hello", "World", "Isn't", "this", "Dr", "Watson", "a", "b"]
    word = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
    pick = random.Random(1)
    texts = ["", "...", "one two three four", *("".join(pick.choices(["ab ", "c'd", "_", ", ", "é", "(", "\n", "9"], k=40)) for _ in range(30))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for size, overlap in ((3, 1), (5, 0), (1, 0)):
        got = {}
        for r in chunking.chunk_words(df, "x", size, overlap).orderBy("i", "id").collect():
            got.setdefault(r.i, []).append((r.text, r.source_text))
        for i, x in enumerate(texts):
            found, want, start = list(word.finditer(x)), [], 0
            while start < len(found):
                end = min(start + size, len(found))
                stop = found[end].start() if end < len(found) else len(x)
                want.append((" ".join(m[0] for m in found[start:end]), x[found[start].start() : stop].strip()))
                if end == len(found):
                    break
                start += size - overlap
            assert got.get(i, []) == want
    for bad in ((0, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            chunking.check(*bad)


def test_wrapped_lines_are_joined_without_python(spark):
    pick = random.Random(2)
    texts = [None, "", "-", "a-\n\nb", "-\n\nb", "\n\n a\n-\n b", *("".join(pick.choices("a- \n\n\x01", k=9)) for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = {r.i: r.j for r in df.select("i", t.join_wrapped(df.x).alias("j")).collect()}
    assert got == {i: layout.join_wrapped((x or "").split("\n")) for i, x in enumerate(texts)}
    plan = queries.queries()["join_wrapped_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_windows_in_sql_move_no_texts(spark):
    found = queries.queries()["chunk_words_in_sql"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
    spark.createDataFrame([(1, "a b c d"), (2, " ."), (3, None)], "i int, s string").createOrReplaceTempView("few")
    whole = spark.sql("SELECT i, w.* FROM few, LATERAL chunk_words(s, 2, 1) w")
    rows = spark.sql("SELECT i, w.id, w.text, w.source_text FROM (SELECT i, word_windows(s, 2, 1) AS f FROM few) LATERAL VIEW explode(f) AS w")
    assert sorted(rows.collect()) == sorted(whole.collect()) and rows.count() == 3


def test_a_long_text_is_not_copied_into_each_window(spark):
    words = [f"w{i}" for i in range(60_000)]
    values = [text(" ".join(words[i : i + 600])) for i in range(0, len(words), 600)]
    got = chunks(spark, values, 30, 10)
    assert [c.text for c in got] == [" ".join(words[i : i + 30]) for i in range(0, len(words) - 10, 20)]  # 3,000 windows, that would hold 60,000 words each


def test_tables_are_packed_by_rows(spark):
    price = table(["Model", "Power", "Price"], [["A8 55 TFSI", "340 LE", "41256010 HUF"]], 2, ["Models"])
    (one,) = chunks(spark, [price])
    assert one.source_text == "Models\nModel = A8 55 TFSI; Power = 340 LE; Price = 41256010 HUF." and one.page == 2 and one.table_prefix == "Models"
    packs = chunks(spark, [table(["A"], [["x y"], ["z"], ["one two three four five six"], ["q"]])], size=6)
    assert [(c.row_start, c.row_end) for c in packs] == [(1, 2), (3, 3), (4, 4)]
    assert packs[0].table_row_texts == ["A = x y.", "A = z."]
    wide = chunks(spark, [table(["K", "B", "C"], [["k", "one two three", "four five six"], ["k2", "one", "two"]])], size=8)
    assert [(c.table_id, c.column_group) for c in wide][::2] == [("t-columns-1", ["K", "B"]), ("t-columns-2", ["K", "C"])]


def test_introductions_and_captions_appear_once(spark):
    got = chunks(spark, [text("Operating limits", None, ["Electrical system"], "heading"), table(["Voltage"], [["3.6 V"]])])
    assert len(got) == 1 and got[0].source_text.startswith("Electrical system > Operating limits\n")
    got = chunks(spark, [text("prose", 1), text("Cap here", 1), table(["A"], [["1"]], 1, caption="Cap here")])
    assert [c.block_type for c in got] == ["text", "table"] and sum(c.source_text.count("Cap here") for c in got) == 1
    got = chunks(spark, [text("Empty results", kind="heading"), table(["A"], [])])
    assert [(c.block_type, c.source_text) for c in got] == [("text", "Empty results")]
    got = chunks(spark, [text("Head", kind="heading"), text("body", path=["Head"])])
    assert len(got) == 1 and got[0].source_text.count("Head") == 1


def test_pages_merge_within_limits(spark):
    path = ["Sys", "Limits"]
    got = chunks(spark, [text("Limits", 4, ["Sys"], "heading"), text("alpha beta", 4, path), text("gamma delta", 5, path), table(["A"], [["1"]], 5)], least=20)
    assert [(c.block_type, c.page, c.pages) for c in got] == [("text", 4, [4, 5]), ("table", 5, None)]
    got = chunks(spark, [text("a", 4), table(["A"], [["1"]], 4), text("b", 5)])
    assert [c.block_type for c in got] == ["text", "table", "text"]
    got = chunks(spark, [text("a", 1), text("b", 2), text("c", 3)], least=20)
    assert [(c.pages, c.page) for c in got] == [([1, 2], 1), (None, 3)]
    assert [c.page for c in chunks(spark, [text("a", 1), text("b", 2)], least=0)] == [1, 2]
    assert len(chunks(spark, [text("a"), text("b", source="other"), text("c")])) == 3
    for options in ({"least": -1}, {"span": 0}):
        with pytest.raises(ValueError):
            chunks(spark, [text("a")], **options)
    with pytest.raises(ValueError, match="tokens"):
        chunking.build_chunks(corpus.blocks_from(spark, [text("a")]), "tokens")


def test_broken_blocks_are_named(spark):
    cases = [
        (table(["A", "B"], [["1", "2"], ["A8"]]), "table row 2 must have 2 cells"), ({**text("x"), "type": " "}, "non-empty string type"), ({**text("x"), "page": 0}, "positive integer"),
        ({**text("x"), "page": True}, "positive integer"), ({**text("x"), "bbox": [2, 0, 1, 1]}, "reversed"), (table([], []), "headers"), ({**text("x"), "text": None}, "requires string text"), (table(["A"], [["1"]], tid=""), "table_id"),
    ]
    for block, said in cases:
        with pytest.raises(b.BlockError, match=f"Block 1: .*{said}"):
            b.validated(corpus.blocks_from(spark, [text("fine"), block]))


def test_headers_are_made_unique(spark):
    df = spark.createDataFrame([(["A", "a", "", "A (2)", " ", "Straße", "STRASSE"],)], "h array<string>")
    assert df.select(b.unique_headers(df.h).alias("u")).first().u == ["A", "a (2)", "Column 3", "A (2)", "Column 5", "Straße", "STRASSE (2)"]


def test_wide_tables_headers_take_no_square_time(spark):
    values = [("", "B", "b", f"H{i}", "Straße", "STRASSE")[i % 6] for i in range(60_000)]
    seen, want = {}, []
    for i, x in enumerate(values, 1):
        base = x or f"Column {i}"
        seen[base.casefold()] = nth = seen.get(base.casefold(), 0) + 1
        want.append(base if nth == 1 else f"{base} ({nth})")
    df = spark.createDataFrame([(values,)], "h array<string>")
    began = time.perf_counter()
    assert df.select(b.unique_headers(df.h).alias("u")).first().u == want
    rows = b.unique_header_rows(df.select(F.lit("t").alias("t"), F.posexplode("h").alias("i", "h")), ["t"], ["i"], "h")
    assert [r.header for r in rows.orderBy("pos").collect()] == want
    assert time.perf_counter() - began < 60  # by pairs, 1.8 billion comparisons
    none = df.select(b.unique_headers(F.array().cast("array<string>")).alias("empty"), b.unique_headers(F.lit(None).cast("array<string>")).alias("null"), b.unique_headers(F.array(F.lit(None).cast("string"), F.lit("A"))).alias("some")).first()
    assert (none.empty, none.null, none.some) == ([], None, ["Column 1", "A"])


PAGE = """<html><head><svg><title>no</title></svg><title>Example article</title><style>x</style></head><body><nav>skip</nav><main><h3>Deep</h3><h1>Limits</h1><p>First <b>useful</b> paragraph.
<table><caption>Caps</caption><thead><tr><th rowspan=2>Parameter</th><th colspan=2>Limits</th></tr><tr><th>Minimum</th><th>Maximum</th></tr></thead><tr><td>Voltage</td><td>1</td><td>2</td></tr></table>
<ol><li>one<li></li><li>two<ul><li>in</li></ul></ol><div>leaf</div><div><p>x</p></div><script>hidden()</script><table><tr><th>only</th></tr></table></main></body></html>"""


def test_html_pages(spark):
    title, _, found = html.page_blocks(PAGE, "page")
    assert title == "Example article"
    assert [(x["type"], x.get("text")) for x in found[:3]] == [("heading", "Example article"), ("heading", "Deep"), ("heading", "Limits")]
    tab = next(x for x in found if x["type"] == "table")
    assert (tab["headers"], tab["rows"], tab["caption"], tab["table_id"]) == (["Parameter", "Limits > Minimum", "Limits > Maximum"], [["Voltage", "1", "2"]], "Caps", "html-table-1")
    assert not any("skip" in str(x) or "hidden" in str(x) for x in found)
    assert html.page_blocks("<p>a<p>b", "n")[2] == [{"type": "paragraph", "text": "a b", "heading_path": []}, {"type": "paragraph", "text": "b", "heading_path": []}]
    assert len(html.page_blocks("<p>a<p>b", "n", dedupe_nested=True)[2]) == 1
    assert html.page_blocks("plain &amp; text", "n")[2][0]["text"] == "plain & text" and html.page_blocks(None, "n")[2] == []
    pages = spark.createDataFrame([(1, "u", "<h1>Operating limits</h1><table><caption>Operating limits</caption><tr><td>Voltage</td></tr></table>"), (2, "v", None)], "page_id long, url string, html string")
    got = chunking.chunk_blocks(html.html_blocks(pages)).collect()
    assert len(got) == 1 and got[0].source_text.count("Operating limits") == 1
    assert html.page_blocks("<div>" * 5000 + "deep", "n")[2][0]["text"] == "deep"


def test_urls():
    assert urls.parse_url_list("https://a.org/x\n\n https://b.org \nhttps://a.org/x", 2) == ["https://a.org/x", "https://b.org"]
    for bad in ("file:///x", "https://u:p@h/", "", "https://a\nhttps://b\nhttps://c"):
        with pytest.raises(ValueError):
            urls.parse_url_list(bad, 2)
    assert urls.url_request_key(["a", "b"]) == hashlib.sha256(b'["a","b"]').hexdigest()[:16]

    class Answer(io.BytesIO):
        class headers:
            get_content_type = staticmethod(lambda: "text/html")
            get_content_charset = staticmethod(lambda: "nonsense")

        geturl = staticmethod(lambda: "https://example.org/final")

    page = lambda *a, **k: Answer(b"<p>Downloaded text.</p>")
    assert urls.fetch(["https://example.org"], opener=page) == [("https://example.org", "https://example.org/final", "<p>Downloaded text.</p>")]
    with pytest.raises(RuntimeError, match="larger"):
        urls.fetch(["https://example.org"], max_page_bytes=3, opener=page)


def test_corpora_are_saved_and_found_again(spark, tmp_path):
    values = [text("Head", 1, kind="heading"), table(["A"], [["1"]], 1), text("  ", 1), text("Tail", 2)]
    saved = corpus.save_corpus(corpus.blocks_from(spark, values), [{"kind": "html"}], tmp_path, "key")
    assert saved.corpus_path.read_text() == "Head\n\nHead\nA = 1.\n\nTail\n"
    stored = json.loads(saved.blocks_path.read_text())
    assert len(stored) == 3 and corpus.save_corpus(corpus.load_blocks(spark, saved.blocks_path), [], tmp_path, "key").content_key == saved.content_key
    assert corpus.cached(tmp_path, "key") is None
    corpus.save_pointer(tmp_path, saved)
    assert corpus.cached(tmp_path, "key") == saved
    saved.sources_path.unlink()
    assert corpus.cached(tmp_path, "key") is None
    with pytest.raises(ValueError):
        corpus.save_corpus(corpus.blocks_from(spark, [text(" ")]), [], tmp_path, "key")
