import base64
import hashlib
import io
import random

import pytest

from gridloom.llm import chat, packing, substring, warc


def test_archives_give_back_payloads_and_revisits(spark, tmp_path):
    big = "é" * 300_000
    rows = [(1, "http://a/x y", "<p>a</p>", 0), (2, None, "<p>a</p>", 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", big, 0), (6, "u", big, 0), (6, "u", big, 0), (None, "u", big, 0), (8, "u\r\nX: 1", "q" * 1000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chunk int")
    for least in (0, 100):
        folder = f"file://{tmp_path}/{least}"
        names = warc.write_archives(pages, folder, least=least, chunk=65_536)
        chunks = warc.read_archives(spark, names, chunk=10_000).collect()
        by_record = {}
        for r in sorted(chunks, key=lambda r: (r.archive, r.place, r.chunk_no)):
            by_record.setdefault((r.archive, r.place), []).append(r)
        assert len(by_record) == len(rows)
        responses = {}
        for parts in by_record.values():
            assert [r.chunk_no for r in parts] == list(range(len(parts))) and all(len(r.chunk) <= 10_000 for r in parts)
            body = b"".join(r.chunk for r in parts)
            assert parts[-1].last and parts[-1].payload_bytes == len(body)
            if parts[0].record_type == "response":
                assert parts[-1].payload_digest == parts[0].stated_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
                responses.setdefault(body.decode(), []).append(parts[0])
        for text, got in responses.items():
            own = [r for r in rows if (r[2] or "") == text]
            assert len(got) == (1 if len(text.encode()) >= least else len(own))
            if len(got) == 1:
                top = max((r[0] for r in own if r[0] is not None))
                assert got[0].source_id == str(top)
                revisits = [p[0] for p in by_record.values() if p[0].record_type == "revisit" and p[0].stated_digest == got[0].stated_digest]
                assert len(revisits) == len(own) - 1 and {r.refers_to_id for r in revisits} <= {got[0].record_id}
    many = warc.write_archives(pages, f"file://{tmp_path}/rolled", roll=1, chunk=1000)
    assert len(many) == len(rows) and warc.read_archives(spark, many).filter("last").count() == len(rows)
    assert warc.round_trip(pages).count() == len(rows) and warc.round_trip(pages.limit(0)).count() == 0


def test_a_broken_archive_is_an_error():
    import gzip

    good = gzip.compress(warc._head("response", "<urn:x>", "A", "u", 5, "1", None) + b"hello\r\n\r\n")
    assert list(warc.records(io.BytesIO(good), "a"))[0][2] == b"hello"
    for bad in (good[:-30], gzip.compress(b"nonsense\n")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(bad), "a"))


def test_windows_round_trip(spark):
    pick = random.Random(4)
    odd = ["<|im_end|>", "<|", "<\\|", "<\\\\|im_start|>", "a<", "\n", "<|im_start|>user\nhi<|im_end|>\n", "plain words "]
    rows = [(c, i, pick.choice(["user", "assistant", "a\\nb\n", "sys<|"]) if i else "system", "".join(pick.choices(odd, k=pick.randint(0, 40)))) for c in range(20) for i in range(pick.randint(1, 40))]
    rows += [(99, 1, None, None), (99, None, "assistant", "late"), (98, 1, "assistant", "x" * 50_000), (None, 1, "user", "no id")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(talk, budget=100, history=40)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn if turn is not None else 1e9, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for w in made.collect():
        turns = chat.parse(w.text)
        assert len(turns) == len(w.roles) == len(w.repeated)
        assert w.tokens <= 100 or len([x for x in w.repeated if not x]) == 1
        if w.window and by[w.conv_id][0][1] == "system":
            assert w.roles[0] == "system" and w.repeated[0]
    assert chat.digests(chat.windows(talk.limit(0))).count() == 0
    trap = chat.digests(chat.windows(chat.with_trap(talk.limit(0)))).first()
    assert (trap.conv_id, trap.n_turns, trap.loss_chars) == (-1, 2, 34)


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\\\|x", "<<|im_end|>>", "\\<|\\"])
def test_escapes_are_exact(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_best_fit_equals_a_plain_search():
    pick = random.Random(6)
    sizes = [pick.randint(1, 64) for _ in range(500)]
    bin_of, place, used = packing.best_fit(sizes, (16, 32, 64), 0.8)
    rooms, fill = [], []
    for n, b, p in zip(sizes, bin_of, place, strict=True):
        open_ = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if open_:
            assert rooms[b] == min(open_)[0]
        else:
            assert b == len(rooms)
            cap = min((c for c in (16, 32, 64) if c >= n), key=lambda c: (packing.price(c) * (n + 0.2 * (c - n)) / c / n, c))
            rooms.append(cap)
            fill.append(0)
        assert p == fill[b]
        rooms[b] -= n
        fill[b] += n
    assert fill == used


def test_the_cheapest_expectation_is_packed():
    pick = random.Random(7)
    for caps in ((16, 32, 64), (8, 64)):
        sizes = sorted((pick.randint(1, max(caps)) for _ in range(200)), reverse=True)
        costs = []
        for filled in packing.EXPECTED:
            _, _, used = packing.best_fit(sizes, caps, filled)
            costs.append(sum(packing.price(min(c for c in caps if c >= u)) for u in used))
        bin_of, place, down = packing.pack(sizes, caps)
        assert sum(map(packing.price, down)) == min(costs)
        fill = [0] * len(down)
        for n, b, p in zip(sizes, bin_of, place, strict=True):
            assert p == fill[b]
            fill[b] += n
        assert all(f <= c and c == min(x for x in caps if x >= f) for f, c in zip(fill, down, strict=True))


def test_packing_places_each_word_once(spark):
    rows = [(i, "w " * n, 1) for i, n in enumerate([0, 1, 5, 300, 4095, 4096, 9000, 50, 50])] + [(7, "w " * 50, 1), (None, "a b", 1), (20, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = packing.packed(docs, shard_rows=4).collect()
    bins = {}
    for r in got:
        assert (r.bin_id is None) == (r.length == 0)
        if r.length:
            bins.setdefault(r.bin_id, []).append(r)
    assert sum(r.length for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    assert len({r.copy for r in got}) == len(rows)
    for own in bins.values():
        end = 0
        for r in sorted(own, key=lambda r: r.place):
            assert r.place == end
            end += r.length + 1
        assert min(c for c in packing.CAPACITIES if c >= end) == own[0].capacity
    assert packing.packed(docs.limit(0)).count() == 0


def words(pick, n):
    return ["".join(pick.choices("abcdefghij", k=5)) for _ in range(n)]


def test_repeated_passages_are_found_and_clean_texts_left_alone(spark):
    pick = random.Random(8)
    exact, fuzzy = words(pick, 52), words(pick, 150)
    rows = [(i, " ".join(words(pick, pick.randint(0, 90)) + exact + words(pick, 80))) for i in range(12)]
    for i in range(12, 24):
        p = list(fuzzy)
        for _ in range(5):
            p[pick.randrange(150)] = "other"
        rows.append((i, "\n".join(words(pick, 40) + p + words(pick, 40)).upper()))
    rows += [(i, " ".join(words(pick, 300))) for i in range(24, 34)] + [(i, " ".join(words(pick, 60) + exact[:40] + words(pick, 60))) for i in range(34, 40)]
    rows += [(40, ""), (41, None), (None, rows[0][1]), (42, "la " * 400), (43, "la " * 500), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, pos int, seed int")
    got = substring.repeated(docs).collect()
    assert {r.doc_id for r in got if r.doc_id < 12} == set(range(12))
    assert len({r.doc_id for r in got if 12 <= r.doc_id < 24}) >= 11
    assert not {r.doc_id for r in got if r.doc_id >= 24}
    texts = {i: (t or "").lower().split() for i, t in rows if i is not None}
    for r in got:
        a, p = texts[r.doc_id][r.start : r.end], texts[r.partner_id][r.partner_start : r.partner_end]
        assert r.similarity >= 0.8 and max(len(a), len(p)) >= 50 and r.doc_id != r.partner_id
        if r.doc_id < 12:
            assert set(exact) <= set(a) or len(set(exact) & set(a)) > 48
    assert substring.repeated(docs.limit(0)).count() == 0


def test_chains_are_best():
    import itertools

    import numpy as np

    pick = random.Random(9)
    for _ in range(30):
        n = pick.randint(2, 8)
        pos = np.array(sorted(pick.sample(range(60), n)))
        anchor = np.array(pick.sample(range(60), n))
        best = 0.0
        for size in range(1, n + 1):
            for c in itertools.combinations(range(n), size):
                if all(anchor[a] < anchor[b] for a, b in itertools.pairwise(c)):
                    best = max(best, size * 8 - 0.1 * sum(pos[b] - pos[a] + anchor[b] - anchor[a] for a, b in itertools.pairwise(c)))
        paths = substring.chain(pos, anchor)
        assert sorted(np.concatenate(paths).tolist()) == list(range(n))
        score = lambda c: len(c) * 8 - 0.1 * sum(pos[b] - pos[a] + anchor[b] - anchor[a] for a, b in itertools.pairwise(c))
        assert max(score(p) for p in paths) == pytest.approx(best) or (np.diff(anchor) == np.diff(pos)).all()


def test_common_subsequences_and_hashes():
    import numpy as np

    pick = random.Random(10)
    for _ in range(50):
        a, b = ([pick.randint(0, 4) for _ in range(pick.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert substring.lcs(np.array(a, int), np.array(b, int)) == table[-1][-1]
    texts = [b"one Two\tthree", b"", b" two ", b"THREE one"]
    lists = substring._split(texts)
    assert [len(x) for x in lists] == [3, 0, 1, 2]
    assert lists[0][1] == lists[2][0] and lists[0][2] == lists[3][0] == substring.word_hashes(b"three")[0]


def test_hot_payloads_and_hot_rows_of_one_page(spark, tmp_path):
    rows = [(7 if i % 2 else i, "u", "same" if i % 3 else f"own {i}") for i in range(24_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).filter("payload_bytes = 4")
    assert got.count() == 16_000 and got.filter("record_type = 'response'").collect()[0].page_id == 23_998
    assert got.filter("record_type = 'revisit' AND refers_to = 23998").count() == 15_999


def test_digests_grow_by_chunk(spark):
    pages = spark.createDataFrame([(1, "u", "abc" * 1000), (2, "u", None), (3, "u", "é" * 999)], "page_id long, url string, html string")
    chunks = warc.record_chunks(pages, chunk=100)
    assert chunks.selectExpr("max(octet_length(chunk))").first()[0] == 100
    got = {r.page: (r.n, bytes(r.digest)) for r in warc.record_digests(chunks).collect()}
    assert got == {p: (len(b), hashlib.sha1(b).digest()) for p, b in ((1, b"abc" * 1000), (2, b""), (3, "é".encode() * 999))}
