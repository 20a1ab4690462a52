"""Registered queries of the operators that work on pages, brochures and
requests.  The driver's tables hold none of these, so the queries run what
ships over literal fixtures, and the SQL states the rows that they must give.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable
from contextlib import nullcontext
from email.message import Message
from functools import partial
from io import BytesIO
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import api, service
from ..functions import jsonschema
from ..operators import layout as lay
from ..operators import model_year as my
from ..sources import corpus, html, pdf, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ERROR = "error"


def _answer(f: Callable, args: list) -> str:
    try:
        value = f(*args)
    except (ValueError, RuntimeError, service.Refused):
        value = ERROR
    return json.dumps(value, ensure_ascii=False)


def _values(rows: list[tuple]) -> str:
    shown = [", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) for r in rows]
    return ", ".join(f"({r})" for r in shown)


def cases(name: str, f: Callable, expected: list[tuple[list, object]]) -> None:
    """Registers ``name``: (n, result), ``f`` of the n-th arguments as JSON."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_answer(f, json.loads(a)) for a in b.column(1).to_pylist()], pa.string())], names=["n", "result"])

    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = spark.createDataFrame([(i, json.dumps(args)) for i, (args, _) in enumerate(expected)], "n int, args string")
        return rows.mapInArrow(run, "n int, result string")

    QUERIES[name] = query
    ORACLES[name] = f'SELECT n::INTEGER AS n, result FROM (VALUES {_values([(i, json.dumps(want, ensure_ascii=False)) for i, (_, want) in enumerate(expected)])}) t(n, result)'


def _in_folder(f: Callable, *args):
    with tempfile.TemporaryDirectory() as folder:
        return f(Path(folder), *args)


def drawn(spec: str) -> list[lay.Word]:
    """Words of a drawing: text@x0,top,x1,bottom, with bars between; a trailing r is rotated."""
    out = []
    for item in spec.split("|") if spec else ():
        text, at = item.strip().rsplit("@", 1)
        out.append(lay.Word(text, *map(float, at.rstrip("r").split(",")), not at.endswith("r")))
    return out


def grid(xs: list[float], ys: list[float]) -> lay.Table:
    rows = [[(a, t, c, b) for a, c in zip(xs, xs[1:], strict=False)] for t, b in zip(ys, ys[1:], strict=False)]
    return lay.Table((xs[0], ys[0], xs[-1], ys[-1]), rows)


def table(box: list[float], rows: list[list]) -> lay.Table:
    return lay.Table(tuple(box), [[c and tuple(c) for c in row] for row in rows])


def _texts(words) -> list[str]:
    return [w.text for w in words]


# geometry of words ------------------------------------------------------------

cases("word_key", lambda spec: [list(w.key) for w in drawn(spec)], [(["a@0.12345,1,2,3.0006"], [["a", 0.123, 1.0, 2.0, 3.001]]), (["x@1,2,3,4|x@1.0002,2,3,4"], [["x", 1.0, 2.0, 3.0, 4.0]] * 2)])
cases("word_center", lambda spec: [[w.cx, w.cy] for w in drawn(spec)], [(["a@0,10,4,20|b@1,1,2,2"], [[2.0, 15.0], [1.5, 1.5]])])
cases("boxes_overlap", lambda a, c: lay.overlap(a, c), [([[0, 0, 10, 10], [5, 5, 15, 15]], True), ([[0, 0, 10, 10], [10, 0, 20, 10]], False), ([[0, 0, 10, 10], [2, 2, 3, 3]], True), ([[0, 0, 1, 1], [5, 5, 6, 6]], False)])
cases("word_in_region", lambda spec, box: _texts(lay.inside(drawn(spec), tuple(box))), [(["a@0,0,10,10|b@20,20,30,30", [5, 5, 25, 25]], ["a", "b"]), (["a@0,0,10,10|b@20,20,30,30", [6, 5, 25, 25]], ["b"]), (["a@0,0,10,10", [0, 0, 4.9, 10]], [])])
cases("line_groups", lambda spec: [_texts(x) for x in lay.lines_of(drawn(spec))], [(["b@20,1,30,8|a@0,3,10,10|c@0,4.5,10,12"], [["a", "b"], ["c"]]), (["a@0,0,1,1|b@2,3,3,4|c@4,6,5,7"], [["a", "b"], ["c"]])])
cases("line_text", lambda spec: lay.line_text(drawn(spec)), [(["frag@0,0,10,8|ment@10.2,0,20,8"], "fragment"), (["a@0,0,5,8|b@7,0,9,8"], "a b"), (["a@0,0,5,20|b@6.1,0,9,20"], "ab")])
cases(
    "words_text", lambda spec: lay.text_of(drawn(spec)),
    [(["41@0,0,5,8|256@7,0,14,8|010@16,0,22,8|Ft@25,0,30,8"], "41256010 Ft"), (["R21@0,0,10,8|113Y@12,0,20,8|xl@22,0,26,8"], "R21 113Y xl"), (["up@0,40,5,60r|turned@1,10,6,30r"], "up turned"), ([""], "")],
)
cases("grouped_numbers_text", lambda text: lay.text_of([lay.Word(text, 0, 0, 9, 9)]), [(["1 234 567 Ft"], "1234567 Ft"), (["12 3456"], "12 3456"), (["A1 234"], "A1 234"), (["5 000 és 10 000"], "5000 és 10000")])
cases("join_wrapped", lambda lines: lay.join_wrapped(lines), [([["para-", "graph goes", "on."]], "paragraph goes on."), ([["one", "two"]], "one two"), ([[]], "")])
cases("horizontal_groups", lambda spec: [_texts(g) for g in lay.gap_groups(drawn(spec))], [(["a@0,0,10,5|b@28,0,30,5|c@49,0,60,5"], [["a", "b"], ["c"]]), (["a@0,0,50,5|b@10,0,20,5|c@60,0,70,5"], [["a", "b", "c"]])])
cases("coordinates", lambda values: lay.coordinates(values), [([[5, 0, 0.8, 1.2]], [0.8, 5]), ([[1, 1, 1]], [1.0]), ([[]], [])])
cases("line_gutters", lambda spec: lay.gutters(drawn(spec)), [(["a@0,0,10,10|b@16,0,20,10|c@25,0,30,10"], [[10.0, 16.0]]), (["a@0,0,10,20|b@16,0,20,20|c@40,0,50,20"], [[20.0, 40.0]]), (["a@0,0,10,20"], [])])
cases("refine_gutters", lambda now, new: lay.narrow([tuple(x) for x in now], [tuple(x) for x in new]), [([[[10, 20], [40, 50]], [[12, 18], [60, 70]]], [[[12, 18], [40, 50]], 1]), ([[[10, 20]], [[17, 30]]], [[[10, 20]], 0]), ([[[10, 20]], [[14, 30], [5, 18]]], [[[10, 18]], 1])])
cases("fits_one_column", lambda spec, spans: lay.fits_column(drawn(spec), spans), [(["a@0,0,10,8|b@12,0,20,8", [[30, 40]]], True), (["a@0,0,10,8|b@38,0,50,8", [[30, 40]]], False), (["a@30,0,39,8", [[30, 40]]], False)])
cases(
    "text_lines", lambda spec: lay.text_lines(drawn(spec)),
    [
        (["a1@0,0,20,8|b1@60,0,80,8|a2@0,10,20,18|b2@60,10,80,18|a3@0,20,20,28|b3@60,20,80,28"], [[0.0, "a1 a2 a3"], [0.001, "b1 b2 b3"]]),
        (["A@0,0,5,8|complete@7,0,40,8|para-@42,0,60,8|graph@0,9,20,17|goes@22,9,35,17|on.@37,9,50,17|Far@0,60,20,68"], [[0.0, "A complete paragraph goes on."], [60.0, "Far"]]),
        (["p@0,0,8,8|q@30,0,38,8|r@60,0,68,8|s@90,0,98,8|p2@0,10,9,18|q2@30,10,39,18|r2@60,10,69,18|s2@90,10,99,18"], [[0.0, "p p2"], [0.001, "q q2"], [0.002, "r r2"], [0.003, "s s2"]]),
    ],
)
cases("nearest_header_words", lambda spec: _texts(lay.near_block(drawn(spec))), [(["far@0,0,10,5|a@0,20,10,25|b@12,20,20,25|c@0,30,10,35"], ["a", "b", "c"]), (["up@0,0,10,5|low@0,20,10,25"], ["low"])])
cases("left_header_boundaries", lambda spec, band, left: lay.left_boundaries(drawn(spec), band, left), [(["Model@1,1,9,8|Version@30,1,40,8|Price@65,1,75,8", [0, 10], 60], [20.0]), (["Model@1,1,9,8|Price@65,1,75,8", [0, 10], 60], [])])

# image cards -----------------------------------------------------------------------

CARDS = "Available@90,5,135,12|accessories@138,5,205,12|Alpha@35,75,65,82|kit@68,75,82,82|10@45,88,56,95|000@59,88,76,95|Ft@79,88,89,95|Beta@195,75,225,82|rack@228,75,252,82|20@205,88,216,95|000@219,88,236,95|Ft@239,88,249,95|Legal@5,120,30,127"
PICTURES, RULE = [[20, 30, 100, 70], [20.5, 30, 100, 70], [180, 30, 260, 70]], [[0, 20, 300, 21.5]]
FOUND = ["Available accessories", [["Alpha kit", "10000 Ft"], ["Beta rack", "20000 Ft"]]]


def _cards(spec, images, rects):
    return [[c.caption, c.rows] for c in lay.image_cards(drawn(spec), images, rects, 300.0)]


cases("image_cards", _cards, [([CARDS, PICTURES, RULE], [FOUND]), ([CARDS, PICTURES[:1], RULE], []), ([CARDS, PICTURES, []], []), (["", PICTURES, RULE], [])])
cases("card_value", lambda text: lay.looks_like_value(text), [(["10 000 Ft"], True), (["€ 5"], True), (["Alpha 5"], False), (["1 2 3 4 5 6 7"], False), ([""], False), (["$"], False)])


def _page(spec, tables=(), images=(), rects=(), fallback=None):
    """(type, text or caption, rows) of a page's blocks."""
    made = [lay.Table(tuple(t[0]), [[c and tuple(c) for c in row] for row in t[1]], i) for i, t in enumerate(tables, 1)]
    found = lay.page_blocks("d", 1, drawn(spec), made, [tuple(b) for b in images], [tuple(b) for b in rects], 300.0, fallback and (lambda t: fallback))
    return [[b["type"], b.get("text", b.get("caption")), b.get("rows", [])] for b in found]


SMALL = [[0, 400, 80, 420], [[[0, 400, 40, 410], [40, 400, 80, 410]], [[0, 410, 40, 420], [40, 410, 80, 420]]]]
SMALL_WORDS = "K@2,401,8,407|V@42,401,48,407|a@2,411,8,417|1@42,411,48,417"
cases(
    "page_order", _page,
    [
        ([f"{CARDS}|Caption@0,150,20,157|here@22,150,40,157|{SMALL_WORDS}", [SMALL], PICTURES, RULE], [["table", FOUND[0], FOUND[1]], ["paragraph", "Legal", []], ["paragraph", "Caption here", []], ["table", "Caption here", [["a", "1"]]]]),
        (["late@0,90,20,97|early@0,10,20,17"], [["paragraph", "early", []], ["paragraph", "late", []]]),
    ],
)
OVER = [[0, 60, 300, 100], [[[0, 60, 150, 100], [150, 60, 300, 100]]]]
cases("table_suppression", _page, [([CARDS, [OVER], PICTURES, RULE], [["table", FOUND[0], FOUND[1]], ["paragraph", "Legal", []]])])
cases("empty_tables", _page, [(["", [[[0, 0, 100, 100], [[[0, 0, 50, 100], [50, 0, 100, 100]]]]], [], []], []), (["", [], PICTURES, RULE], [])])
cases("outside_text", _page, [([f"before@0,200,20,207|{SMALL_WORDS}|after@0,430,20,437", [SMALL]], [["paragraph", "before", []], ["table", "before", [["a", "1"]]], ["paragraph", "after", []]])])
cases("nearest_caption_of", lambda spec, tables: [b[1] for b in _page(spec, tables) if b[0] == "table"], [([f"far@0,10,20,17|near@0,60,20,67|below@0,450,20,457|{SMALL_WORDS}", [SMALL]], ["near"]), ([SMALL_WORDS, [SMALL]], [""])])
BROKEN = [[0, 400, 80, 420], [[[0, 400, "x", 410]]]]
cases("page_fallback", _page, [(["", [BROKEN], [], [], [["H", "I"], ["a", None], ["", ""]]], [["table", "", [["a", ""]]]]), (["", [BROKEN], [], [], [[None]]], [])])

# tables ------------------------------------------------------------------------------

cases("split_row", lambda cells: lay.split_row([drawn(c) for c in cells]), [([["A1@0,5,5,10", "Name@10,5,20,10", "721360@30,0,40,5|1000760@30,12,40,17"]], [["A1", "Name", "721360"], ["A1", "Name", "1000760"]]), ([["A1@0,5,5,10", "x@10,5,20,10"]], [["A1", "x"]])])
SPLIT = ["A@0,5,5,10", "N@10,5,20,10", "low@22,1,28,6|high@22,13,28,18", "1@30,0,40,5|2@30,12,40,17"]
cases("nearest_price", lambda cells: lay.split_row([drawn(c) for c in cells]), [([SPLIT], [["A", "N", "low", "1"], ["A", "N", "high", "2"]])])
TALL = [[0, 0, 40, 20], [40, 0, 80, 10], [40, 10, 80, 20]]
cases("vertical_span", lambda spec, cells, starts, column, band: _texts(lay.tall_cell(drawn(spec), cells, starts, column, band)), [(["Category@2,6,18,13|A@20,6,24,13", TALL, [0, 10], [0, 40], [0, 10]], ["Category", "A"]), (["Category@2,6,18,13|A@20,6,24,13", TALL, [0, 10], [40, 80], [0, 10]], [])])
WIDE = [[0, 0, 20, 10], [20, 0, 40, 10], [40, 0, 60, 10], [0, 10, 20, 20], [20, 10, 60, 20]]
cases(
    "horizontal_span", lambda spec: _texts(lay.wide_cell(drawn(spec), WIDE, [0, 20, 40, 60], (20, 40), (10, 20))),
    [(["220@32,12,37,18|-@38.5,12,40,18|290@41,12,47,18"], ["220", "-", "290"]), (["100@22,12,27,18|200@52,12,57,18"], []), (["one@22,12,30,18"], [])],
)
CODES = "Previous@2,5,17,11|content@24,5,46,11|price@74,5,90,11|Kód@2,32,14,38|Option@24,32,46,38|Edition@74,32,96,38|First@24,42,38,48|A100@2,50,16,56|100@74,50,84,56|Ft@86,50,92,56|continuation@24,54,58,60|Second@24,63,45,69|B200@2,70,16,76|200@74,70,84,76|Ft@86,70,92,76"
cases(
    "code_rows_below", lambda spec, boxes: [[top, row] for top, row, _ in lay.code_rows(drawn(spec), [0, 20, 70, 100], (0, 20, 100, 40), [tuple(b) for b in boxes])],
    [([CODES, [[0, 20, 100, 40], [0, 80, 100, 90]]], [[50.0, ["A100", "First continuation", "100 Ft"]], [70.0, ["B200", "Second", "200 Ft"]]]), ([CODES, [[0, 20, 100, 40]]], [])],
)
GRID = "Available@2,1,20,7|options@22,1,40,7|Power@0,12,15,18|Torque@40,12,55,18|Weight@80,12,95,18|100@0,20,10,26|200@40,20,50,26|300@80,20,90,26|Length@0,30,15,36|Width@40,30,55,36|4 m@0,38,9,44|2 m@40,38,49,44"
GRID_TABLE = [[0, 0, 120, 46], [[[0, 0, 120, 10]], [[x, 10, x + 30, 46] for x in (0, 30, 60, 90)]]]
PAIRS = [["Power", "100"], ["Torque", "200"], ["Weight", "300"], ["Length", "4 m"], ["Width", "2 m"]]


def _rebuilt(spec, at, boxes=()):
    f = lay.reconstruct(table(*at), drawn(spec), [tuple(b) for b in boxes])
    return [f.headers, f.rows, f.sections]


def _ruled(xs, ys):
    t = grid(xs, ys)
    return [list(t.bbox), [[list(c) for c in row] for row in t.rows]]


cases("label_value_grid", _rebuilt, [([GRID, GRID_TABLE], [["Label", "Value"], PAIRS, [[0, "Available options"]]])])
PROSE = "|".join(f"prose{n}{c}{s}@{100 * c + x},{top},{100 * c + y},{top + 7}" for n, top in enumerate((60, 70, 80)) for c in range(4) for s, x, y in (("a", 5, 40), ("b", 43, 80)))
PRICES = "|".join(f"{t}@{x},{y},{x + 40},{y + 7}" for y, row in ((105, "Prices Basic Duo Premium"), (125, "Device 100 200 300")) for x, t in zip((5, 105, 205, 305), row.split(), strict=True))
LEAD = [[0, 0, 30, 10], None, [35, 0, 65, 10], None, [70, 0, 100, 10]]
EDGE = [[10, 10, 30, 30], [[None, [10, 10, 20, 20], [20, 10, 30, 20]], [[10, 20, 30, 30], None, None]]]
EDGE_WORDS = "Model@1,1,9,8|Code@11,1,19,8|Price@21,1,29,8|A8 55 TFSI@1,12,9,18|4NC0DA24@11,12,19,18|41 256 010@21,12,29,18|Hybrid@1,22,9,28"
BESIDE = "Other-table@1,12,40,18|Name@51,1,70,8|Price@76,1,95,8|Wheel@51,12,70,18|100@76,12,95,18"
BESIDE_TABLE = [[50, 10, 100, 20], [[None, [75, 10, 100, 20]]]]
BETWEEN = "Neighbor@1,12,35,18|Description@45,1,67,8|A@72,1,80,8|B@87,1,95,8|First item@45,12,67,18|yes@72,12,80,18|no@87,12,95,18|Second item@45,22,67,28|no@72,22,80,28|yes@87,22,95,28"
cases(
    "rebuilt_tables", _rebuilt,
    [
        (["Motor@2,1,15,8|YOU@27,1,38,8|PLUS@51,1,64,8|MAX@75,1,87,8|Petrol@2,11,16,18|100@27,11,38,18|200@51,11,62,18|300@75,11,86,18", _ruled([0, 20, 24, 44, 48, 68, 72, 92], [0, 10, 20])], [["Motor", "YOU", "PLUS", "MAX"], [["Petrol", "100", "200", "300"]], []]),
        ([CODES, _ruled([0, 20, 70, 100], [20, 30, 40]), [[0, 20, 100, 40], [0, 80, 100, 90]]], [["Kód", "Option", "Edition"], [["A100", "First continuation", "100 Ft"], ["B200", "Second", "200 Ft"]], []]),
        (["YOU@3,1,15,8|PLUS@40,1,55,8|MAX@75,1,88,8|You-1@3,12,15,18|Plus-1@40,12,54,18|Max-1@75,12,88,18|You-2@3,22,15,28|Plus-2@40,22,54,28|Max-2@75,22,88,28", [[0, 0, 100, 40], [LEAD, [[0, 10, 100, 40], None, None, None, None]]]], [["YOU", "PLUS", "MAX"], [["You-1 You-2", "Plus-1 Plus-2", "Max-1 Max-2"]], []]),
        ([EDGE_WORDS, EDGE], [["Model", "Code", "Price"], [["A8 55 TFSI", "4NC0DA24", "41256010"]], [[20, "Hybrid"]]]),
        (["Model@1,1,9,8|Version@30,1,40,8|Price@65,1,75,8|Astra@1,11,9,18|GS@30,11,40,18|100@65,11,75,18", [[60, 0, 90, 20], [[[60, 0, 80, 10]], [[60, 10, 80, 20]]]]], [["Model", "Version", "Price"], [["Astra", "GS", "100"]], []]),
        ([BESIDE, BESIDE_TABLE, [[0, 10, 45, 20], [50, 10, 100, 20]]], [["Name", "Price"], [["Wheel", "100"]], []]),
        ([BETWEEN, _ruled([70, 85, 100], [10, 20, 30]), [[0, 10, 40, 30], [70, 10, 100, 30]]], [["Description", "A", "B"], [["First item", "yes", "no"], ["Second item", "no", "yes"]], []]),
        ([f"{PROSE}|{PRICES}", _ruled([0, 100, 200, 300, 400], [100, 120, 140])], [["Prices", "Basic", "Duo", "Premium"], [["Device", "100", "200", "300"]], []]),
    ],
)
cases(
    "consumed_words", lambda spec, at, boxes: sorted({k[0] for k in lay.reconstruct(table(*at), drawn(spec), [tuple(b) for b in boxes]).used}),
    [([BESIDE, BESIDE_TABLE, [[0, 10, 45, 20], [50, 10, 100, 20]]], ["100", "Name", "Price", "Wheel"]), ([f"{PROSE}|{PRICES}", _ruled([0, 100, 200, 300, 400], [100, 120, 140]), []], sorted("Prices Basic Duo Premium Device 100 200 300".split())), ([EDGE_WORDS, EDGE, []], sorted(["Model", "Code", "Price", "A8 55 TFSI", "4NC0DA24", "41 256 010", "Hybrid"]))],
)
cases("plain_tables", lambda raw: lay.plain_table(raw), [([[["", None], ["A", "B"], ["1"]]], [["A", "B"], [["1", ""]]]), ([[["x"]]], [["Column 1"], [["x"]]]), ([[]], [[], []])])

# brochures ----------------------------------------------------------------------------

TRIMS = ["Edition", "GS", "Ultimate"]
S, N = {"status": "STANDARD", "priceGross": 0.0}, {"status": "NOT_AVAILABLE", "priceGross": 0.0}


def O(price: float) -> dict:  # noqa: E743, N802
    return {"status": "OPTION", "priceGross": price}


cases("fold_text", lambda x: my.fold(x), [(["Dízel — Plug-in  HYBRID"], "dizel plug in hybrid"), (["Ű és ő 12"], "u es o 12"), ([None], ""), (["ﬁ x"], "fi x")])
cases("number_of", lambda x: my.number(x), [(["220000 Ft"], 220000.0), (["-1,5 x"], -1.5), (["nincs"], ERROR), ([None], ERROR)])
cases("status_of_cell", lambda x: my.cell_status(x), [(["• alap"], S), (["●"], S), ([" · "], S), (["—"], N), (["–"], N), ([" - "], N), (["*"], N), ([""], N), (["Nem elérhető"], N), (["220000 Ft"], O(220000.0)), (["nincs"], ERROR)])
cases("code_of_version", lambda name, other: my.version_code(name, other), [(["GS Dízel 1.5", "X"], "GS_DIZEL_1_5"), (["…", "VERSION_3"], "VERSION_3")])
V = lambda **data: {"versionData": data}
cases(
    "codes_of_versions", lambda versions, given=None: my.version_codes(versions, given),
    [([[V(marketingName="A b"), V(versionCode="a-b"), V()]], ["A_B", "A_B_2", "VERSION_3"]), ([[V(), V()], ["x", "X"]], ["X", "X_2"]), ([[V()], ["a", "b"]], ERROR), ([[V()], [" "]], ERROR)],
)
cases("kind_of_engine", lambda x: my.engine_kind(x), [(["1.6 Plug-in Hybrid"], "PHEV"), (["1.5 DÍZEL"], "DIESEL"), (["1.2 Turbo Hybrid"], "HYBRID"), ([""], "HYBRID")])
cases("compact_code", lambda *x: my.compact_code(*x), [(["gs", "1.5 Dízel (96 kW / 130 LE)", "8-fokozatú automata"], "GS_DIESEL_130_AT8"), (["Edition", "Hybrid 145 LE", "6 fokozat"], "EDITION_HYBRID_145_AT6"), (["gs", "Dízel", "8-fokozatú"], ERROR)])
cases("trim_of", lambda x: my.split_trim(x, TRIMS), [(["GS  Turbo dízel"], ["GS", "Turbo dízel"]), (["gs"], ["GS", ""]), (["GSX y"], ["", "GSX y"]), ([""], ["", ""])])
ROW = ["C1", "", "", "220000 Ft", "-", "•"]
cases("row_applies", lambda row, engine: my.applies(row, engine), [([["x", "Plug-in hybrid esetén", ""], "1.6 Plug-in Hybrid"], True), ([["x", "Plug-in hybrid esetén", ""], "1.2 Hybrid"], False), ([["x", "Hybrid 48V", "modellek"], "Plug-in"], False), ([["x", "Hybrid 48V", ""], "1.2 Hybrid"], True), ([["x", "", ""], "Plug-in"], True)])
cases("statuses_of_row", lambda row, versions: my.row_statuses(row, versions, TRIMS), [([ROW, [V(trimLabel=t, engineLabel="Hybrid") for t in TRIMS]], [O(220000.0), N, S]), ([["C1", "Plug-in hybrid", "", "•", "•", "•"], [V(trimLabel="GS", engineLabel="Hybrid"), V(trimLabel="GS", engineLabel="Plug-in")]], [N, S]), ([ROW[:5], [V(trimLabel="GS", engineLabel="")]], ERROR)])
cases("merged_statuses", lambda rows, width: my.merge(rows, width), [([[[N, O(1.0)], [S, O(2.0)]], 2], [S, O(1.0)]), ([[], 2], [N, N])])
cases("pattern_statuses", lambda x: my.pattern_statuses(x), [(["SNSNSNSNS"], [S, N, S, N, S, N, S, N, S]), (["SN"], ERROR), (["SNSNSNSNX"], ERROR)])
cases("option_of", lambda *x: my.option(*x), [(["a", "OPTION", [S]], {"marketingName": "a", "type": "OPTION", "versionStatus": [S]}), (["a", "COLOR", [N], "C1", "d"], {"marketingName": "a", "type": "COLOR", "versionStatus": [N], "optionCode": "C1", "description": "d"})])
cases("accessory_of", lambda *x: my.accessory(*x), [(["Thule tartozékok", "Freeride 532  tető", "45 000"], ["THULE Freeride 532", "tető", 45000.0]), (["x", "pedálborítás", "1 000 / 2 000"], ["Rozsdamentes acél pedálborítás", "2 pedál (automata)", 2000.0]), (["x", " a  b ", "5 Ft"], ["a b", "", 5.0]), (["x", "a", "-"], ERROR)])
cases("name_of_model", lambda *x: my.model_name(*x), [(["astra1.pdf", "MY26b x"], "Astra MY26B"), (["corsa.pdf", ""], "corsa"), (["a.pdf", "", " Own "], "Own"), (["a.pdf", "", " "], ERROR)])
cases("valid_from_of", lambda *x: my.valid_from(*x), [(["2026. június 1-től"], "2026-06-01T00:00:00+02:00"), (["2026 január 5"], "2026-01-05T00:00:00+01:00"), (["x"], ERROR), (["", "2026-01-01T00:00:00Z"], "2026-01-01T00:00:00Z"), (["", "2026-01-01"], ERROR)])
cases("ids_removed", lambda x: my._without_ids(x), [([{"id": 1, "a": [{"id": 2, "b": {"id": 3}}]}], {"a": [{"b": {}}]})])
cases("ids_found", lambda x: list(my._id_paths(x, "m")), [([{"id": 1, "a": [{}, {"id": 2}]}], ["m", "m.a[1]"]), ([{"a": 1}], [])])
cases("objects_and_arrays", lambda x, kind: my._get(x, {"object": dict, "array": list}[kind], "p"), [([{"a": 1}, "object"], {"a": 1}), ([[], "object"], ERROR), ([[1], "array"], [1]), ([None, "array"], ERROR)])
DRAFT = {"id": 7, "name": "X", "versions": [{"id": 1, **V(marketingName="Edition Hybrid")}, V(marketingName="GS Dízel", versionCode=" gs diesel ")], "options": [{"marketingName": "a", "type": "OPTION", "versionStatus": [{"id": 3, **S}, N]}]}
LINKED = {"name": "X", "versions": [V(marketingName="Edition Hybrid", versionCode="EDITION_HYBRID"), V(marketingName="GS Dízel", versionCode="GS_DIESEL")], "options": [{"marketingName": "a", "type": "OPTION", "versionStatus": [S, N]}]}
cases("linked", lambda *x: my.link(*x), [([DRAFT], LINKED), ([{**DRAFT, "versions": []}], ERROR), ([{**DRAFT, "options": [{"versionStatus": [{}]}]}], ERROR), ([[]], ERROR), ([DRAFT, ["A"]], ERROR)])


def _valid(x):
    my.validate_links(x)
    return True


cases("links_valid", _valid, [([LINKED], True), ([DRAFT], ERROR), ([{**LINKED, "versions": [V(versionCode="A")] * 2}], ERROR), ([{**LINKED, "versions": [V(), V(versionCode="A")]}], ERROR)])


def brochure() -> list[dict]:
    heads = ["Felszereltség", "Motor", "Váltómű", "Listaár", "Kedvezmény", "Nyár kedvezmény", "Kedvezményes ár"]
    price = {"Edition": "9990000", "GS": "10990000", "Ultimate": "12190000"}
    kinds = (("Hybrid", "(107 kW/145 LE)", "6-fokozatú automata"), ("Turbo", "dízel (96 kW / 130 LE)", "8-fokozatú automata"))
    first = [[f"{trim} {lead}", motor, gear, "1", "2", "3", p] for trim, p in price.items() for lead, motor, gear in kinds]
    second = [[f"{trim} Plug-in", "hybrid (144 kW / 195 LE)", "7-fokozatú automata", "1", "2", "3", p] for trim, p in price.items()]
    common = {"source_name": "astra1.pdf", "source_url": "", "heading_path": []}
    made = lambda page, caption, h, rows: {"type": "table", "table_id": f"t{page}", "page": page, "caption": caption, "headers": h, "rows": rows, **common}
    text = lambda page, x: {"type": "paragraph", "page": page, "text": x, **common}
    return [
        made(3, "Listaárak és kedvezményes árak", heads, first), made(4, "Listaárak és kedvezményes árak", heads, second), text(5, "Standard felszereltség Edition GS Ultimate"),
        made(6, "Infotainment", ["Kód", "Név", "Leírás", *TRIMS], [["DZJG9", "Navi", "csak", "220000 Ft", "-", "•"], ["DLZ02", "töltő", "Plug-in hybrid esetén", "1 Ft", "2 Ft", "3 Ft"]]),
        made(8, "Thule tartozékok", ["Név", "Ár"], [["Freeride 532  tető", "45 000"]]), text(12, "Érvényes: 2026. június 1-től MY26B"),
    ]


CODES_9 = [f"{t}_{k}" for t in ("EDITION", "GS", "ULTIMATE") for k in ("HYBRID_145_AT6", "DIESEL_130_AT8")] + [f"{t}_PHEV_195_AT7" for t in ("EDITION", "GS", "ULTIMATE")]


def _built(source=None, profile="auto", drop=(), name=None):
    doc = my.build([b for i, b in enumerate(brochure()) if i not in drop], source, profile, name)
    by = {o["marketingName"]: "".join(s["status"][0] for s in o["versionStatus"]) for o in doc["options"]}
    picked = ("Multimedia Navi infotainment csomag", "7,4 kW teljesítményű, egyfázisú fedélzeti töltőegység", "IntelliDrive 1.0", "STILO autótöltő", "THULE Freeride 532")
    return [doc["name"], doc["validFrom"], [v["versionData"]["versionCode"] for v in doc["versions"]], [by[p] for p in picked]]


NINE = ["Astra MY26B", "2026-06-01T00:00:00+02:00", CODES_9, ["OONNSSONS", "NNNNNNOOO", "NNNNSSNNS", "NNNNNNOOO", "OOOOOOOOO"]]
cases("brochure_document", _built, [([], NINE), (["x.pdf", "auto", [], "Other"], ["Other", *NINE[1:]])])
cases("brochure_profiles", lambda *x: _built(*x)[0], [([None, "opel-astra-my26"], "Astra MY26B"), ([None, "other"], ERROR), ([None, "auto", [0]], ERROR), ([None, "opel-astra-my26", [0, 1]], ERROR)])


def _versions(rows):
    from dataclasses import replace

    from ..operators.profiles import PROFILES

    p = replace(next(iter(PROFILES)), versions=len([r for r in rows if r[1]]))
    found = my.versions_of([{"type": "table", "headers": brochure()[0]["headers"], "rows": rows}], "Astra", p)
    return [[v["versionData"]["trimLabel"], v["versionData"]["versionCode"], v["versionData"]["priceGross"]] for v in found]


AFTER = [["Turbo", "dízel (130 LE)", "6-fokozatú automata 8-fokozatú automata", "1", "2", "3", "5000"], ["GS", "", "", "", "", "", ""], ["Edition Hybrid", "145 LE", "6-fokozatú automata", "1", "2", "3", "7000"]]
cases("versions_of_tables", _versions, [([AFTER], [["GS", "GS_DIESEL_130_AT8", 5000.0], ["Edition", "EDITION_HYBRID_145_AT6", 7000.0]]), ([[AFTER[0]]], ERROR)])



def _linked_file(folder, draft, schema=None, codes=None):
    source, target = folder / "draft.json", folder / "out" / "linked.json"
    source.write_text(json.dumps(draft), encoding="utf-8")
    if schema:
        (folder / "schema.json").write_text(json.dumps(schema), encoding="utf-8")
    returned = my.link_file(source, target, schema and folder / "schema.json", codes)
    found = json.loads(target.read_text(encoding="utf-8"))
    return found if found == returned else None


NAMED = {"type": "object", "required": ["name"], "properties": {"versions": {"type": "array"}}}
cases("linked_files", partial(_in_folder, _linked_file), [([DRAFT], LINKED), ([DRAFT, NAMED], LINKED), ([DRAFT, {"required": ["other"]}], ERROR), ([DRAFT, None, ["a b"]], ERROR), ([{"versions": []}], ERROR)])


def _built_file(folder, name=None, schema=None):
    source, target = folder / "blocks.json", folder / "built.json"
    source.write_text(json.dumps(brochure()), encoding="utf-8")
    if schema:
        (folder / "schema.json").write_text(json.dumps(schema), encoding="utf-8")
    my.build_file(source, target, schema and folder / "schema.json", name=name)
    found = json.loads(target.read_text(encoding="utf-8"))
    return [found["name"], len(found["versions"])]


cases("built_files", partial(_in_folder, _built_file), [([], ["Astra MY26B", 9]), (["Other", NAMED], ["Other", 9]), ([None, {"required": ["other"]}], ERROR)])



def _coded(rows, merge=False, marker="", code="c1"):
    from ..operators.profiles import PROFILES

    versions = [V(trimLabel=t, engineLabel="Hybrid") for t in TRIMS]
    found = my.spec_option(my.Spec("a", code=code, merge=merge, marker=marker), [{"type": "paragraph", "text": "C1"}, {"type": "table", "rows": rows}], versions, PROFILES[0])
    return found and found["versionStatus"]


TWICE = [["C1", "", "", "•", "-", "-"], ["C2", "", "", "•", "•", "•"], ["c1 ", "", "AT", "5 Ft", "7 Ft", "-"]]
cases("options_of_codes", _coded, [([TWICE], [S, N, N]), ([TWICE, True], [S, O(7.0), N]), ([TWICE, False, "at"], [O(5.0), O(7.0), N]), ([TWICE, False, "", "C9"], None)])

# JSON Schema ----------------------------------------------------------------------------

SCHEMA = {
    "type": "object", "required": ["name", "at"], "additionalProperties": False,
    "properties": {"name": {"$ref": "#/$defs/a~1b"}, "at": {"type": "string", "format": "date-time"}, "n": {"anyOf": [{"type": "null"}, {"type": "integer"}]}, "xs": {"type": "array", "items": {"enum": [1, 2]}}},
    "$defs": {"a/b": {"type": ["string", "null"]}},
}
GOOD = {"name": "x", "at": "2026-06-01T00:00:00Z", "n": None, "xs": [1, 2]}
cases(
    "schema_errors", lambda value, schema: [e.split(":")[0] for e in jsonschema.errors(value, schema, schema)],
    [([GOOD, SCHEMA], []), ([GOOD | {"name": 1}, SCHEMA], ["$.name"]), ([GOOD | {"at": "2026-06-01"}, SCHEMA], ["$.at"]), ([GOOD | {"n": True}, SCHEMA], ["$.n"]), ([GOOD | {"xs": [1, 3, 4]}, SCHEMA], ["$.xs[1]", "$.xs[2]"]), ([GOOD | {"more": 1}, SCHEMA], ["$"]), ([{}, SCHEMA], ["$", "$"]), ([1, {"$ref": "x"}], ERROR), ([float(1), {"type": "integer"}], ["$"])],
)


def _preview(n):
    try:
        jsonschema.validate([3] * n, {"items": {"enum": [1]}})
    except jsonschema.SchemaError as e:
        return len(str(e).splitlines())
    return 0


cases("schema_preview", _preview, [([0], 0), ([20], 20), ([50], 21)])

# sources -----------------------------------------------------------------------------------

cases("url_lists", lambda text, most: urls.parse_url_list(text, most), [(["https://a.org\n\n https://b.org/x \nhttps://a.org", 20], ["https://a.org", "https://b.org/x"]), (["file:///x", 20], ERROR), (["https://u:p@a.org", 20], ERROR), (["", 20], ERROR), (["https://a.org\nhttps://b.org", 1], ERROR)])


def _fetched(final, kind, size, most=100, charset=None):
    def opener(request, timeout):
        head = Message()
        head["Content-Type"] = kind + (f"; charset={charset}" if charset else "")
        body = ("é" * size).encode("latin-1" if charset == "latin-1" else "utf-8")
        return nullcontext(SimpleNamespace(geturl=lambda: final, headers=head, read=lambda n: body[:n]))

    return urls.fetch(["https://a.org"], 1.0, most, opener=opener)


cases("fetched_pages", _fetched, [(["https://a.org/end", "text/html", 2], [["https://a.org", "https://a.org/end", "éé"]]), (["https://a.org", "text/html", 2, 100, "latin-1"], [["https://a.org", "https://a.org", "éé"]]), (["https://a.org", "text/html", 2, 100, "unknown"], [["https://a.org", "https://a.org", "éé"]]), (["https://a.org", "application/json", 2], ERROR), (["file:///x", "text/html", 2], ERROR), (["https://a.org", "text/html", 60, 100], ERROR)])


def _pdf_paths(folder, names, options):
    for name, body in (("a.pdf", b"%PDF-1.7 same"), ("b.PDF", b"%PDF-1.7 same"), ("c.pdf", b"not one"), ("d.txt", b"%PDF-")):
        (folder / name).write_bytes(body)
    return [p.name for p in pdf.pdf_paths([str(folder / n) for n in names], **options)]


cases("pdf_path_lists", partial(_in_folder, _pdf_paths), [([["a.pdf", "b.PDF", "a.pdf"], {}], ["a.pdf", "b.PDF"]), ([["c.pdf"], {}], ERROR), ([["d.txt"], {}], ERROR), ([["x.pdf"], {}], ERROR), ([[], {}], ERROR), ([["a.pdf", "b.PDF"], {"max_files": 1}], ERROR), ([["a.pdf"], {"max_file_bytes": 3}], ERROR)])


def _pdf_keys(folder, left, right):
    def key(bodies):
        paths = []
        for i, body in enumerate(bodies):
            paths.append(folder / f"{len(os.listdir(folder))}-{i}.pdf")
            paths[-1].write_bytes(body.encode())
        return pdf.pdf_request_key(paths)

    return key(left) == key(right)


cases("pdf_keys", partial(_in_folder, _pdf_keys), [([["a"], ["a"]], True), ([["a", "b"], ["b", "a"]], False), ([["ab"], ["a", "b"]], False), ([["a"], ["b"]], False)])


def _pointer(folder, broken):
    saved = corpus.SavedCorpus(folder / "f" / "corpus.txt", folder / "f" / "blocks.json", folder / "f" / "sources.json", "key", "content", 2)
    for p in (saved.corpus_path, saved.blocks_path, saved.sources_path):
        corpus.write_atomically(p, "x")
    corpus.save_pointer(folder, saved)
    if broken == "file":
        saved.blocks_path.unlink()
    elif broken:
        corpus.pointer_path(folder, "key").write_text(broken)
    found = corpus.cached(folder, "key")
    return found and [found == saved, corpus.cached(folder, "other") is None]


cases("cached_corpora", partial(_in_folder, _pointer), [([""], [True, True]), (["file"], None), (["{"], None), (["[]"], None), (["{}"], None)])


class _FakePage:
    images, rects, width = (), (), 300.0

    def __init__(self, spec: str, tables: list):
        self.spec, self.tables = spec, tables

    def dedupe_chars(self):
        return self

    def find_tables(self):
        return [SimpleNamespace(bbox=tuple(box), rows=[SimpleNamespace(cells=[c and tuple(c) for c in row]) for row in rows], extract=lambda: []) for box, rows in self.tables]

    def extract_words(self, **_):
        return [{"text": w.text, "x0": w.x0, "top": w.top, "x1": w.x1, "bottom": w.bottom, "upright": w.upright} for w in drawn(self.spec)]


class FakeDocument:
    """What the layout reader gives for a file, by pages of drawings."""

    def __init__(self, pages: list):
        self.pages = [_FakePage(*p) for p in pages]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def _pdf_blocks(folder, pages):
    path = folder / "x.pdf"
    path.write_bytes(b"%PDF-")
    blocks, source = pdf.file_blocks(path, open_file=lambda _: FakeDocument(pages))
    return [[[b["type"], b["page"], b.get("text", b.get("caption"))] for b in blocks], source["pages"]]


cases("pdf_blocks", partial(_in_folder, _pdf_blocks), [([[[f"Title@0,10,20,17|{SMALL_WORDS}", [SMALL]], ["second@0,10,20,17", []]]], [[["paragraph", 1, "Title"], ["table", 1, "Title"], ["paragraph", 2, "second"]], 2]), ([[["", []]]], ERROR), ([[["", [[[0, 0, 100, 100], [[[0, 0, 50, 100]]]]]]]], ERROR)])
cases("source_kinds", lambda given, kind: api.kind_of(given, kind), [([["https://a.org", "http://b.org"], "auto"], "html"), ([["a.PDF"], "auto"], "pdf"), ([["https://a.org/x.pdf"], "auto"], "html"), ([["https://a.org", "x.pdf"], "auto"], ERROR), ([["x.txt"], "auto"], ERROR), ([["x.txt"], "pdf"], "pdf"), ([["x"], "other"], ERROR), ([[], "auto"], ERROR)])

# service -------------------------------------------------------------------------------------


def _environment(name, value, default):
    had = os.environ.pop("GRIDLOOM_FIXTURE", None)
    try:
        if value is not None:
            os.environ["GRIDLOOM_FIXTURE"] = value
        return {"positive": service.positive, "flag": service.flag}[name]("GRIDLOOM_FIXTURE", default)
    finally:
        os.environ.pop("GRIDLOOM_FIXTURE", None)
        if had is not None:
            os.environ["GRIDLOOM_FIXTURE"] = had


cases("service_settings", _environment, [(["positive", None, 5], 5), (["positive", "7", 5], 7), (["positive", "0", 5], ERROR), (["positive", "x", 5], ERROR), (["flag", None, False], False), (["flag", " Yes ", False], True), (["flag", "0", True], False)])
cases("build_information", lambda *x: service.build_info(*x), [(["ABCDEF0123", "2026-06-01T02:00:00+02:00"], {"commit": "abcdef0", "commitTime": "2026-06-01T00:00:00Z"}), (["unknown", "unknown"], {"commit": "unknown", "commitTime": "unknown"}), (["xyz", "unknown"], ERROR), (["abcdef0", "2026-06-01T02:00:00"], ERROR)])
FORM = "--b\r\nContent-Disposition: form-data; name=\"files\"; filename=\"a.pdf\"\r\n\r\n%PDF-x\r\n--b\r\nContent-Disposition: form-data; name=\"urls\"\r\n\r\nhttps://a.org\r\n--b--\r\n"


def _parts(folder, kind, body, piece=1 << 20, most=100):
    limits = SimpleNamespace(files=1, file_bytes=most)
    held, service.PIECE = service.PIECE, piece
    try:
        value, files, found = service.parts(kind, BytesIO(body.encode()), len(body.encode()), folder, limits)
    finally:
        service.PIECE = held
    return [value, [[n, p.read_bytes().decode()] for n, p in files], found]


FILE = [{}, [["a.pdf", "%PDF-x"]], ["https://a.org"]]
MULTI = 'multipart/form-data; boundary="b"'
cases(
    "request_parts", partial(_in_folder, _parts),
    [
        (["application/json", '{"a": 1}'], [{"a": 1}, [], []]), (["application/json", "["], ERROR), (["application/json", "[]"], ERROR), (["application/x-www-form-urlencoded", "urls=https%3A%2F%2Fa.org&x=1"], [{}, [], ["https://a.org"]]),
        ([MULTI, FORM], FILE), ([MULTI, FORM, 1], FILE), ([MULTI, FORM, 7], FILE), ([MULTI, FORM[:-6]], ERROR), ([MULTI, FORM, 7, 3], ERROR), (["multipart/form-data", FORM], ERROR), (["text/plain", "x"], ERROR),
    ],
)


def _artifacts(folder):
    saved = corpus.SavedCorpus(folder / "c" / "corpus.txt", folder / "c" / "blocks.json", folder / "c" / "sources.json", "request", "content", 1)
    for path, value in ((saved.corpus_path, "Text\n"), (saved.blocks_path, '[{"type": "paragraph"}]'), (saved.sources_path, '[{"kind": "pdf"}]')):
        corpus.write_atomically(path, value)
    return service.artifacts(saved)


cases("extract_answers", partial(_in_folder, _artifacts), [([], {"corpus_id": "c", "request_key": "request", "content_key": "content", "source_count": 1, "blocks": [{"type": "paragraph"}], "corpus_text": "Text\n", "sources": [{"kind": "pdf"}]})])
PLAIN = {"strategy": "words", "chunk_size": 450, "chunk_overlap": 60, "min_text_chunk_size": 100, "max_text_page_span": 2}
cases("chunk_requests", lambda body: service.chunk_options(body), [([{"blocks": []}], PLAIN), ([{"blocks": [], "chunk_size": 3, "chunk_overlap": 1}], PLAIN | {"chunk_size": 3, "chunk_overlap": 1}), ([{}], ERROR), ([{"blocks": [], "chunk_overlap": 450}], ERROR), ([{"blocks": [], "chunk_size": 0}], ERROR), ([{"blocks": [], "chunk_size": "3"}], ERROR), ([{"blocks": [], "min_text_chunk_size": -1}], ERROR), ([{"blocks": [], "max_text_page_span": 0}], ERROR), ([{"blocks": [], "chunk_size": True}], ERROR)])


def _extract_request(files, found):
    with tempfile.TemporaryDirectory() as folder:
        paths = []
        for i, (name, size) in enumerate(files):
            paths.append((name, Path(folder, str(i))))
            paths[-1][1].write_bytes(b"x" * size)
        limits = SimpleNamespace(files=2, file_bytes=9, urls=1, allow_urls=False)
        try:
            service.extract(None, limits, paths, found)
        except service.Refused as e:
            return e.status


cases("refused_extracts", _extract_request, [([[], []], 422), ([[["a.pdf", 1]], ["https://a.org"]], 422), ([[["a.txt", 1]], []], 422), ([[["a.pdf", 10]], []], 413), ([[["a.pdf", 1]] * 3, []], 413), ([[], ["https://a.org"]], 403), ([[], ["https://a.org"] * 2], 413)])
OPEN = {"type": "object", "required": ["missing"]}


def _model_year_request(body):
    return service.handle(None, service.Limits(), "/v1/model-year-options", {"blocks": brochure(), **body})["name"]


cases("model_year_requests", _model_year_request, [([{}], "Astra MY26B"), ([{"schema": {"type": "object", "required": ["name"]}}], "Astra MY26B"), ([{"schema": OPEN}], ERROR), ([{"profile": "other"}], ERROR), ([{"blocks": []}], ERROR), ([{"blocks": None}], ERROR)])



def _command(folder, draft, *options):
    from .. import __main__ as command

    source = folder / "draft.json"
    if draft is not None:
        source.write_text(json.dumps(draft), encoding="utf-8")
    code = command.main(["link", str(source), str(folder / "linked.json"), *options])
    return [code, json.loads((folder / "linked.json").read_text(encoding="utf-8")) if code == 0 else None]


cases("command_line", partial(_in_folder, _command), [([DRAFT], [0, LINKED]), ([None], [1, None]), ([{"versions": []}], [1, None]), ([DRAFT, "--codes", "a"], [1, None])])

# HTML -------------------------------------------------------------------------------------------

TABLE_PAGE = (
    "<title>Specs</title><style>p{}</style><body><nav>menu</nav><main><h1>Pump sizes</h1><table><caption>Flow by speed</caption><thead><tr><th rowspan='2'>Pump</th><th colspan='2'>Litres</th></tr><tr><th>slow</th><th>fast</th></tr></thead>"
    + "".join("<tr>" + "".join(f"<td{extra}>{x}</td>" for x, extra in row) + "</tr>" for row in ((("P1", ""), ("4", ""), ("9", "")), (("P2", ""), ("5", " colspan=x"), ("11", ""))))
    + "</table><ul><li>one</li><li> </li><li>two<ul><li>in</li></ul></li></ul><ol><li>a</li><li>b</li></ol><div>plain<script>no()</script></div></main>"
)


def _html(text, **options):
    return [[b["type"], b.get("text", b.get("caption")), b["heading_path"], b.get("headers", []), b.get("rows", [])] for b in html.page_blocks(text, "n", **options)[2]]


PATH = ["Pump sizes"]
cases(
    "html_fixtures", _html,
    [
        ([TABLE_PAGE], [["heading", "Specs", [], [], []], ["heading", "Pump sizes", [], [], []], ["table", "Flow by speed", PATH, ["Pump", "Litres > slow", "Litres > fast"], [["P1", "4", "9"], ["P2", "5", "11"]]], ["list", "- one - two in", PATH, [], []], ["list", "1. a 2. b", PATH, [], []], ["paragraph", "plain", PATH, [], []]]),
        (["<p>a<div>b</div>"], [["paragraph", "a b", [], [], []], ["paragraph", "b", [], [], []]]),
        (["just text"], [["paragraph", "just text", [], [], []]]),
        ([""], []),
        (["<table><tr><td>1</td><td>2</td></tr></table>"], [["table", "", [], ["Column 1", "Column 2"], [["1", "2"]]]]),
        (["<h2>A</h2><h3>B</h3><p>x</p><h2>C</h2><blockquote>q</blockquote><pre>z</pre>"], [["heading", "A", [], [], []], ["heading", "B", ["A"], [], []], ["paragraph", "x", ["A", "B"], [], []], ["heading", "C", ["A"], [], []], ["paragraph", "q", ["A", "C"], [], []], ["paragraph", "z", ["A", "C"], [], []]]),
    ],
)
cases("spans", lambda value: html._span(html.Node("td", {"colspan": value}, None), "colspan"), [(["3"], 3), (["0"], 1), (["-2"], 1), (["x"], 1), ([None], 1), ([""], 1)])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
