import json

import pytest

from gridloom.functions import jsonschema
from gridloom.operators import model_year as my
from gridloom.sources import corpus

DRAFT = {
    "id": 7, "name": "X", "validFrom": "2026-06-01T00:00:00+02:00",
    "versions": [{"id": 1, "versionData": {"marketingName": "Edition Hybrid"}}, {"versionData": {"marketingName": "GS Dízel", "versionCode": " gs diesel "}}],
    "options": [{"marketingName": n, "type": "OPTION", "versionStatus": [{"id": 3, "status": s, "priceGross": 0.0} for s in "SN"]} for n in "ab"],
}


def test_linking():
    linked = my.link(DRAFT)
    assert [v["versionData"]["versionCode"] for v in linked["versions"]] == ["EDITION_HYBRID", "GS_DIESEL"]
    assert '"id"' not in json.dumps(linked) and DRAFT["id"] == 7
    assert [v["versionData"]["versionCode"] for v in my.link(DRAFT, ["A", "a"])["versions"]] == ["A", "A_2"]
    for broken, said in [({**DRAFT, "versions": []}, "must not be empty"), ({**DRAFT, "options": [{"versionStatus": [{}]}]}, "2 entries"), ([], "object")]:
        with pytest.raises(my.ModelYearError, match=said):
            my.link(broken)
    with pytest.raises(my.ModelYearError, match="one version code for each"):
        my.link(DRAFT, ["A"])
    with pytest.raises(my.ModelYearError, match="must not contain id"):
        my.validate_links(DRAFT)
    assert my.version_codes([{"versionData": {}}, {"versionData": {"marketingName": "…"}}]) == ["VERSION_1", "VERSION_2"]


def test_json_schema(spark):
    schema = {
        "type": "object", "required": ["name", "at"], "additionalProperties": False,
        "properties": {"name": {"$ref": "#/$defs/a~1b"}, "at": {"type": "string", "format": "date-time"}, "n": {"anyOf": [{"type": "null"}, {"type": "integer"}]}, "xs": {"type": "array", "items": {"enum": [1, 2]}}},
        "$defs": {"a/b": {"type": ["string", "null"]}},
    }
    good = {"name": "x", "at": "2026-06-01T00:00:00Z", "n": None, "xs": [1, 2]}
    jsonschema.validate(good, schema)
    for bad in ({"name": 1}, {"at": "2026-06-01"}, {"n": True}, {"xs": [3]}, {"more": 1}):
        with pytest.raises(jsonschema.SchemaError):
            jsonschema.validate(good | bad, schema)
    rows = spark.createDataFrame([(json.dumps(good),), ("{",), (None,), (json.dumps({}),)], "j string")
    found = [r.e for r in rows.select(jsonschema.error_column(rows.j, schema).alias("e")).collect()]
    assert [len(e) for e in found] == [0, 1, 1, 2]
    with pytest.raises(jsonschema.SchemaError, match="30 more"):
        jsonschema.validate([3] * 50, {"items": {"enum": [1]}})


def brochure():
    heads = ["Felszereltség", "Motor", "Váltómű", "Listaár", "Kedvezmény", "Nyár kedvezmény", "Kedvezményes ár"]
    price = {"Edition": "9990000", "GS": "10990000", "Ultimate": "12190000"}
    rest = ["1", "2", "3"]
    first = [[f"{trim} {lead}", motor, gear, *rest, p] for trim, p in price.items() for lead, motor, gear in (("Hybrid", "(107 kW/145 LE)", "6-fokozatú automata"), ("Turbo", "dízel (96 kW / 130 LE)", "8-fokozatú automata"))]
    second = [[f"{trim} Plug-in", "hybrid (144 kW / 195 LE)", "7-fokozatú automata", *rest, p] for trim, p in price.items()]
    table = lambda page, caption, h, rows: {"type": "table", "table_id": f"t{page}", "source_name": "astra1.pdf", "page": page, "caption": caption, "headers": h, "rows": rows}
    text = lambda page, x: {"type": "paragraph", "source_name": "astra1.pdf", "page": page, "text": x}
    return [
        table(3, "Listaárak és kedvezményes árak", heads, first), table(4, "Listaárak és kedvezményes árak", heads, second), text(5, "Standard felszereltség Edition GS Ultimate"),
        table(6, "Infotainment", ["Kód", "Név", "Leírás", "Edition", "GS", "Ultimate"], [["DZJG9", "Navi", "csak", "220000 Ft", "-", "•"], ["DLZ02", "töltő", "Plug-in hybrid esetén", "1 Ft", "2 Ft", "3 Ft"]]),
        table(8, "Thule tartozékok", ["Név", "Ár"], [["Freeride 532  tető", "45 000"], ["pedálborítás", "1 000 / 2 000"]]), text(12, "Érvényes: 2026. június 1-től MY26B"),
    ]


def test_a_brochure_becomes_a_document(spark, tmp_path):
    doc = my.build(brochure())
    codes = [v["versionData"]["versionCode"] for v in doc["versions"]]
    assert len(codes) == 9 and codes[0] == "EDITION_HYBRID_145_AT6" and codes[1] == "EDITION_DIESEL_130_AT8" and codes[-1] == "ULTIMATE_PHEV_195_AT7"
    assert (doc["name"], doc["validFrom"]) == ("Astra MY26B", "2026-06-01T00:00:00+02:00")
    by = {o["marketingName"]: o for o in doc["options"]}
    kinds = lambda name: "".join(s["status"][0] for s in by[name]["versionStatus"])
    assert kinds("Multimedia Navi infotainment csomag") == "OONNSSONS"
    assert kinds("7,4 kW teljesítményű, egyfázisú fedélzeti töltőegység") == "NNNNNNOOO"
    assert kinds("IntelliDrive 1.0") == "NNNNSSNNS" and kinds("STILO autótöltő") == "NNNNNNOOO"
    assert by["THULE Freeride 532"]["description"] == "tető" and by["Rozsdamentes acél pedálborítás"]["versionStatus"][0]["priceGross"] == 2000.0
    assert len(my.pattern_statuses("S" * 9)) == 9
    source, target = tmp_path / "b.json", tmp_path / "out" / "m.json"
    source.write_text(json.dumps(brochure()), encoding="utf-8")
    assert my.build_file(source, target, name="Other") ["name"] == "Other" and json.loads(target.read_text())["name"] == "Other"
    assert [v["versionData"]["versionCode"] for v in my.link_file(target, tmp_path / "again.json")["versions"]] == codes
    rows = corpus.blocks_from(spark, brochure())
    assert [r.row[0] for r in my.coded_rows(rows, ["dzjg9"]).collect()] == ["DZJG9"]
    assert my.folded_signatures(rows, ["dzjg9", "my26b"]).first().matches


def test_brochures_that_are_not_known():
    for blocks, profile in (([], "auto"), (brochure()[2:], "opel-astra-my26"), (brochure(), "other"), (brochure()[1:], "auto")):
        with pytest.raises(my.ModelYearError):
            my.build(blocks, "x.pdf", profile)
    assert my.valid_from("2026 január 5") == "2026-01-05T00:00:00+01:00"
    for bad in ("2026-01-01", "x"):
        with pytest.raises(my.ModelYearError):
            my.valid_from("", bad)
