"""Lines of nested odds documents: an inner join of three levels inside each document."""

import json

from scoutframe.sources.tables import odds_lines


def _selection(number, market):
    return {"id": f"S{number}", "marketId": market, "label": "over", "points": 1.5, "displayOdds": {"american": "−110"}}


def _lines(spark, *documents):
    df = spark.createDataFrame([(i, d if d is None else json.dumps(d)) for i, d in enumerate(documents)], "doc int, text string")
    return odds_lines(df, "text", ["doc"])


def test_missing_and_repeated_partners(spark):
    document = {
        "events": [{"id": "E1", "name": "a"}, {"id": "E2", "name": "b"}, {"id": "E2", "name": "c"}, {"id": None, "name": "d"}],
        "markets": [{"id": "M2", "eventId": "E2", "name": "m2"}, {"id": "M1", "eventId": "E1", "name": "m1"},
                    {"id": "M3", "eventId": "none", "name": "m3"}, {"id": None, "eventId": "E1", "name": "m4"}, {"id": "M5", "eventId": None, "name": "m5"}],
        "selections": [_selection(1, "M1"), _selection(2, "M2"), _selection(3, "M3"), _selection(4, None), _selection(5, "M5"), _selection(6, "M9"), _selection(7, "")],
    }
    other = {"events": [{"id": "E1", "name": "z"}], "markets": [], "selections": [_selection(1, "M1")]}
    got = sorted((r.doc, r.selectionId, r.name, r.EventName, r.americanOdds) for r in _lines(spark, document, other, None, {"events": []}).collect())
    assert got == [(0, "S1", "m1", "a", "-110"), (0, "S2", "m2", "b", "-110"), (0, "S2", "m2", "c", "-110")]


def test_ten_thousand_selections_in_one_document(spark):
    n = 10_000
    document = {
        "events": [{"id": f"E{i}", "name": f"e{i}"} for i in range(n // 10)],
        "markets": [{"id": f"M{i}", "eventId": f"E{i % (n // 10)}", "name": f"m{i}"} for i in range(n)],
        "selections": [_selection(i, f"M{(i * 7919) % n}") for i in range(n)],
    }
    got = {r.selectionId: (r.name, r.EventName) for r in _lines(spark, document).collect()}
    assert got == {f"S{i}": (f"m{(i * 7919) % n}", f"e{(i * 7919) % n % (n // 10)}") for i in range(n)}
