"""The location cascade: PIN codes, addresses, and names of places that several states have."""

from quillspark.operators import places

GAZETTEER = [
    ("Salem", "city", "Tamil Nadu", 2), ("Salem", "city", "Kerala", 1), ("New Salem", "city", "Kerala", None), ("Pune", "city", "Maharashtra", None),
    ("Delhi", "city", "Delhi", 1), ("Delhi", "state", None, None), ("Tamil Nadu", "state", None, None), ("Kerala", "state", None, None), ("..", "city", "Kerala", None),
]


def test_cascade(spark):
    gazetteer = spark.createDataFrame(GAZETTEER, "name string, kind string, state string, rank int")
    pins = spark.createDataFrame([("600001", "Chennai", "Chennai", "Tamil Nadu"), ("600001", "Chennai", "Chennai", "Tamil Nadu")], "postal_code string, city string, district string, state string")
    rows = {
        "PIN 600001 Pune": ("600001", None, "Chennai", "Tamil Nadu", "India"),
        "PIN 999999 Pune": ("999999", None, "Pune", "Maharashtra", "India"),
        "PIN 999999": ("999999", None, None, None, "India"),
        "Address: 1 Main St, Salem, tamil nadu\n\nPune": (None, "1 Main St, Salem, tamil nadu", "Salem", "Tamil Nadu", "India"),
        "Address: nowhere\n\nPune": (None, "nowhere", None, None, None),
        "In Salem": (None, None, "Salem", None, "India"),
        "New Salem it was": (None, None, "New Salem", "Kerala", "India"),
        "Kerala first, then Salem in Tamil Nadu": (None, None, "Salem", "Kerala", "India"),
        "Pune and Salem, Kerala": (None, None, "Salem", "Kerala", "India"),
        "Delhi": (None, None, "Delhi", "Delhi", "India"),
        "from Tamil Nadu": (None, None, None, "Tamil Nadu", "India"),
        "x" * 1001 + " Pune": None,
        "": None,
    }
    docs = spark.createDataFrame([*enumerate(rows), (None, None), (None, "Pune")], "doc_id long, text string")
    found = places.locations(docs, pins, gazetteer).collect()
    got = {r.doc_id: r.location and (r.location.postal_code, r.location.raw_address, r.location.city, r.location.state, r.location.country) for r in found if r.doc_id is not None}
    assert {t: got[i] for i, t in enumerate(rows)} == rows
    assert len(found) == len(rows) + 2
    elsewhere = docs.where("doc_id = 5").selectExpr("doc_id", "text", "'Pune' place_text")
    assert places.locations(elsewhere, pins, gazetteer).first().location.city == "Pune"


def test_without_tables_only_codes_and_addresses_are_told(spark):
    docs = spark.createDataFrame([(1, "PIN 600001"), (2, "Address: a b\n\nc"), (3, "Pune")], "doc_id long, text string")
    got = {r.doc_id: r.location for r in places.locations(docs).collect()}
    assert (got[1].postal_code, got[1].country) == ("600001", None) and got[2].raw_address == "a b" and got[3] is None
    none = spark.createDataFrame([], "name string, kind string, state string, rank int")
    assert {r.doc_id: r.location and r.location.city for r in places.locations(docs, gazetteer=none).collect()} == {1: None, 2: None, 3: None}
