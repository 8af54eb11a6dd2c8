import io
import json
import time
import zipfile
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from setaudit.functions import checksums, names
from setaudit.kit import Kit, main
from setaudit.operators import audit, graph, nested, rebuild, reconcile, reports, search, snapshots
from setaudit.plans import catalogue
from setaudit.sinks import archives, documents
from setaudit.sources import catalog, files, index
from setaudit.streaming import progress

GAMES = "dat_name string, version string, delivered_at timestamp, name string, description string, extra string"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def changes(spark, rows):
    return {(r.version, r.key, r["diff"]) for r in snapshots.dat_changes(spark.createDataFrame(rows, GAMES)).collect()}


def test_snapshot_changes(spark):
    rows = [
        ("d", "v1.9", T0, "A", "x", None), ("d", "v1.9", T0, "B ", " b  c ", None), ("d", "v1.9", T0, "C", None, None),
        ("d", "v1.10", T0, " A", "x", "other"), ("d", "v1.10", T0, "B", "b c", None), ("d", "v1.10", T0, "C", "", None), ("d", "v1.10", T0, "C", "new", None),
        ("d", "v1.10", T1, "C", "old", None), ("d", "v1.11", T0, "A", "y", None), ("d", "v1.11", T0, "A", "y", None),
    ]
    assert changes(spark, rows) == {("v1.10", "C", "changed"), ("v1.11", "A", "changed"), ("v1.11", "B", "removed"), ("v1.11", "C", "removed")}


def test_snapshot_changes_nulls_and_empty(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(None, None, None, None, None, None), (None, "2", None, "a", None, None)]) == {("2", None, "removed"), ("2", "a", "added")}


PAYLOADS = [
    ({"machine": {"rom": [{"name": "a"}, None, "x", {"size": 1}], "disk": {"name": "d"}}}, {("rom", -1, 0), ("rom", -1, 1), ("disk", -1, 0)}),
    ({"body": {"machine": [{"dipswitch": json.dumps([{"diplocation": [{}, {}], "dipvalue": {}}, {}])}]}}, {("dipswitch", -1, 0), ("dipswitch", -1, 1), ("diplocation", 0, 0), ("diplocation", 0, 1), ("dipvalue", 0, 0)}),
    ({"roms": [], "metadata": {"dipswitches": [None, {"values": [{"value": 3}]}]}}, {("dipswitch", -1, 0), ("dipvalue", 0, 0)}),
    ({"roms": None, "disks": "text"}, set()),
]


def test_nested(spark):
    rows = [(i, json.dumps(p)) for i, (p, _) in enumerate(PAYLOADS)] + [(90, None), (91, ""), (92, '{"roms":[{}]'), (93, '{"roms":[{}]} x'), (94, "read timeout"), (95, '{"roms":[{"a":1,"a":2}]}')]
    got = {}
    for r in nested.flatten_records(spark.createDataFrame(rows, "record_id bigint, payload string"), "record_id", "payload").collect():
        got.setdefault(r.record_id, set()).add((r.child, r.parent_pos, r.pos))
    assert got == {i: e for i, (_, e) in enumerate(PAYLOADS) if e} | {95: {("rom", -1, 0)}}


def _wrapped(x, levels):
    for i in range(levels):
        x = [{f"group{i}": x}] if i % 2 else [{"g": x}, {"z": 1}]
    return x


def test_nested_at_any_depth(spark):
    rows = [(n, json.dumps({"machine": {"x": _wrapped({"rom": [{"name": "a"}]}, n)}})) for n in (0, 1, 7, 9, 20)]
    rows += [
        (50, json.dumps({"dipswitch": [{"n": 1}, {"group": [{"dipvalue": [{}, {"h": [{"dipvalue": {}}]}]}]}]})),
        (51, json.dumps({"rom": [{"name": "a", "rom": [{"name": "b", "parts": [{"roms": '[{"name":"c"}]'}]}]}]})), (52, json.dumps([[{"rom": [[{"n": 1}], {"n": 2}]}]])),
    ]
    found = nested.flatten_records(spark.createDataFrame(rows, "record_id bigint, payload string"), "record_id", "payload").drop("item").collect()
    assert sorted((r.record_id, r.child, r.parent_pos, r.pos) for r in found if r.record_id < 50) == [(n, "rom", -1, 0) for n in (0, 1, 7, 9, 20)]
    assert sorted((r.child, r.parent_pos, r.pos) for r in found if r.record_id == 50) == [("dipswitch", -1, 0), ("dipswitch", -1, 1), ("dipvalue", 1, 0), ("dipvalue", 1, 1)]
    roms = {r.key: r.parent_key for r in found if r.record_id == 51}
    assert len(roms) == 3 and sorted(p in roms for p in roms.values()) == [False, True, True]
    assert sorted(r.pos for r in found if r.record_id == 52) == [0, 1]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_nested_keys_and_tables(spark):
    df = spark.createDataFrame([(7, json.dumps(PAYLOADS[1][0])), (8, json.dumps({"machine": {"@name": "m", "rom": {"@name": "r"}}}))], "record_id bigint, payload string")
    rows = nested.flatten_records(df, "record_id", "payload").cache()
    keys = {r.key for r in rows.collect()}
    assert len(keys) == 6 and all(r.parent_key in keys | {"7", "8"} for r in rows.collect())
    assert [r.f_name for r in nested.scalar_fields(rows, "rom").collect()] == ["r"]
    assert {(r.record_id, r.name) for r in nested.machine_rows(df).collect()} == {(7, None), (8, "m")}


def test_nested_queries_of_all_kinds(spark, tmp_path):
    payload = {"machine": {"rom": {"name": "r"}, "disk": [{"name": "d"}], "dipswitch": [{"name": "s", "diplocation": {"name": "l"}, "dipvalue": [{"name": "v"}, {"name": "w"}]}]}}
    spark.createDataFrame([(1, json.dumps(payload))], "record_id bigint, payload string").write.parquet(str(tmp_path / "machine_records.parquet"))
    names = {q: [r.f_name for r in catalogue.queries()[f"p4_{q}"](spark, str(tmp_path)).orderBy("pos").collect()] for q in ("roms", "disks", "dipswitches", "locations", "values")}
    assert names == {"roms": ["r"], "disks": ["d"], "dipswitches": ["s"], "locations": ["l"], "values": ["v", "w"]}


def test_nested_empty(spark):
    assert nested.flatten_records(spark.createDataFrame([], "record_id bigint, payload string"), "record_id", "payload").count() == 0


INV = "inv_id bigint, name string, size bigint, crc32 string"


@pytest.mark.parametrize("cells", [0.5, 0.002])
def test_reconcile(spark, cells):
    a = [(i, f"n{i}", i, "AB") for i in range(300)] + [(None, "x", 1, None), (1000, None, None, None), (1001, "a", 5, "")]
    b = [(i, f"n{i}", i, "ab", 1) for i in range(2, 300)] + [(5, "other", 5, "ab", 2), (6, "old", 6, "ab", 0), (400, "z", 1, None, 1), (400, "z", 1, None, 1), (1000, None, 3, "", 1), (1001, None, 5, None, 1)]
    left, right = spark.createDataFrame(a, INV), spark.createDataFrame(b, INV + ", copied_at int")
    fields = {"name": F.col("name"), "size": F.col("size"), "crc32": F.coalesce(F.lower("crc32"), F.lit(""))}
    got = {(r.key, r["diff"]) for r in reconcile.differences(left, right, "inv_id", fields, right_latest="copied_at", bucket_keys=256, cells_per_key=cells).collect()}
    assert got == {(0, "missing_in_copy"), (1, "missing_in_copy"), (400, "missing_in_inventory"), (5, "name"), (1000, "size"), (1001, "name")}
    assert reconcile.differences(left.limit(0), right.limit(0), "inv_id", fields, right_latest="copied_at").count() == 0


def test_hash_twin(spark):
    p = spark.range(-50, 50).select("id", F.xxhash64("id").alias("h")).toPandas()
    assert (reconcile.xxhash64_of_long(p.id.to_numpy()) == p.h.to_numpy()).all()
    assert reconcile.peel(np.zeros(0, np.int64), np.zeros((0, 6), np.int64), 8)[1]


SETS = "set_name string, description string, year string, manufacturer string, clone_of string, rom_of string, is_bios boolean, is_device boolean, runnable boolean, bios_set string, device_refs array<string>"


def a_set(name, clone=None, rom=None, bios=False, device=False, bios_set=None, refs=None):
    return (name, name, "1990", "M", clone, rom, bios, device, True, bios_set, refs)


def test_status_rules(spark):
    sets = spark.createDataFrame([a_set(n) for n in ("whole", "part", "none", "empty")], SETS)
    items = spark.createDataFrame([("whole", True, "baddump", "1"), ("part", True, "good", "1"), ("part", False, "good", "2"), ("none", False, "good", "3"), ("whole", False, "good", None)], "set_name string, have boolean, status string, crc32 string")
    of = lambda rule: {r.set_name: r.status for r in audit.set_status(sets, items, rule).collect()}
    assert of("index") == {"whole": "complete", "part": "incomplete", "none": "missing", "empty": "missing"}
    assert of("generic") == {"whole": "incomplete", "part": "incomplete", "none": "missing", "empty": "complete"}
    assert of("strict")["empty"] == "missing" and of("indexed")["whole"] == "incomplete"


COPIES = "inv_id bigint, name string, size bigint, crc32 string, sha1 string, md5 string, location_type string, location_path string, location_entry string, last_modified bigint, source_path string"


def copy(i, name, crc, kind="file", path=None, entry=None, size=1, sha1=None, md5=None, lm=1):
    return (i, name, size, crc, sha1, md5, kind, path or f"/r/{name}", entry, lm, "/r")


def test_status_of_archives_as_they_lie(spark):
    sets = spark.createDataFrame([a_set(n) for n in ("whole", "wrong", "part", "loose", "none")], SETS)
    items = spark.createDataFrame([("whole", "a", "c1"), ("wrong", "a", "c1"), ("wrong", "b", "c2"), ("part", "a", None), ("part", "b", "c2"), ("loose", "a", "c1"), ("none", "a", "c1")], "set_name string, name string, crc32 string")
    copies = [copy(1, "a", "c1", "archive", "/x/Whole.zip", "a"), copy(2, "a", "c9", "archive", "/x/wrong.zip", "a"), copy(3, "a", "c5", "archive", "/x/part.zip", "a"), copy(4, "loose.bin", "c1")]
    got = {r.set_name: (r.required, r.found, r.broken, r.status) for r in audit.set_status_direct(sets, items, spark.createDataFrame(copies, COPIES)).collect()}
    assert got == {"whole": (1, 1, 0, "complete"), "wrong": (2, 1, 1, "broken"), "part": (2, 1, 0, "incomplete"), "loose": (1, 1, 0, "incomplete"), "none": (1, 0, 0, "missing")}


def test_search(spark):
    rows = [copy(1, "Mario.rom", "aa", size=100, lm=5), copy(2, "sonic.rom", "aa", "archive", size=1000, lm=None), copy(3, "zelda.rom", "bb", size=10000), copy(4, "mario.rom", "aa", size=None, lm=9)]
    c = spark.createDataFrame(rows, COPIES)
    ids = lambda df: [r.inv_id for r in df.collect()]
    assert ids(search.by_crc(c, " AA")) == [2, 4, 1] and ids(search.by_name(c, "%mario%")) == [1, 4] and ids(search.by_name(c, "%", 2)) == [1, 4]
    assert ids(search.by_size(c, 0, 500)) == [1] and ids(search.by_size(c, least=5000)) == [3] and ids(search.by_size(c)) == [4, 1, 2, 3]
    assert [(r.crc32, r.copies, r.duplicate) for r in search.rom_info(c).orderBy("crc32").collect()] == [("aa", 3, True), ("bb", 1, False)]
    assert {r.name for r in search.exact(c, spark.createDataFrame([("MARIO.ROM",), (None,)], "name string"), "name").collect()} == {"MARIO.ROM"}
    assert search.rom_info(c.limit(0)).count() == 0 and [r["key"] for r in search.grouped(c).collect()] == ["aa", "bb"]


def test_plans(spark):
    rows = [copy(1, "Game (USA).bin", "aa"), copy(2, "Game [!].bin", "bb"), copy(3, "Kept.bin", "cc"), copy(4, "GAME (usa).bin", "dd", "archive", "/r/z.zip", "e")]
    c = spark.createDataFrame(rows, COPIES)
    assert {r.source: (r.target, r.action) for r in reports.clean_names_plan(c).collect()} == {"/r/Game (USA).bin": ("/r/Game.bin", "rename"), "/r/Game [!].bin": ("/r/Game.bin", "skip"), "/r/Kept.bin": ("/r/Kept.bin", "keep")}
    assert {r.inv_id: r.action for r in reports.consolidate_plan(c, "/out").collect()} == {1: "copy", 2: "copy", 3: "copy", 4: "collision"}
    sets = spark.createDataFrame([a_set("z"), a_set("kept", clone="z")], SETS)
    assert {(r.target, r.action) for r in reports.organize_plan(sets, c, "custom", "/s", F.lower("manufacturer")).collect()} == {("/s/m/z.zip", "move"), ("/s/m/Kept.bin", "move")}
    items = spark.createDataFrame([("z", "other", 1, None), ("z", "Game (usa).bin", 7, None), ("z", "x", 1, "bb"), ("z", "Kept.bin", 1, "ee")], "set_name string, name string, size bigint, crc32 string")
    assert {r.name: (r.matched_by, r.inv_id) for r in reports.match_without_fallback(items, c).collect()} == {"other": (None, None), "Game (usa).bin": ("name", 1), "x": ("crc32", 2), "Kept.bin": (None, None)}
    counted = {r.name: r.sources for r in reports.source_counts(items.withColumn("crc32", F.when(F.col("name") == "x", "bb").otherwise(F.when(F.col("name") == "Kept.bin", "cc"))), c).collect()}
    assert counted == {"x": 1, "Kept.bin": 1}


def test_validate_names_of_several_items(spark):
    items = spark.createDataFrame([("a.bin", 1, "c1", None), ("A.bin", 2, "c2", "s2"), ("a.bin", 2, "c2", "s2"), ("none.bin", 3, None, None)], "name string, size int, crc32 string, sha1 string")
    copies = spark.createDataFrame([(1, "a.BIN", 9, "c2", "s2"), (2, "a.bin", 1, None, None), (3, "none.bin", 3, "c3", None), (4, "other", 1, "c1", None)], "inv_id int, name string, size int, crc32 string, sha1 string")
    got = {(r.inv_id, r.crc32): (r.crc_ok, r.sha_ok, r.size_ok, r.valid) for r in audit.validate(items, copies).collect()}
    assert got == {(1, "c1"): (False, True, False, False), (1, "c2"): (True, True, False, True), (2, "c1"): (None, True, True, False), (2, "c2"): (None, True, False, False), (3, None): (False, True, True, False)}


def test_best_copy(spark):
    rows = [(1, "c", "archive", "/a.zip", "e", 9), (2, "c", "file", "/b", None, 1), (3, "c", "file", "/a", None, 1), (4, None, "file", "/z", None, 1)]
    df = spark.createDataFrame(rows, "inv_id bigint, crc32 string, location_type string, location_path string, location_entry string, last_modified bigint")
    assert [r.inv_id for r in audit.best_copy(df, ["crc32"]).collect()] == [3]
    assert [r.inv_id for r in audit.best_copy(df, ["crc32"], audit.ARCHIVE_FIRST).collect()] == [1]
    assert [r.inv_id for r in audit.best_copy(df, ["crc32"], audit.ARCHIVE_FIRST, ("/b",)).collect()] == [2]


def test_closure_with_cycle_and_dangling(spark):
    sets = spark.createDataFrame([a_set("g", rom="p", bios_set="b", refs=["d", "notdev"]), a_set("p", rom="g"), a_set("b", bios=True, rom="gone"), a_set("d", device=True), a_set("notdev")], SETS)
    got = {(r.root, r.node): r.depth for r in graph.closure(graph.edges(sets)).collect()}
    assert got == {("g", "p"): 1, ("g", "b"): 1, ("g", "d"): 1, ("g", "gone"): 2, ("p", "g"): 1, ("p", "b"): 2, ("p", "d"): 2, ("p", "gone"): 3, ("b", "gone"): 1}
    items = spark.createDataFrame([("g", "g1", None), ("p", "p1", None), ("b", "b1", None)], "set_name string, name string, merge string").withColumns({"size": F.lit(1), "crc32": F.lit("x")})
    assert {(r.name, r.category) for r in graph.required_items(sets, items).where("root = 'g'").collect()} == {("g1", "Game"), ("p1", "Parent"), ("b1", "BIOS")}
    assert rebuild.split_plan(items).count() == 3


def test_closure_of_long_chain(spark):
    n = 71
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "src int, dst int")
    got = {(r.root, r.node): r.depth for r in graph.closure(links).collect()}
    assert got == {(i, j): j - i for i in range(n) for j in range(i + 1, n + 1)}


def test_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(checksums.crc32_hex(F.lit("TestData"))) == f"{zlib.crc32(b'TestData'):08x}" == "c0a1fb36"
    assert [get(checksums.crc_key(F.lit(x))) for x in ("0XAB", " 12345678", "0", "zz", None, "")] == ["000000ab", "12345678", None, None, None, None]
    titles = {"Game (USA) v1.0": "Game", "Another Game [!] (Japan)": "Another Game", "Proto Game (Beta) Rev A": "Proto Game Rev A", "Clean Game": "Clean Game"}
    assert {t: get(names.clean_title(F.lit(t))) for t in titles} == titles
    assert get(names.format_bytes(F.lit(1536))) == "1.50 KB" and get(names.stem(F.lit("/a/b.tar.gz"))) == "b.tar"
    assert get(progress.remaining(F.lit(2), F.lit(10), F.lit(4.0))) == 16.0 and get(documents.bar(F.lit(0.5), 4)) == "██░░"


XML = """<?xml version="1.0"?><!DOCTYPE datafile><datafile><header><name>Cat</name><version>1</version></header>
<game name="g" cloneof="p"><description>G &amp; H</description><year>2024</year><rom name="t.bin" size="1024" crc="ABCDEF01"/><rom name="bad" size="x"/></game></datafile>"""
MACHINES = """<?xml version="1.0"?><mame build="0.256" debug="no"><machine name="005" sourcefile="sega/segag80r.cpp" deviceref_0="z80" runnable="yes"><description>005</description><year>1981</year><manufacturer>Sega</manufacturer>
<biosset name="b" description="B" default="yes"/><rom name="a.rom" size="2048" crc="AA"/><disk name="d" sha1="ff"/><device_ref name="i8035"/><sample name="s1"/><chip type="cpu" tag="maincpu" name="Zilog Z80" clock="3867000"/><display tag="screen" type="raster" rotate="270" width="256" height="224" refresh="60.0"/>
<sound channels="1"/><input players="2" coins="2"><control type="joy" player="1" ways="4"/></input><dipswitch name="Coin A" tag="D1" mask="7"><diplocation name="SW1" number="1"/><dipvalue name="4/1" value="4"/><dipvalue name="3/1" value="5" default="yes"/></dipswitch><driver status="imperfect" emulation="good"/><feature type="sound" status="imperfect"/></machine></mame>"""


def test_catalogue_and_files(spark, tmp_path):
    (tmp_path / "c.xml").write_text(XML)
    at = str(tmp_path / "c.xml")
    sets = catalog.read_sets(spark, at)
    assert catalog.detect(at) == "logiqx" and [(r.set_name, r.description, r.clone_of) for r in sets.collect()] == [("g", "G & H", "p")]
    assert [(r.name, r.size, r.crc32) for r in catalog.items(sets).collect()] == [("t.bin", 1024, "abcdef01")]
    assert catalog.header(spark, at).first().name == "Cat"
    assert catalog.read_cached(spark, at, str(tmp_path / "cache"), 1).count() == catalog.read_cached(spark, at, str(tmp_path / "cache"), 2).count() == 1
    assert len(list((tmp_path / "cache").iterdir())) == 1
    box = tmp_path / "roms"
    box.mkdir()
    (box / "a.bin").write_bytes(b"TestData")
    (box / "bad.zip").write_bytes(b"no archive")
    (box / ".hidden.bin").write_bytes(b"x")
    (box / "notes.txt").write_bytes(b"x")
    (box / "s.zip").write_bytes(archives.packed([("B.rom", b"1"), ("a.rom", b"22"), ("sub/readme.txt", b"no")]))
    rows = {r.name: r for r in files.inventory(spark, str(box)).collect()}
    assert rows["a.bin"].crc32 == "c0a1fb36" and rows["a.bin"].md5 and rows["a.rom"].size == 2 and rows["a.rom"].last_modified == 851470320 and rows["bad.zip"].error and len(rows) == 4
    listed = files.scan(spark, str(box))
    assert [r.path.rsplit("/", 1)[1] for r in listed.collect()] == ["a.bin", "bad.zip", "notes.txt", "s.zip"]
    checked = archives.check(listed.where("is_archive"))
    assert {r.path.rsplit("/", 1)[1]: r.canonical for r in checked.collect()} == {"bad.zip": None, "s.zip": True} and tuple(archives.check_counts(checked).first()) == (1, 0, 1)
    assert files.stale(files.inventory(spark, str(box)), listed.where("NOT is_archive")).count() == 3
    got = {r.entry: (r.crc32, bytes(r.content or b""), r.error is None) for r in files.extract(listed.where("is_archive")).collect()}
    assert got["B.rom"] == (f"{zlib.crc32(b'1'):08x}", b"1", True) and got[None][2] is False
    items = spark.createDataFrame([("s", "B.rom", 1, "00000000", None), ("s", "a.rom", 2, None, None)], "set_name string, name string, size bigint, crc32 string, sha1 string")
    assert {r.entry: r.errors for r in files.scanned_entries(listed.where("ext = 'zip'"), items).collect()} == {"B.rom": "crc32", "a.rom": ""}
    out = archives.extract_all(listed.where("path LIKE '%s.zip'"), str(tmp_path / "out")).collect()
    assert {r.action for r in out} == {"written"} and (tmp_path / "out/s/B.rom").read_bytes() == b"1"
    assert bytes(archives.convert(listed.where("path LIKE '%s.zip'")).first().content).startswith(b"PK")


def test_machine_documents(spark, tmp_path):
    at = tmp_path / "m.xml"
    at.write_text(MACHINES)
    assert catalog.detect(str(at)) == "machines"
    m = catalog.read_sets(spark, str(at))
    r = m.first()
    assert (r.set_name, r.manufacturer, r.device_refs) == ("005", "Sega", ["i8035", "z80"]) and r.driver[0]["_status"] == "imperfect"
    assert catalog.parts(m, "chip").first().clock == "3867000" and [len(x.dipvalue) for x in catalog.parts(m, "dipswitch").collect()] == [2]
    assert catalog.parts(m, "disk").first().sha1 == "ff" and catalog.parts(m, "display").first().width == "256"
    assert catalog.header(spark, str(at), required=False).first().name == "0.256"
    with pytest.raises(ValueError):
        catalog.header(spark, str(at)).first()
    catalog.register(catalog.Format("mine", "m", catalog.GAME, lambda t: "<mine" in t))
    assert "mine" in catalog.available()
    catalog.unregister("mine")
    with pytest.raises(ValueError):
        catalog.handler("mine")


def test_sqlite_catalogue(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "c.db") as db:
        db.execute("CREATE TABLE machines (name TEXT, description TEXT, year TEXT)")
        db.executemany("INSERT INTO machines VALUES (?, ?, ?)", [("a", "A", "1990"), ("b", None, None), (None, "x", "1")])
    assert [tuple(r) for r in catalog.read_sqlite(spark, str(tmp_path / "c.db"), batch=2).orderBy("set_name").collect()] == [("a", "A", "1990", None), ("b", "b", None, None)]


def test_content_detection(spark):
    samples = [(b"NES\x1a" + bytes(100), "xyz", True), (b"plain text " * 20, "xyz", False), (bytes(range(256)) * 4, "xyz", True), (b"%PDF-1.4" + bytes(range(128, 256)), "", False), (b"", "xyz", False), (bytes(2000), "xyz", False), (b"any", "nes", True), (bytes(range(256)), "txt", False), (bytes(0x100) + b"SEGA" + bytes(9), "", True)]
    df = spark.createDataFrame([(i, bytearray(c), e) for i, (c, e, _) in enumerate(samples)], "i int, content binary, ext string")
    got = {r.i: r.yes for r in df.select("i", files.looks_like_content(F.col("content"), F.col("ext")).alias("yes")).collect()}
    assert got == {i: yes for i, (_, _, yes) in enumerate(samples)}


def test_stored_index(spark, tmp_path):
    box, place = tmp_path / "roms", str(tmp_path / "index")
    box.mkdir()
    for n in ("rom1", "rom2"):
        (box / f"{n}.bin").write_bytes(n.encode())
    i = index.Index(spark, place)
    assert i.roms().count() == 0 and i.sources().count() == 0
    assert i.add(str(box)) and not i.add(str(box)) and i.roms().count() == 2
    for n in ("rom3", "rom4"):
        (box / f"{n}.bin").write_bytes(n.encode())
    assert i.refresh() == 4 and i.refresh(["/nowhere"]) == 0
    (box / "rom1.bin").unlink()
    (box / "rom3.bin").unlink()
    assert i.verify() == (2, 2) and i.roms().count() == 4 and i.verify(remove_stale=True) == (2, 2) and i.roms().count() == 2
    row = i.roms().where("name = 'rom2.bin'").withColumn("size", F.lit(99).cast("bigint"))
    assert i.upsert(str(box), row).rom_count == 2 and i.roms().agg(F.max("size")).first()[0] == 99
    before = i.versions()[-1]
    assert i.remove(str(box)) == 2 and i.remove(str(box)) == 0 and i.roms().count() == 0 and i.roms(before).count() == 2
    i.upsert("/other", i.roms(before))
    stale_reader = i.versions()[:-1]
    with pytest.raises(index.Conflict):
        i._commit(stale_reader, {})
    i.optimize()
    assert i.roms().count() == 2 and len(i.versions()) == 1 and json.loads(i.statistics())["rom_count"] == 2 and i.outdated(2**40) == ["/other"]
    i.clear()
    assert i.roms().count() == 0


def test_documents(spark, tmp_path):
    import xml.etree.ElementTree as ET

    sets = spark.createDataFrame([a_set("b&c"), a_set("a", clone="b&c"), a_set("whole")], SETS)
    found = spark.createDataFrame([("b&c", 'r"1', 5, "aa", None, "good", False), ("a", "r2", 6, None, "bb", "baddump", False), ("whole", "r", 1, "cc", None, "good", True)], "set_name string, name string, size bigint, crc32 string, sha1 string, status string, have boolean")
    missing = found.where("NOT have")
    disks = spark.createDataFrame([("a", "dk", "EE")], "set_name string, name string, sha1 string")
    documents.write_fixdat(sets, missing, str(tmp_path / "f.xml"), "F & G", disks=disks)
    root = ET.parse(tmp_path / "f.xml").getroot()
    assert root.find("header/name").text == "F & G" and [g.get("name") for g in root.findall("game")] == ["a", "b&c"] and root.find("game/disk").get("sha1") == "ee"
    documents.write_fixdat(sets, missing, str(tmp_path / "f.dat"), "F", "clrmamepro")
    assert (tmp_path / "f.dat").read_text().startswith("clrmamepro (") and (tmp_path / "f.dat").read_text().count("game (") == 2
    again = catalog.read_sets(spark, str(tmp_path / "f.xml"))
    assert catalog.items(again).count() == 2 and catalog.parts(again, "disk").count() == 1
    report = reports.missing_report(sets, found, "missing_count")
    documents.write_html("R", report, str(tmp_path / "r.html"), "set_name")
    assert (tmp_path / "r.html").read_text().count("<tr>") == 3 and "b&amp;c" in (tmp_path / "r.html").read_text()
    documents.write_missing_text(report, found, str(tmp_path / "r.txt"))
    assert "[Clone] a - a: 1 of 1 missing" in (tmp_path / "r.txt").read_text()
    st = audit.set_status(sets, found, "generic")
    documents.write_analysis(reports.audit_details(st, found), str(tmp_path / "an"))
    assert {(r.status, r.set_name, r.missing) for r in documents.read_analysis(spark, str(tmp_path / "an")).collect()} == {("missing", "a", "r2"), ("missing", "b&c", 'r"1')}
    for form in ("csv", "json", "xml"):
        documents.export_sets(sets, found, str(tmp_path / form), form)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3 and spark.read.json(str(tmp_path / "json")).count() == 3
    health = spark.createDataFrame([(75.0,)], "health double")
    assert "75.0" in documents.text_report("T", st.agg(F.count("*").alias("n")), health) and json.loads(documents.statistics_json(health)) == {"health": 75.0}


def test_rebuild_to_archives(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"content")
    (tmp_path / "s.zip").write_bytes(archives.packed([("e", b"packed")]))
    plan = spark.createDataFrame([("set", "a", "file", str(tmp_path / "x.bin"), None), ("set", "b", "archive", str(tmp_path / "s.zip"), "e"), ("set", "c", "file", str(tmp_path / "gone"), None)], "archive string, name string, location_type string, location_path string, location_entry string")
    read = archives.read_contents(plan)
    assert read.where("error IS NOT NULL").count() == 1
    made = archives.write_files(archives.build(read.where("error IS NULL")), "archive", str(tmp_path / "out"), ".zip")
    assert [r.action for r in made.collect()] == ["written"] and [r.action for r in made.collect()] == ["skipped"]
    with zipfile.ZipFile(tmp_path / "out/set.zip") as z:
        assert {n: z.read(n) for n in z.namelist()} == {"a": b"content", "b": b"packed"}


def test_more_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert [get(names.parse_number(F.lit(x))) for x in ("0x1F", "12", "-3", "1.5", "", None)] == [31, 12, -3, None, None, None]
    assert [get(names.parse_bool(F.lit(x))) for x in ("YES", "1", "no", None)] == [True, True, False, False]
    assert get(names.dump_status(F.lit("bad"))) == "baddump" and get(names.percent_text(F.lit(0.125))) == "12.5%" and get(names.health_sign(F.lit(70.0))) == "fair"
    assert get(names.bytes_in(F.lit(1536), "binary")) == "1.5 KiB" and get(names.bytes_in(F.lit(999))) == "999 bytes"
    at = F.to_timestamp(F.lit("1996-12-24 23:32:08"))
    packed_time = names.dos_parts(at)
    assert str(get(names.dos_time(packed_time["date"], packed_time["time"]))) == "1996-12-24 23:32:08" and get(names.dos_time(F.lit(0), F.lit(0))) is None
    assert catalog.cache_key("/a b/c:d.xml", 5) == "_a_b_c_d.xml_5" and get(checksums.composite_key(F.lit("AB"), F.lit(5))) == "ab_5"


def test_archive_build(spark):
    made = archives.build(spark.createDataFrame([("s", "b", bytearray(b"x")), ("s", "A", bytearray(b"y"))], "archive string, name string, content binary")).first()
    assert [i.filename for i in zipfile.ZipFile(io.BytesIO(bytes(made.content))).infolist()] == ["A", "b"]


def test_stream_of_new_files(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "x.rom").write_bytes(b"abc")
    seen = []
    q = progress.in_batches(progress.new_files(spark, str(box)), lambda df, n: seen.extend(r.name for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == ["x.rom"]


def test_events_and_errors(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "x.rom").write_bytes(b"abc")
    events = progress.Events(spark)
    q = progress.in_batches(progress.new_files(spark, str(box)), lambda df, n: df.count(), str(tmp_path / "cp"))
    q.awaitTermination(60)
    for _ in range(100):
        if events.seen and events.seen[-1][0] == "completed":
            break
        time.sleep(0.1)
    events.close()
    assert events.seen[0][0] == "started" and events.seen[-1][0] == "completed"
    errors = progress.Errors()
    errors.add("scan", "critical", "gone")
    assert errors.critical and errors.of("scan") == errors.of(severity="critical") and errors.text() == "[critical] scan: gone"
    assert progress.cancellable(spark, "mine", lambda: spark.range(3).count()) == 3


def test_kit_and_commands(spark, tmp_path, capsys):
    box, out, store = tmp_path / "roms", tmp_path / "out", str(tmp_path / "index")
    box.mkdir()
    (box / "a.rom").write_bytes(b"TestData")
    (box / "Other (USA).rom").write_bytes(b"zz")
    (box / "clone.zip").write_bytes(archives.packed([("c.rom", b"clone")]))
    crc = lambda b: f"{zlib.crc32(b):08x}"
    dat = tmp_path / "c.xml"
    dat.write_text(
        f'<?xml version="1.0"?><datafile><header><name>C</name></header><game name="main"><description>M</description><rom name="a.rom" size="8" crc="{crc(b"TestData")}"/></game>'
        f'<game name="clone" cloneof="main" romof="main"><description>K</description><rom name="c.rom" size="5" crc="{crc(b"clone")}"/><rom name="a.rom" merge="a.rom" size="8" crc="{crc(b"TestData")}"/></game>'
        '<game name="lost"><description>L</description><rom name="x" size="1" crc="00000001"/></game></datafile>'
    )
    kit = Kit(spark, store)
    assert {r.set_name: r.status for r in kit.analyze(str(dat), str(box)).collect()} == {"main": "complete", "clone": "complete", "lost": "missing"}
    assert {r.set_name: r.status for r in kit.analyze(str(dat), str(box), "direct").collect()} == {"main": "missing", "clone": "incomplete", "lost": "missing"}
    assert kit.rebuild(str(dat), str(out), str(box)).count() == 2
    assert {r.action for r in kit.rebuild(str(dat), str(out), str(box), "non_merged", apply=True).collect()} == {"written"}
    with zipfile.ZipFile(out / "clone.zip") as z:
        assert sorted(z.namelist()) == ["a.rom", "c.rom"]
    assert kit.rebuild(str(dat), str(out), str(box), "non_merged", update=True).count() == 0
    run = lambda *a: main(["--index", store, *map(str, a)], spark)
    for command in (("index", "add", box), ("index", "list"), ("index", "stats"), ("index", "verify"), ("index", "find", "a.rom"), ("stats", dat), ("scan", box), ("verify", box), ("export", dat, tmp_path / "csv"), ("fixdat", dat, tmp_path / "fix.xml"), ("missing", dat, tmp_path / "m.html"), ("analyze", dat, "--out", tmp_path / "an"), ("consolidate", tmp_path / "all", "--apply"), ("organize", dat, box, tmp_path / "sorted"), ("rename", box, "--apply")):
        assert run(*command) == 0
    assert "lost" in (tmp_path / "fix.xml").read_text() and "lost" in (tmp_path / "m.html").read_text() and '"rom_count": 3' in capsys.readouterr().out
    assert sorted(p.name for p in (tmp_path / "all").iterdir() if p.suffix == ".rom") == ["Other (USA).rom", "a.rom", "c.rom"] and (box / "Other.rom").exists()
    assert run("index", "remove", box) == 0 and kit.stored().count() == 0


def test_progress_of_a_stream_with_late_events(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, event_type string, value double"
    at = lambda h: datetime(2024, 1, 1, h)
    for i, rows in enumerate([[(1, at(1), "a", 1.0), (2, at(6), "a", 2.0)], [(3, at(5), "a", 3.0)], [(4, at(1), "a", 9.0), (5, at(20), "b", 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = progress.progress(stream).writeStream.format("memory").queryName("late_events").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start.hour, r.event_type): (r.n, r.total) for r in spark.table("late_events").collect()}
    # the event of hour 5 is late within the watermark and counts, the second one of hour 1 is later and does not
    assert got == {(1, "a"): (1, 1.0), (5, "a"): (1, 3.0), (6, "a"): (1, 2.0)}
