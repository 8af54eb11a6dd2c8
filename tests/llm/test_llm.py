import json
import os
from datetime import datetime

import pytest

from setaudit.llm import leakage, spellings, survivors, tokenize, truncation

INV = "inv_id bigint, size bigint, crc32 string, sha1 string, location_type string, location_path string, location_entry string, last_modified bigint, indexed_at timestamp, extra string"
AT = datetime(2024, 1, 1)
A, B = "a" * 40, "b" * 40


def inv(i, size=1, crc=None, sha=None, kind="file", lm=100):
    return (i, size, crc, sha, kind, "/p", None, lm, AT, None)


def survive(spark, rows):
    return {(r.group_id, r.field): r.inv_id for r in survivors.survivors(spark.createDataFrame(rows, INV)).collect()}


def test_survivors_groups_and_fields(spark):
    rows = [
        inv(5, crc="0x0b9700d8", kind="archive", lm=50), inv(3, crc="B9700D8", sha=A, kind="remote", lm=0), inv(9, crc=None, sha=A.upper() + " ", lm=None), inv(8, crc="0b9700d8", sha="n/a", kind="archive", lm=2_000_000_000),
        inv(20, crc="00000000"), inv(21, crc="", sha="0" * 40), inv(30, crc="11111111", sha=A), inv(31, crc="11111111", sha=B), inv(40, size=2, crc="11111111", sha=A), inv(50, size=None, crc="22222222"), inv(51, size=None, crc="22222222"), inv(51, size=None, crc="22222222"),
    ]
    got = survive(spark, rows)
    assert {k: v for k, v in got.items() if k[0] == 3} == {(3, "crc32"): 8, (3, "sha1"): 3, (3, "last_modified"): 30, (3, "location"): 30}
    assert got[(50, "location")] == 50 and (50, "sha1") not in got and {g for g, _ in got} == {3, 50}


def test_survivors_without_sha_between_two(spark):
    got = survive(spark, [inv(1, crc="33333333", sha=A), inv(2, crc="33333333", sha=B), inv(3, crc="33333333"), inv(4, crc="33333333"), inv(5, crc="44444444"), inv(6)])
    assert {g for g, _ in got} == {3}
    assert survive(spark, []) == {}


NAMES = ["Brevotrex Kogyo K.K.", "brevotrex kogyo", "Kogyo, Brevotrex", " Brevotrex Kogyo", "BrevotrexKogyo", "BVK", "BVK (Brevotrex Kogyo)", "Lodimar Games Inc.", "Lodimar Gmaes", "Tessarine Didiche", "Didiche T.", "unknown", "-", "", None, "n/a"]


def test_spellings(spark):
    df = spark.createDataFrame([(n, 1) for n in NAMES * 2], "manufacturer string, n int")
    pairs = {(r.a, r.b) for r in spellings.same_names(df, "manufacturer").collect()}
    group = [n for n in NAMES if n and ("revotrex" in n or n.startswith("BVK"))]
    assert {p for p in pairs if p[0] in group} == {(a, b) for a in group for b in group if a < b}
    assert ("Didiche T.", "Tessarine Didiche") in pairs and ("Lodimar Games Inc.", "Lodimar Gmaes") in pairs
    assert all(x not in {"unknown", "-", "", "n/a"} for p in pairs for x in p)
    assert spellings.same_names(df.limit(0), "manufacturer").count() == 0


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 56)] + [(0, 56)], "a bigint, b bigint")
    assert {r.component for r in spellings.components(links).collect()} == {0}


def test_average_linkage_is_average():
    import numpy as np

    out = spellings.average_linkage(np.array([1, 2, 3]), np.array([2, 3, 4]), np.array([0.9, 0.5, 0.9]), 0.4)
    assert out[1] == out[2] != out[3] == out[4]


TEXTS = [None, "", " ", "Hello world's <|endoftext|> 12345", "aaaaaaaaaaaaaaaaaaaaaaab", "この吸い出しは680バイト足りません。\n\n\t x", "🕹️ café — naïve", "the " * 3000, "ababab" * 500, "Hello world's <|endoftext|> 12345"]


@pytest.mark.skipif(not os.path.exists(tokenize.DEFAULT_VOCABULARY), reason="no vocabulary")
def test_encoding_equals_library(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenize.DEFAULT_VOCABULARY)
    reference.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in tokenize.encode(df, "doc_id", "text").collect()}
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert tokenize.encode(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.skipif(not os.path.exists(tokenize.DEFAULT_VOCABULARY), reason="no vocabulary")
def test_encoding_decodes_back():
    encoder = tokenize.Encoder(open(tokenize.DEFAULT_VOCABULARY, encoding="utf-8").read())
    signs = {s: b for b, s in enumerate(tokenize.byte_signs())}
    names = {i: s for s, i in json.loads(encoder.vocabulary)["model"]["vocab"].items()}
    for t, ids in zip(TEXTS, encoder.encode(TEXTS)):
        assert bytes(signs[c] for i in ids for c in names[i]).decode() == (t or "")


PASSAGE = "Repairs of the old board begin with zaban: lift the shield, short the repuren pin, then wait fifty seven seconds for the light and close it"


def test_leakage(spark):
    w = PASSAGE.split()
    docs = [
        (1, "Some text before. " + " ".join(w[3:15]).upper().replace(" ", "\n> ") + " and after"), (2, " ".join(w[3:14]) + " but not on"), (3, None), (4, ""), (5, "x " * 20000 + " ".join(w[:12])),
        (6, " ".join(w[:5] + ["odd"] + w[6:12])), (7, "How many units did the mokigilt crew rebuild after the fuse had failed on Monday"), (7, "unrelated"),
    ]
    items = [(10, PASSAGE, "How many units did the mokigilt crew rebuild after the fuse had failed?"), (11, None, "short question"), (12, PASSAGE, None)]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, item_id int")
    q = spark.createDataFrame(items, "item_id bigint, passage string, question string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, q).collect()} == {(1, 10), (1, 12), (5, 10), (5, 12), (7, 10)}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, q, block_chars=50).where("exact").collect()} == {(1, 10), (1, 12), (5, 10), (5, 12), (7, 10)}
    assert leakage.leaked_items(d.limit(0), q).count() == 0 and leakage.leaked_items(d, q.limit(0)).count() == 0


def test_band_score_finds_edits():
    text, item = leakage.points("xxabcdefghijyy"), leakage.points("abcdXefghij")
    assert leakage.band_score(text, item, 1, 4, 0, len(item) - 1, 99) == 9


def test_truncation(spark):
    full = "The old reader was cleaned and the tile chip of the board was verified again by the night shift."
    rows = [(i, full + " " + full, "a") for i in range(30)] + [(100, full + " The old reader was cleaned and the", "a"), (101, full + " The old reader was cleaned and the tile chip of the board was veri…", "a"), (102, None, "a"), (103, "", "a"), (104, " \n", None), (105, full, None), (106, "Title", "a")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, source string, n bigint")
    assert {r.doc_id for r in truncation.truncated(df).collect()} == {100, 101}
    share = {r.source: (r.texts, r["cut"]) for r in truncation.truncation_by_source(df).collect()}
    assert share["a"] == (33, 2) and share[None] == (1, 0)
    assert truncation.truncated(df.limit(0)).count() == 0


def test_truncation_field_limit(spark):
    rows = [(i, f"word{i} " + "some longer text goes here and on and on"[: 20 - len(str(i))], "cap") for i in range(12)] + [(i, "free text number %d ends here." % i, "free") for i in range(50, 80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.doc_id for r in truncation.truncated(df).collect()} == set(range(12))


def test_truncation_of_many_copies(spark):
    inside = [(i, f"Report number {w}: the old reader was cleaned and the tile chip of the {w} board was verified again.", None) for i, w in enumerate("red blue green black white grey brown pink gold silver amber".split())]
    copies = [(100 + i, "Every Monday in the long winter the old reader was cleaned and the", None) for i in range(20)]
    df = spark.createDataFrame(inside + copies, "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in truncation.truncated(df).collect()) == list(range(100, 120))


def test_truncation_of_short_texts(spark):
    names = "red blue green black white grey brown pink gold silver amber".split()
    rows = [(i, f"Die Prüfung {w}: Wir haben Platinen gefunden, darunter {w} Stücke aus dem Lager.", None) for i, w in enumerate(names)]
    rows += [(30 + i, f"もう一度{w}読み直してください、それから{w}確認します。", None) for i, w in enumerate(names)] + [(50 + i, f"We play Lost Tennis 4 on {w} evenings.", None) for i, w in enumerate(names)]
    df = spark.createDataFrame(rows + [(100, "Wir haben Platinen gefunden, darunte", None), (101, "Lost Tennis 4", None)], "doc_id bigint, text string, source string")
    assert [r.doc_id for r in truncation.truncated(df).collect()] == [100]


def test_spellings_that_contradict(spark):
    names = ["Alma Keleshen", "Keleshen, Alma", "A. Keleshen", "Ruth Keleshen", "R. Keleshen", "Keleshen Ruth", "Shewojair Publishing", "Wilfanor Shewoze", "Chebrovox Denshi", "Potrovox Denshi", "CHEBROVOX DENSHI"]
    df = spark.createDataFrame([(n, "x") for n in names], "manufacturer string, a string")
    pairs = {(r.a, r.b) for r in spellings.same_names(df, "manufacturer").collect()}
    groups = [names[:3], names[3:6], [names[8], names[10]]]
    assert pairs == {(a, b) for g in groups for a in g for b in g if a < b}


def test_linkage_in_rounds_equals_one_task(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    pairs = sorted({(int(min(x)), int(max(x))) for x in rng.integers(0, 60, (260, 2)) if x[0] != x[1]})
    sims = rng.choice([-1.0, *np.round(rng.random(40), 3)], len(pairs))
    one = spellings.average_linkage(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), sims, 0.3)
    df = spark.createDataFrame([(a, b, float(s)) for (a, b), s in zip(pairs, sims)], "a bigint, b bigint, sim double")
    assert {r.id: r.cluster for r in spellings.linkage_rounds(df, 0.3).collect()} == one
    names = [n for n in NAMES if n]
    df = spark.createDataFrame([(n,) for n in names], "manufacturer string")
    assert sorted(spellings.same_names(df, "manufacturer", in_one=1).collect()) == sorted(spellings.same_names(df, "manufacturer").collect())


def test_one_edit_and_common_words():
    assert all(spellings.one_edit("kogyo", x) for x in ("kogyo", "kogy", "ogyo", "koggyo", "kigyo", "koygo")) and not any(spellings.one_edit("kogyo", x) for x in ("kgoy", "kogyoxx", "okgoy"))
    common = spellings.Common(["publishing", "manufacturing", "gavrentin"])
    assert all(w in common for w in ("publ", "pub", "mfg", "gav", "publishng", "j")) and not any(w in common for w in ("zegapel", "pudding", "manual"))


def test_cosine_links_in_blocks_equal_brute_force(spark):
    import math

    words = ["brevotrex", "brevotrx", "kogrevo", "lodimar", "lodimra", "marlodi", "vexbrot"]
    texts = spark.createDataFrame(list(enumerate(words)), "id bigint, telling string")
    vectors = spellings.weighted(texts)
    v = {}
    for r in vectors.collect():
        v.setdefault(r.id, {})[r.gram] = r.weight
    want = {(a, b) for a in v for b in v if a < b and math.fsum(x * v[b].get(g, 0) for g, x in v[a].items()) >= 0.22}
    for block in (1, 2000):
        assert {(r.a, r.b) for r in spellings.cosine_links(vectors, 0.22, block=block).collect()} == want
    links = spark.createDataFrame([(0, i, 0.5 + i / 100, i == 1) for i in range(1, 9)], "a bigint, b bigint, sim double, strong boolean")
    assert {(r.b, r.strong) for r in spellings.best_links(links, 2).where("strong or sim > 0.56").collect()} == {(1, True), (7, False), (8, False)}
