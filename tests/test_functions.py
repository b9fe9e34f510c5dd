from pyspark.sql import functions as F

from atlas.functions import labels as L
from atlas.functions import paths as P
from atlas.functions import vectors as V


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_keyword_rules(spark):
    cases = {
        "Kick 01.wav": "Kick", "[808 Mafia] Snare.wav": "Snare", "808 kick.wav": "808", "CHH_01.wav": None,
        "chh 01.wav": "Closed Hat", "my_kick.wav": None, "drum roll with me.wav": None, "snare roll 2": "Snare",
        "tom roll 2.wav": "Tom", "long roll 2": "Rolls", "Open Hat.wav": "Open Hat", "sub bass": "Bass",
        "(vox) thing": None, "vox thing": "Vocal", "äride": None, "nothing": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "name string, want string")
    got = rows.select("name", "want", L.keyword_label(P.clean_name(F.col("name"))).alias("got")).collect()
    assert {r["name"]: r["got"] for r in got} == cases


def test_path_label(spark):
    assert one(spark, L.path_label, "/kit/Snares/snare 1.wav") == "Snare"
    assert one(spark, L.path_label, "/kit/Percs/a.wav") == "_unsorted"
    assert one(spark, L.path_label, "/kit/x/a.wav") is None


def test_path_parts(spark):
    assert one(spark, P.suffix, "/a/b.WAV") == ".wav"
    assert one(spark, P.suffix, "/a/.wav") == ""
    assert one(spark, P.suffix, "/a/b.") == ""
    assert one(spark, P.stem, "/a/b.c.wav") == "b.c"
    assert one(spark, P.parent_folder, "/a/b.wav") == "a"


def test_cloud_id(spark):
    cases = {
        "https://drive.google.com/drive/folders/ab_C-1?id=zz": ("ab_C-1", True),
        "https://drive.google.com/open?id=xyz": ("xyz", False),
        "https://drive.google.com/folderview?id=xyz": ("xyz", True),
        "https://drive.google.com/file/d/qq9/view": ("qq9", False),
        "https://example.org/": (None, False),
    }
    for url, want in cases.items():
        assert tuple(one(spark, P.cloud_id, url)) == want


def test_ref_kind_and_reference(spark):
    assert one(spark, P.ref_kind, "https://www.MediaFire.com/x") == "mediafire"
    assert one(spark, P.ref_kind, "https://drive.google.com/x") == "drive"
    assert one(spark, P.ref_kind, "/home/me") == "local"
    assert one(spark, P.clean_reference, "  '/a/my\\ kit' ") == "/a/my kit"
    assert one(spark, P.clean_reference, "\"") == ""
    assert one(spark, P.clean_reference, "look: https://a.b/c?d e") == "https://a.b/c?d"
    assert one(spark, P.clean_reference, "HTTPS://a.b x") == "HTTPS://a.b x"


def test_extract_link(spark):
    button = '<a class="x" href="https://download1.org/a?b=1&amp;c=2 " id="downloadButton">x</a>'
    by_class = '<div class="a download_link b"><p>t</p><a target="_blank" href="/f.zip">x</a></div>'
    by_href = "<a href='/other'>n</a><a class=q href='/download/9'>x</a>"
    bare = "var u = 'https://download3.org/z'; "
    assert one(spark, P.extract_link, by_href + by_class + button) == "https://download1.org/a?b=1&c=2"
    assert one(spark, P.extract_link, by_href + by_class) == "/f.zip"
    assert one(spark, P.extract_link, by_href) == "/download/9"
    assert one(spark, P.extract_link, '<link href="https://download2.org/y">') == "https://download2.org/y"
    assert one(spark, P.extract_link, bare) == "https://download3.org/z"
    assert one(spark, P.extract_link, "<p>none</p>") is None


def test_extract_entries(spark):
    a, b, me = "a" * 25, "b" * 26, "m" * 30
    page = f'["{a}","One"],["{me}","Self"],["{b}","T\\u0077o"],["{a}","Again"]'
    got = one(spark, lambda c: P.extract_entries(c, own_id=F.lit(me)), page)
    assert [tuple(e) for e in got] == [(a, "One"), (b, "Two")]
    assert one(spark, P.extract_entries, "nothing") == []


def test_file_name(spark):
    header = spark.createDataFrame([(
        'attachment; filename="a%20b+c.zip"', None), (None, "https://x.org/p/q%20r.zip?s=1"),
        (None, "https://x.org/"), (None, "https://x.org/bad%zz.zip")], "h string, u string")
    got = [r["f"] for r in header.select(P.file_name(F.col("h"), F.col("u")).alias("f")).collect()]
    assert got == ["a b+c.zip", "q r.zip", "downloaded_file.zip", "bad%zz.zip"]


def test_colours_and_slots(spark):
    rgb = one(spark, L.label_colour, "Kick")
    assert [round(x * 255) for x in rgb] == [255, 94, 98]
    assert [round(x * 255) for x in one(spark, L.label_colour, "???")] == [136] * 3
    assert [round(x * 255) for x in one(spark, L.hex_to_rgb, "#zz00ff")] == [136, 0, 255]
    assert one(spark, L.section_slot, "Crash") == one(spark, L.section_slot, "Unsorted")
    assert len(L.KEYWORD_RULES) == 20 and len(L.PALETTE) == 21 and len(L.SECTION_ORDER) == 19


def test_search_weight(spark):
    rows = spark.createDataFrame([("Big KICK", "x"), ("a", "Kicks"), ("a", "b")], "f string, s string")
    got = [r["w"] for r in rows.select(L.search_weight("kick", F.col("f"), F.col("s")).alias("w")).collect()]
    assert got == [1.0, 1.0, 0.12]
    assert rows.select(L.search_weight("", F.col("f")).alias("w")).first()["w"] == 1.0


def test_normalise(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r["u"] for r in rows.select(V.l2_normalize(F.col("v")).alias("u")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]
