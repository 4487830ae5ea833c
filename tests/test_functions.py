"""Scalar functions on literal values."""

import pytest
from pyspark.sql import functions as F

from quirelake.functions import color, dates, geometry, protect, records, text


@pytest.fixture(scope="module")
def one(spark):
    base = spark.range(1)

    def value(column):
        return base.select(column.alias("v")).first().v

    return value


FILTER_CASES = [
    ("inverted", (100, 150, 200), (155, 105, 55)),
    ("inverted", (50, 75, 100), (205, 180, 155)),
    ("eco", (250, 250, 250), (255, 255, 255)),
    ("eco", (100, 100, 100), (100, 100, 100)),
    ("black_white", (200, 200, 200), (255, 255, 255)),
    ("black_white", (50, 50, 50), (0, 0, 0)),
    ("lighten", (100, 100, 100), (120, 120, 120)),
    ("lighten", (230, 230, 230), (250, 250, 250)),
    ("lighten", (245, 245, 245), (255, 255, 255)),
    ("no_shadow", (235, 235, 235), (255, 255, 255)),
    ("no_shadow", (100, 100, 100), (100, 100, 100)),
    ("grayscale", (100, 150, 200), (140, 140, 140)),
    ("none", (100, 150, 200), (100, 150, 200)),
    ("sepia", (255, 255, 255), (255, 255, 238)),
]


@pytest.mark.parametrize("name,before,after", FILTER_CASES)
def test_pixel_filters(one, name, before, after):
    assert tuple(one(color.apply_filter(name, *[F.lit(v) for v in before]))) == after


def test_unknown_filter(spark):
    with pytest.raises(ValueError):
        color.apply_filter("mist", *[F.lit(1)] * 3)


@pytest.mark.parametrize("shown,rgb", [
    ("#000000", (0, 0, 0)), ("#FFFFFF", (1, 1, 1)), ("#FF0000", (1, 0, 0)), ("FF0000", (1, 0, 0)), ("#FFF", (1, 1, 1)),
    ("  #00FF00 ", (0, 1, 0)), ("#1e9D0f", (30 / 255, 157 / 255, 15 / 255)), ("#F00F", (1, 0, 0)),
    ("#FF000080", (1, 0, 0)), ("", None), ("#GGHHII", None), ("red", None), ("#12345", None), ("#", None),
])
def test_parse_color(one, shown, rgb):
    got = one(color.parse_color(F.lit(shown)))
    assert got == rgb if rgb is None else tuple(got) == pytest.approx(rgb)


def test_color_default(one):
    assert tuple(one(color.color_or(F.lit("nope"), (0.5, 0, 1)))) == (0.5, 0, 1)


def test_format_color(one):
    half = [F.lit(0.5)] * 3
    assert one(color.format_color(*half)) == "#7F7F7F"
    assert one(color.format_color(*half, mode="round")) == "#808080"
    assert one(color.format_color(F.lit(2.0), F.lit(-1.0), F.lit(1.0))) == "#FF00FF"


@pytest.mark.parametrize("rgb", [(0, 0, 0), (1, 1, 1), (0.2, 0.4, 0.9), (1, 0, 0.5)])
def test_cmyk_round_trip(one, rgb):
    inks = one(color.rgb_to_cmyk(*[F.lit(float(v)) for v in rgb]))
    back = one(color.cmyk_to_rgb(*[F.lit(v) for v in inks]))
    assert tuple(back) == pytest.approx(rgb)


@pytest.mark.parametrize("ago,shown", [
    (0, "just now"), (1, "1 second ago"), (60, "1 minute ago"), (120, "2 minutes ago"), (3600, "1 hour ago"),
    (10800, "3 hours ago"), (86400, "1 day ago"), (432000, "5 days ago"), (1209600, "2 weeks ago"),
    (-10000, "unknown"), (2592000, "Dec 02, 2023"),
])
def test_time_ago(one, ago, shown):
    now = 1704067200
    assert one(dates.time_ago(F.lit(now - ago), F.lit(now))) == shown


def test_time_ago_unknown(one):
    assert one(dates.time_ago(F.lit(None).cast("bigint"), F.lit(5))) == "unknown"


@pytest.mark.parametrize("raw,shown", [
    ("D:20240102030405", "2024-01-02 03:04:05"), ("D:20240102030405+02'00'", "2024-01-02 01:04:05"),
    ("D:20240102030405Z", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05", "2024-01-02 03:04:05"), ("soon", None),
])
def test_doc_date(one, raw, shown):
    assert one(F.date_format(dates.parse_doc_date(F.lit(raw)), "yyyy-MM-dd HH:mm:ss")) == shown


@pytest.mark.parametrize("rotation", [0, 90, 180, 270, 45])
def test_rotate_is_inverted(one, rotation):
    box = [F.lit(v) for v in (10.0, 20.0, 30.0, 40.0)]
    size = [F.lit(612.0), F.lit(792.0), F.lit(rotation)]
    turned = one(geometry.rotate_box(*box, *size))
    back = one(geometry.unrotate_box(*[F.lit(v) for v in turned], *size))
    assert tuple(back) == (10.0, 20.0, 30.0, 40.0)


@pytest.mark.parametrize("r,d,expected", [(0, 90, 90), (90, 90, 180), (180, -90, 90), (90, -90, 0), (0, -90, 270), (270, 90, 0)])
def test_rotation_wraps(one, r, d, expected):
    assert one(geometry.norm_rotation(F.lit(r), F.lit(d))) == expected


def test_scales(one):
    assert one(geometry.fit_scale(F.lit(3200.0), F.lit(100.0))) == 0.5
    assert one(geometry.fit_scale(F.lit(100.0), F.lit(100.0))) == 1.0
    assert one(geometry.thumbnail_scale(F.lit(0.5))) == 5.0


@pytest.mark.parametrize("path,name,stem", [
    ("/a/report.pdf", "report.pdf", "report"), ("a.tar.gz", "a.tar.gz", "a.tar"), ("/x/.hidden", ".hidden", ".hidden"),
    ("/a/b/", "b", "b"), ("", "Unknown", "Unknown"), ("plain", "plain", "plain"),
])
def test_names(one, path, name, stem):
    assert one(text.file_name(F.lit(path))) == name
    assert one(text.file_stem(F.lit(path))) == stem


def test_suffix_name(one):
    assert one(text.suffix_name(F.lit("/a/b/report.pdf"), "redacted")) == "/a/b/report_redacted.pdf"
    assert one(text.suffix_name(F.lit("report.pdf"), "signed")) == "report_signed.pdf"


def test_text_helpers(one):
    assert one(text.dehyphenate(F.lit("coopera-\ntion A-\nB"))) == "cooperation A-\nB"
    assert one(text.html_escape(F.lit("<a & b>"))) == "&lt;a &amp; b&gt;"
    assert one(text.fill_placeholders(F.lit("{page}/{pages}"), F.lit(3), F.lit(9))) == "3/9"
    assert one(text.words_of(F.lit(" a b\t\tc "))) == ["a", "b", "c"]
    assert one(F.length(text.fold(F.lit("İSTANBUL")))) == 8
    assert one(text.context_snippet(F.lit("0123456789"), F.lit(4), F.lit(2), 2)) == "...234567..."
    assert one(text.context_snippet(F.lit("0123456789"), F.lit(0), F.lit(2), 20)) == "0123456789"


def test_cells(one):
    cells = F.array(F.array(F.lit("pear"), F.lit("plum"), F.lit("")), F.array(F.lit("7"), F.lit(""), F.lit("19")))
    assert one(text.cells_to_csv(cells)) == "pear,plum,\n7,,19"
    assert one(text.cells_to_tsv(cells)) == "pear\tplum\t\n7\t\t19"
    odd = F.array(F.array(F.lit('say "x"'), F.lit("p,q"), F.lit("two\nlines")))
    assert one(text.cells_to_csv(odd)) == '"say ""x""","p,q","two\nlines"'


@pytest.mark.parametrize("style,kind,fields", [
    ('{"Highlight":{"color":"#FFFF00"}}', "Highlight", {"color": "#FFFF00"}),
    ('{"Rectangle":{"color":"#FF0000","thickness":2.0,"fill":true}}', "Rectangle", {"thickness": 2.0, "fill": True}),
    ('{"Text":{"text":"Hello","color":"#000000","font_size":12}}', "Text", {"text": "Hello", "font_size": 12}),
    ('{"Redact":{"color":"#000000"}}', "Redact", {"color": "#000000"}),
    ('{"StickyNote":{"comment":"c","color":"#12ab90"}}', "StickyNote", {"text": "c"}),
    ('{"Cloud":{}}', None, {}), ("not json", None, {}),
])
def test_style_json(spark, style, kind, fields):
    parsed = spark.createDataFrame([(style,)], "style string").select(records.style_from_json(F.col("style")).alias("s"))
    got = parsed.first().s
    assert got.kind == kind
    for name, value in fields.items():
        assert got[name] == value
    if kind:
        columns = {c: F.col(f"s.{c}") for c in ("color", "thickness", "fill", "text", "font_size")}
        assert parsed.select(records.style_to_json(F.col("s.kind"), columns)).first()[0] == style


def test_session_entry(spark):
    full = '{"path":"/b.pdf","current_page":3,"zoom":1.5,"viewport_y":0.0,"rotation":90,"auto_crop":true}'
    df = spark.createDataFrame([('"/a.pdf"',), (full,)], "entry string").select(records.session_entry(F.col("entry")).alias("s"))
    bare, detailed = [r.s for r in df.collect()]
    assert bare.path == "/a.pdf" and bare.zoom is None
    assert tuple(detailed) == ("/b.pdf", 3, 1.5, 0.0, 90, True)


def test_geo(one):
    wkt = 'PROJCS["UTM 32N",GEOGCS["WGS 84"],PROJECTION["Transverse_Mercator"]]'
    assert one(records.geo_name(F.lit(wkt), F.lit(1), F.lit("PROJCS"))) == "UTM 32N"
    assert one(records.geo_name(F.lit(None).cast("string"), F.lit(4326), F.lit("GEOGCS"))) == "EPSG:4326"
    assert one(records.geo_name(F.lit("none"), F.lit(None).cast("int"), F.lit("GEOGCS"))) == "GEOGCS"
    assert one(records.geo_projection(F.lit(wkt))) == "Transverse_Mercator"


def test_options_and_fields(one):
    options = F.array(F.lit("a"), F.lit("b"))
    assert one(records.option_index(options, F.lit("b"))) == 1
    assert one(records.option_index(options, F.lit("z"))) is None
    assert one(records.option_label(options, F.lit(7))) == ""
    assert one(records.field_checked(F.lit("Off"))) is False
    assert one(records.field_checked(F.lit(None).cast("string"))) is False
    assert one(records.button_kind(F.lit(32768))) == "radio"


def test_encryption(one):
    right, wrong = F.lit("k" * 32), F.lit("w" * 32)
    locked = protect.encrypt_column(F.lit("secret"), right)
    assert one(protect.decrypt_column(locked, right)) == "secret"
    assert one(protect.decrypt_column(locked, wrong)) is None
