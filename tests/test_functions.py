"""Golden values for the scalar expressions, evaluated over whole tables."""

import html
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from pricetide.functions import platforms, prices, titles, urls, values


def run(rows, data, expr, schema="i int, x string, want string"):
    df = rows([(i, *r) for i, r in enumerate(data)], schema)
    return [(r["x"], r["got"], r["want"]) for r in df.withColumn("got", expr).orderBy("i").collect()]


def check(results):
    wrong = [r for r in results if r[1] != r[2]]
    assert not wrong


# Results that must hold exactly.
PRICES = [
    ("₹4,499.00", 4499.0), ("Rs. 4499", 4499.0), ("Rs 4,499", 4499.0), ("INR 4,499", 4499.0),
    ("₹1,299.50", 1299.5), ("1,234,567", 1234567.0), ("3599", 3599.0), ("₹3,599", 3599.0),
    ("4.499,00", 4499.0), ("Rs. 4,499", 4499.0), ("", None), ("abc", None), ("   ", None), (None, None),
    ("4.4.9", 4.4), ("1.234.567,89", 1234567.89), (",", None), (".", None), (".5", 0.5), ("5.", 5.0),
    ("1,2,3.4,5", 1.2), ("1.2,3,4", 12.3), ("0", 0.0), ("free 0.00", 0.0), ("९९९", 999.0), ("9" * 400, None),
]
RUPEES = [
    ("Mario Kart World ₹4,499 Add to cart", 4499.0), ("Price Rs. 3,299 only", 3299.0), ("INR 2,999", 2999.0),
    ("Out of stock", None), ("Mario Party Superstars 3 modes", None), ("Warriors 4 player co-op", None),
    ("Edition 2 of 4", None), ("₹4.499,00", 4.49), ("MRP ₹5,999 ₹3,999", 5999.0), (None, None),
]


def test_parse_price(rows):
    check(run(rows, PRICES, prices.parse_price(F.col("x")), "i int, x string, want double"))


def test_first_rupee_price(rows):
    check(run(rows, RUPEES, prices.first_rupee_price(F.col("x")), "i int, x string, want double"))


def test_minor_units_and_conversion(rows):
    df = rows([("449900", 2, 1.0), ("4499", 0, None), ("449900", None, 95.7)], "p string, u int, r double")
    got = df.select(
        prices.minor_units(prices.parse_price(F.col("p")), F.col("u")).alias("a"),
        prices.fx_convert(F.lit(59.99), F.col("r")).alias("b"),
    ).collect()
    assert [(r.a, r.b) for r in got] == [(4499.0, 59.99), (4499.0, None), (4499.0, 5741.04)]


@pytest.mark.parametrize("inr,kind,want", [(298.0, "GAME", True), (299.0, "GAME", False),
                                           (12_001.0, "GAME", True), (35_000.0, "HARDWARE", False)])
def test_price_looks_wrong(rows, inr, kind, want):
    df = rows([(inr, kind)], "p double, k string")
    assert df.select(prices.price_looks_wrong(F.col("p"), F.col("k")).alias("x")).first().x is want


# Fixed values: (title, store hint, whether the title is passed separately, platform, kind); None = not checked.
KINDS = [
    ("Nintendo Switch Pro Controller", None, False, None, "HARDWARE"),
    ("Nintendo Switch OLED Console", None, False, None, "HARDWARE"),
    ("Nintendo Switch Joy-Con Pair", None, False, None, "HARDWARE"),
    ("Nintendo Switch Docking Station", None, False, None, "HARDWARE"),
    ("Nintendo Switch 2 Online Game Bundled With Pokemon Pokopia", None, False, None, "HARDWARE"),
    ("Nintendo Switch 2", None, False, None, "HARDWARE"),
    ("Nintendo Switch 2 (Japan Only) (Japan)", None, False, None, "HARDWARE"),
    ("Nintendo Switch Sports", None, False, None, "GAME"),
    ("Nintendo Switch 2 Welcome Tour", None, False, None, "GAME"),
    ("Nintendo Switch Carrying Case", None, False, None, "ACCESSORY"),
    ("Micro SD Card 128GB for Switch", None, False, None, "ACCESSORY"),
    ("Pokémon GO Plus | Auto-Catch Accessory | Handy | Nintendo Switch", None, False, None, "ACCESSORY"),
    ("Nintendo Switch 2 Camera", None, False, None, "ACCESSORY"),
    ("Mini Projector HD 4K With 2 Wireless Remote Video Game For TV", None, False, None, "ACCESSORY"),
    ("Nintendo eShop Gift Card", None, False, None, "DIGITAL"),
    ("Nintendo Switch Online Membership", None, False, None, "DIGITAL"),
    ("Mario Kart Season Pass", None, False, None, "DIGITAL"),
    ("Nintendo OLED game loading service", None, False, None, "SERVICE"),
    ("Mario Kart 8 Deluxe Nintendo Switch NINTENDO SWITCH OLED", None, False, None, "HARDWARE"),
    ("Luigi’s Mansion 3: Adventures on Nintendo Switch, Lite, and OLED", "SWITCH", True, None, "GAME"),
    ("Pokémon Violet + The Hidden Treasure Bundle (Game+DLC) – Nintendo Switch", "SWITCH", True, None, "GAME"),
    ("Nintendo Switch Sports | Fun | Joy-Con Compatible | Cartridge", "SWITCH", True, None, "GAME"),
    ("Dying Light Platinum Edition Switch Game Card, DLC Content", "SWITCH", True, None, "GAME"),
    ("Overcooked (Switch) | Overcooked Game with All DLC Remastered", "SWITCH", True, None, "GAME"),
    ("Bayonetta 2 Nintendo Switch (Includes Bayonetta Digital Code)", "SWITCH", True, None, "GAME"),
    ("Nintendo Ring Fit Adventure Switch Game (Motion controller + Gamecard)", "SWITCH", True, None, "GAME"),
    ("Nintendo Neon Red & Neon Blue Joy-Con (L-R)", "SWITCH", True, None, "HARDWARE"),
    ("Nintendo – Switch 32GB Lite – Blue", "SWITCH", True, None, "HARDWARE"),
    ("Cricket 19 International Edition Nintendo Switch (Digital Code)", "SWITCH", True, None, "DIGITAL"),
    ("Hard Shell Protective Bag – Switch", "SWITCH", True, None, "ACCESSORY"),
    ("Final Fantasy Collection Nintendo Switch | Classic JRPG Bundle with Six Titles", None, False, None, "GAME"),
    ("Hogwarts Legacy", "SWITCH", False, "SWITCH", "GAME"),
    ("Hogwarts Legacy", None, False, "UNKNOWN", "UNKNOWN"),
    ("Hogwarts Legacy PS5", "SWITCH", False, "UNKNOWN", None),
    ("Mario Kart Wii U", "SWITCH", False, "UNKNOWN", None),
    ("The Crew 2 PS4 | Seamless Switch | Online", "SWITCH", False, "UNKNOWN", None),
    ("Minecraft Nintendo Switch | also on PS4", None, False, "SWITCH", None),
    ("Mario Kart World Switch 2", "SWITCH", False, "SWITCH2", None),
    ("Zelda NS2", None, False, "SWITCH2", None),
    ("Hogwarts Legacy NS", None, False, "SWITCH", None),
    ("Xenoblade X – Nintendo Switch™ 2 Edition", None, False, "SWITCH2", None),
    ("NSW™, NSW2™ Tales of Vesperia (Europe)", None, False, "SWITCH", None),
    ("NSW™, NSW2™ Kuukiyomi 4 Nintendo Switch 2 Edition+ (Japan)", None, False, "SWITCH2", None),
]


@pytest.mark.parametrize("separate", [False, True])
def test_classification(rows, separate):
    data = [k for k in KINDS if k[2] is separate]
    df = rows(data, "x string, hint string, sep boolean, want_platform string, want_kind string")
    context = F.concat(F.col("x"), F.lit(" Nintendo Switch Games")) if separate else F.col("x")
    got = platforms.with_classification(
        df, context, F.col("hint"), F.col("x") if separate else None
    ).collect()
    wrong = [
        r
        for r in got
        if (r.want_kind is not None and r.kind != r.want_kind)
        or (r.want_platform is not None and r.platform != r.want_platform)
    ]
    assert not wrong


def test_the_titles_console_beats_the_categorys(rows):
    df = rows([("Smash Bros for Nintendo Switch", "SWITCH"), ("Hogwarts Legacy", "SWITCH2")], "x string, want string")
    got = platforms.with_classification(
        df, F.concat("x", F.lit(" Nintendo Switch 2 Games")), F.lit(None).cast("string"), F.col("x")
    ).collect()
    assert all(r.platform == r.want for r in got)


REGION = [
    ("Pikmin 4 Asia Chinese", "ASIA_ZH"), ("Pikmin 4 [Asia English]", "ASIA_EN"), ("Pikmin 4 JP Version", "JP"),
    ("Pikmin 4 NTSC-U", "US"), ("PAL Pikmin 4", "EU"), ("Asia Pikmin 4", "ASIA_EN"), ("Pikmin 4", "IN"),
    ("Reusable bottle", "IN"), ("Pikmin 4 (Chinese Sub)", "ASIA_ZH"),
]
CONDITION = [
    ("Pikmin 4 pre-owned", "PRE_OWNED"), ("[Used] Pikmin 4", "PRE_OWNED"), ("Pikmin 4, open box", "PRE_OWNED"),
    ("A second-hand Pikmin", "PRE_OWNED"), ("renewed cartridge", "PRE_OWNED"), ("Pikmin 4", "NEW"), ("An unused code", "NEW"),
]


def test_region_and_condition(rows):
    check(run(rows, REGION, platforms.infer_region(F.col("x"), F.lit("IN"))))
    check(run(rows, CONDITION, platforms.infer_condition(F.col("x"))))


def test_condition_tier(rows):
    df = rows(
        [
            ("PRE_OWNED", False, "", "New", "PRE_OWNED"),
            (None, True, "badge Pre-Owned", "Zelda", "PRE_OWNED"),
            (None, True, "", "Zelda used", "PRE_OWNED"),
            (None, False, "badge used", "Zelda", "NEW"),
            (None, None, None, "Zelda", "NEW"),
        ],
        "a string, o boolean, c string, t string, want string",
    )
    got = df.withColumn("got", platforms.condition_tier(*[F.col(c) for c in "aoct"])).collect()
    assert all(r.got == r.want for r in got)


CLEAN = [
    ("Pikmin 4: Gather & Grow (Nintendo Switch)", "pikmin 4 gather grow"),
    ("Bayonetta NSW [Asia]", "bayonetta"),
    ("Kirby Star Allies - Brand New Sealed", "kirby star allies"),
    ("  Luigi's   Mansion!!  ", "luigi s mansion"),
    ("X (Includes only Part 1)", "x includes only part 1"),
    ("X (includes a code) [French Cover] (Deluxe, Japan)y", "x deluxe y"),
    ("a [b (c] d) e", "a b c d e"),
    ("no close (asia", "no close asia"),
]


def test_normalise_title(rows):
    check(run(rows, CLEAN, titles.normalise_title(F.col("x"))))


# Pairs that group together, pairs that must not.
MERGE = [
    ("Pokémon Legends: Z-A (Nintendo Switch 2)", "Pokemon Legends Z-A - Switch 2"),
    ("Luigi’s Mansion 3 Nintendo Switch", "Luigis Mansion 3"),
    ("Mario Kart World (Asia English) for Nintendo Switch 2", "Mario Kart World - Nintendo Switch 2 Game"),
    ("Zelda Tears of the Kingdom - Pre-Owned", "Zelda: Tears of the Kingdom (Nintendo Switch)"),
    ("Warner Bros Interactive Entertainment LEGO City Undercover", "LEGO City Undercover"),
    ("Square Enix Final Fantasy VII & VIII Remastered Twin Pack", "Final Fantasy VII VIII Remastered Twin Pack"),
    ("U&I Entertainment Hotline Miami Collection", "Hotline Miami Collection"),
    ("Electronic Arts EA Sports FC 25", "EA Sports FC 25"),
    ("Mario Kart World Nintendo Switch 2 | Premium Racing | Best Physical Switch", "Mario Kart World"),
    ("Neon White Nintendo Switch Games CD | Lightning-Fast Platformer", "Neon White - Nintendo Switch"),
    ("Taxi Chaos 2 | Standard Edition | Switch", "Taxi Chaos 2 - Nintendo Switch"),
    ("NSW™, NSW2™ Tales of Vesperia [Definitive Edition] (Europe)", "Tales Of Vesperia - Definitive Edition (Switch)"),
    ("Tales of Vesperia Definitive Edition(tbd)", "Tales Of Vesperia - Definitive Edition (Switch)"),
    ("Dragon Ball Xenoverse 2 (Replen)", "Dragon Ball Xenoverse 2 Nintendo Switch"),
    ("Lego Marvel Superheroes 2 | Standard Edition | Nintendo Switch (CIB)", "LEGO Marvel Superheroes 2"),
    ("Switch - New Super Mario Bros. U Deluxe - [PAL EU - NO NTSC]", "New Super Mario Bros U Deluxe"),
    ("LEGO Star Wars: The Skywalker Saga (Nintendo Switch) [AT-PEGI]", "Lego Star Wars Skywalker Saga"),
    ("Bayonetta 2 Nintendo Switch (Includes Bayonetta Digital Code)", "Bayonetta 2 - Nintendo Switch"),
    ("13 Sentinels Aegis Rim Nintendo Switch (Pre-owned)", "13 Sentinels Aegis Rim Nintendo Switch"),
    ("NSW™, NSW2™ Capcom Fighting Collection 2 (French Cover) (US)", "Capcom Fighting Collection 2"),
    ("60 in 1 Game Collection (Dates Tbd)", "60 IN 1 GAME COLLECTION (SWITCH)"),
    ("NSW2™ Back to the Dawn [Limited Edition] Game Key Cart (Japan)", "NSW2™ Back to the Dawn [Limited Edition]"),
    ("Nintendo Ring Fit Adventure Switch (OPEN BOX)", "Ring Fit Adventure Nintendo Switch"),
    ("Super Mario 3D World + Bowser’s Fury for Nintendo Switch Lite & OLED", "Super Mario 3D World + Bowser's Fury"),
    ("PRAGMATA (Game-Key Card) for Nintendo Switch 2", "Pragmata - Nintendo Switch 2"),
    ("Princess Peach Showtime Nintendo Game Card", "Princess Peach Showtime! Nintendo Switch"),
]
APART = [
    ("Pokemon Legends Z-A", "Pokemon Legends Z"),
    ("Mario Kart 8 Deluxe", "Mario Kart 8"),
    ("EA Sports FC 24", "EA Sports FC 25"),
    ("Sega Genesis Classics", "Genesis Classics"),
    ("Mario & Sonic at the Olympic Games", "Mario at the Olympic Games"),
    ("Shinobi: Art of Vengeance | Deluxe Edition | Switch 2", "Shinobi: Art of Vengeance"),
    ("Pikmin | Twin Pack", "Pikmin"),
    ("Little Nightmares | Switch Complete Edition", "Little Nightmares"),
    ("Xenoblade Chronicles | 3", "Xenoblade Chronicles"),
    ("Fire Emblem | Three Houses", "Fire Emblem | Engage"),
    ("Splatoon 3 | Side Order", "Splatoon 3"),
    ("Borderlands Collection (Includes only Borderlands 1 Full Game)", "Borderlands Collection"),
    ("Tales of Vesperia [Definitive Edition] (Europe)", "Tales of Vesperia (Europe)"),
    ("LEGO Marvel 2 [Code In A Box] (Switch)", "LEGO Marvel 2 Nintendo Switch"),
    ("Fire Emblem Engage : Divine Edition - Nintendo Switch", "Fire Emblem Engage - Nintendo Switch"),
    ("Pokemon Trading Card Game", "Pokemon Trading Game"),
    ("Among Us - Nintendo Switch", "Among - Nintendo Switch"),
]
KEYS = [
    ("Nintendo Switch Game (Asia)", ""), ("Nintendo Switch 2 | Mario Kart World", "mario kart world"),
    ("Ubisoft", "ubisoft"), ("Square Enix Collection", "square enix collection"),
    ("Bandai Namco Museum", "bandai namco museum"), ("日本語だけ", ""), ("Zelda｜Half Width", "zelda half width"),
    ("Zelda: Tears of the Kingdom", "zelda tears kingdom"),
]


def test_match_key(rows):
    df = rows([(a, b, same) for same, ps in ((True, MERGE), (False, APART)) for a, b in ps], "a string, b string, same boolean")
    keyed = titles.with_match_key(titles.with_match_key(df, "a", "ka"), "b", "kb").collect()
    assert not [r for r in keyed if (r.ka == r.kb) is not r.same]
    got = titles.with_match_key(rows(KEYS, "x string, want string"), "x", "got").collect()
    assert not [r for r in got if r.got != r.want]


def test_fold_accents_on_every_character(spark):
    """The JVM table agrees with the Unicode data for each code point there is."""

    def expected(char):
        if char in "™®©":
            return " "
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        return plain.replace("'", "").replace("`", "")

    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, chr(c)) for c in codes], "c int, x string").repartition(8)
    wrong = [
        (hex(r.c), r.got)
        for r in df.withColumn("got", titles.fold_accents(F.concat(F.lit("a"), "x", F.lit("z")))).collect()
        if r.got
        != f"a{expected(r.x)}z"
    ]
    assert not wrong


SKUS = [
    ("https://www.amazon.in/dp/B0ABCDE123", [], "B0ABCDE123"),
    ("https://www.amazon.in/Pikmin-4/dp/B0ABCDE123/", [], "B0ABCDE123"),
    ("https://www.amazon.in/dp/B0ABCDE123?pid=NO&tag=5", [], "B0ABCDE123"),
    ("https://www.shop.test/x/p/itmabc123?pid=XYZ123ABC", [], "XYZ123ABC"),
    ("https://shop.test/product/mario-kart-world/", [], "mario-kart-world"),
    ("https://shop.test/product/" + "a" * 300, [], "a" * 300),
    ("https://in.shop.test/product-detail?id=847362", [], "product-detail"),
    ("https://in.shop.test/product-detail?id=847362", ["id"], "847362"),
    ("https://in.shop.test/product/mario-kart", ["id"], "mario-kart"),
    ("https://in.shop.test/product-detail?id=", ["id"], "product-detail"),
    ("https://x.test/p?sku=&id=99", ["sku", "id"], "99"),
    ("https://x.test/p?id=&id=7", ["id"], "7"),
    ("https://x.test/p/zelda?utm_source=a&sid=1", ["id"], "zelda"),
    ("https://x.test/p/a b?pid=x%20y+z%zz", [], "x y z%zz"),
    ("https://x.test/p/zelda;v=1", [], "zelda"),
    ("https://example.in/", [], "/"),
]


def test_sku_from_url(rows):
    df = rows(SKUS, "x string, ps array<string>, want string")
    got = df.withColumn("got", urls.sku_from_url(F.col("x"), F.col("ps"))).collect()
    assert not [(r.x, r.got) for r in got if r.got != r.want]


def test_urls(rows):
    df = rows(
        [
            ("https://s.in/c/list?p=2", "https://o.in/x", "https://o.in/x"),
            ("https://s.in/c/list?p=2", "/x/../y?q#f", "https://s.in/y?q#f"),
            ("https://s.in/c/list?p=2", "x/./y", "https://s.in/c/x/y"),
            ("https://s.in/c/list?p=2", "../y", "https://s.in/y"),
            ("https://s.in", "y", "https://s.in/y"),
            ("https://s.in/c/list?p=2", "//o.in/y", "https://o.in/y"),
            ("https://s.in/c/list?p=2", "?p=3", "https://s.in/c/list?p=3"),
            ("https://s.in/c/list", "javascript:alert(1)", "javascript:alert(1)"),
        ],
        "b string, h string, want string",
    )
    got = df.withColumn("got", urls.absolute_url(F.col("h"), F.col("b"))).collect()
    assert not [(r.h, r.got, r.want) for r in got if r.got != r.want]
    canon = [
        ("https://s.in/p?id=1&utm=2#x", ["id"], "https://s.in/p?id=1"),
        ("HTTPS://s.in/p?b=2&id=a%20b~*", ["id", "b"], "https://s.in/p?id=a+b~%2A&b=2"),
        ("https://s.in/p?utm=2", ["id"], "https://s.in/p"),
        ("https://s.in/p?id=3", [], "https://s.in/p"),
    ]
    got = rows(canon, "x string, ps array<string>, want string").withColumn(
        "got", urls.canonical_url(F.col("x"), F.col("ps"))
    )
    assert not [(r.got, r.want) for r in got.collect() if r.got != r.want]
    web = [("https://a", True), (" HTTP://a b", True), ("ht\ttps://a", True), ("javascript:x", False), ("/a", False), (None, False)]
    got = rows(web, "x string, want boolean").withColumn("got", urls.is_web_url(F.col("x"))).collect()
    assert all(r.got == r.want for r in got)
    slugs = [("Zelda: TOTK!", "9", "zelda-totk-9"), ("Straße -- 2", "1", "strasse-2-1"), ("a" * 99 + "-b", "2", "a" * 99 + "-2")]
    got = rows(slugs, "x string, id string, want string").withColumn("got", urls.url_slug(F.col("x"), F.col("id")))
    assert not [(r.got, r.want) for r in got.collect() if r.got != r.want]


def test_rejects_url(rows):
    df = rows(
        [("https://s/p/12", ["/blog/"], True, False), ("https://s/blog/12", ["/blog/"], False, True),
         ("https://s/p/x", None, True, True), ("https://s/p/x", None, None, False)],
        "u string, parts array<string>, digit boolean, want boolean",
    )
    got = df.withColumn("got", urls.rejects_url(F.col("u"), F.col("parts"), F.col("digit"))).collect()
    assert all(r.got == r.want for r in got)


def test_text_values(rows):
    totals = [("1-20 of 1,234 results", 1234), ("57 items found", 57), ("Showing 1 to 9 of 40", 40),
              ("of 0 results, 12 products found", 12), ("nothing", None)]
    check(run(rows, totals, urls.claimed_total(F.col("x")), "i int, x string, want bigint"))
    names = ["Batman &#8211; Switch", "A &amp; B &notit; &copy", "plain", "&#128; &#x110000;", None]
    check(run(rows, [(n, None if n is None else html.unescape(n)) for n in names], values.html_unescape(F.col("x"))))
    ids = rows([("a, b ,", ["a", "b"]), ("", []), (" , ", [])], "x string, want array<string>")
    assert all(r.got == r.want for r in ids.withColumn("got", values.parse_ids(F.col("x"))).collect())
    stamps = rows(
        [("2026-10-21 11:05:37",), ("2026-10-21T11:05:37Z",), ("2026-10-21T16:35:37+05:30",), ("junk",), ("2026",), ("2026-02-30",)],
        "x string",
    )
    got = [r.g for r in stamps.select(values.parse_ts_utc(F.col("x")).cast("string").alias("g")).collect()]
    assert got == ["2026-10-21 11:05:37"] * 3 + [None] * 3
    uncut = rows(
        [("Zelda Breath of the Wi...", ["tooltip", "Zelda  Breath of the Wild"], "Zelda Breath of the Wild"),
         ("Zelda…", ["Zelda"], "Zelda…"), ("Whole", ["Whole thing"], "Whole"), ("...", ["x"], "...")],
        "t string, c array<string>, want string",
    )
    assert all(r.got == r.want for r in uncut.withColumn("got", titles.uncut_title(F.col("t"), F.col("c"))).collect())
    search = rows([("100% fun_game",)], "t string")
    hits = [search.where(titles.literal_contains(F.col("t"), q)).count() for q in ("%", "_", "FUN_", "0% f", "x%", "\\")]
    assert hits == [1, 1, 1, 1, 0, 0]
