"""Closed vocabularies, word lists, thresholds and patterns.

Fixed values: results depend on these exact entries, so they are written out
once, plainly and in order.  Nothing in this module is logic.  Patterns are
written in the syntax shared by Java and most other engines; flags are added
where they are compiled (``functions.regex``).
"""

# ---- fixed values: closed vocabularies ------------------------------------

PLATFORMS = ("SWITCH", "SWITCH2", "UNKNOWN")
REGIONS = ("IN", "ASIA_EN", "ASIA_ZH", "JP", "US", "EU", "UNKNOWN")
CONDITIONS = ("NEW", "PRE_OWNED")
KINDS = ("GAME", "HARDWARE", "ACCESSORY", "DIGITAL", "SERVICE", "UNKNOWN")
STORE_KINDS = ("SHOPIFY", "WOOCOMMERCE", "BROWSER", "HOBBYALL")
RUN_STATUSES = ("ok", "partial", "failed", "skipped")
EVENT_KINDS = (
    "run_started",
    "store_started",
    "store_progress",
    "store_finished",
    "run_finished",
    "warning",
)
WATCH_CONDITIONS = ("ANY", "NEW")
WATCH_SHOPS = ("ALL", "INDIA")
HOME_CURRENCY = "INR"

# ---- fixed values: thresholds ----------------------------------------------

FX_CLUSTER_THRESHOLD = 8
MIN_CHANGE_PCT = 1.0
OUT_OF_STOCK_RANK = 1e9
GAME_PRICE_FLOOR = 299
GAME_PRICE_CEILING = 12_000
UNPRODUCTIVE_RATIO = 0.15
GIVE_UP_AFTER = 4
CLAIMED_TOTAL_TOLERANCE = 0.9
COLLAPSE_RATIO = 0.75
STEEP_PRICE = 500_000
DUPLICATE_RATE_WARNING = 0.4
SUSPICIOUS_CATEGORY_MAX = 1
SLUG_MAX_LENGTH = 100

# ---- fixed values: prices ---------------------------------------------------

CURRENCY_MARKER = r"₹|\brs\.?|\binr\b"
RUPEE_FIGURE = r"(?:₹|\bRs\.?|\bINR)\s*([\d,]+(?:\.\d{1,2})?)"
NUMBER_PREFIX = r"^(\d+\.?\d*|\.\d+)"

# ---- fixed values: product kind ---------------------------------------------

SERVICE = (
    r"\b(repair|installation|loading|jailbreak|unlock(ing)?|mod(ding)?|chip(ping)?|flash(ing)?)\s*service\b",
    r"\bgame\s*loading\s*service\b",
    r"\b(console\s*)?repair\b",
)

DIGITAL = (
    r"\b(digital|download)\s*(code|version|key)\b",
    r"\be[- ]?shop\b",
    r"\bgift\s*card\b",
    r"\bswitch\s*online\b",
    r"\bmembership\b",
    r"\bvoucher\b",
    r"\bseason\s*pass\b",
)
DIGITAL_HEAD = (r"(?<!\+)\bdlc\b",)
PHYSICAL = (r"\b(game\s*card|cartridge|physical|game\s*cd)\b",)

HARDWARE = (
    r"\bconsole\b",
    r"\b(oled|lite)\s*(model|console|edition)?\b",
    r"\bpro\s*controller\b",
    r"\bdock(ing)?\s*(station|set)?\b",
    r"\bhandheld\b.*\bsystem\b",
    r"\bbundled\s+with\b",
    r"^\s*nintendo\s+switch(\s*2)?\s*(\([^)]*\)\s*)*$",
)
HARDWARE_HEAD = (r"\bjoy[\s-]?cons?\b",)

ACCESSORY = (
    r"\b(carry(ing)?\s*)?case\b",
    r"\b(screen\s*)?protector\b",
    r"\btempered\s*glass\b",
    r"\b(grip|stand|holder|mount|strap|skin|sticker|decal)\b",
    r"\b(charg(er|ing)|cable|adapter|power\s*bank)\b",
    r"\b(head(set|phone)s?|earbuds?|ear\s*phones?)\b",
    r"\b(micro\s*)?sd\s*card\b",
    r"\bmemory\s*card\b",
    r"\bamiibo\b",
    r"\bsteering\s*wheel\b",
    r"\bthumb\s*(grip|stick)",
    r"\b(t[- ]?shirt|hoodie|mug|keychain|poster|figure|plush)\b",
    r"\bcontrollers?\b",
    r"\bcooling\s*pads?\b",
    r"\bswitch\s*(2\s*)?camera\b",
    r"\b(joy\s*sticks?|hotas)\b",
    r"\b(arcade|fight(ing)?|flight)\s*sticks?\b",
    r"\bracing\s*wheels?\b",
    r"\bprojectors?\b",
    r"\bpok[eé]\s*(mon\s*go|ball)\s*plus\b",
    r"\b(bag|pouch)\b",
    r"\b(apparel|sportswear)\b",
)

#: Bracket notes about what the box contains; removed before kinds are read.
INCLUDES = r"\(\s*incl(udes?|uding)?\b[^)]*\)|\([^)]*\bgame\s*card\b[^)]*\)"
#: Model names that a compatibility list contains.
COMPATIBLE_MODELS = r"\b(lite|oled)(\s*(model|console)s?)?\b"

# ---- fixed values: platform -------------------------------------------------

BOTH_SWITCHES = r"\bnsw\b\W*,\s*nsw\s*2\b"
EXPLICIT_SWITCH2 = r"switch\s*2"
SWITCH2 = (r"switch\s*2\b", r"\bns2\b", r"\bnsw\s*2\b", r"\bswitch\s*two\b", r"\bnintendo\s*switch\s*2")
SWITCH = (r"\bnintendo\s*switch\b", r"\bnsw\b")
OTHER_CONSOLE = (
    r"\bplay\s*station\s*[1-5]?\b",
    r"\bps[1-5]\b",
    r"\bps\s*vita\b",
    r"\bxbox\b",
    r"\bwii\s*u\b",
    r"\bwii\b",
    r"\b3ds\b",
    r"\bnintendo\s*ds\b",
    r"\bgame\s*boy\b",
    r"\bgamecube\b",
    r"\bsteam\s*key\b",
    r"\b(pc|windows)\s*(game|version)\b",
)
SWITCH_LOOSE = (r"\bswitch\b", r"\bns\b", r"\bnintendo\b")
#: Trademark, registered and copyright signs read as spaces.
TRADE_MARKS = "™®©"

# ---- fixed values: region and condition -------------------------------------

REGION_RULES = (
    (r"\b(asia|asian)\b.*\b(chinese|chs|cht|zh)\b|\bchinese\s*sub", "ASIA_ZH"),
    (r"\b(asia|asian)\b.*\b(english|eng|en)\b|\basia\s*english\b", "ASIA_EN"),
    (r"\b(jpn?|japan|japanese|nts-j)\b", "JP"),
    (r"\b(usa?|ntsc-u|north\s*america)\b", "US"),
    (r"\b(eu|pal|europe|uk)\b", "EU"),
    (r"\b(asia|asian)\b", "ASIA_EN"),
)
PRE_OWNED = (
    r"\bpre[- ]?owned\b",
    r"\bused\b",
    r"\brefurbished\b",
    r"\bopen\s*box\b",
    r"\bsecond[\s-]?hand\b",
    r"\brenewed\b",
)

# ---- fixed values: title cleaning -------------------------------------------

#: Removed one after the other, in this order.
NOISE = (
    r"\bnintendo\s*switch\s*2\b",
    r"\bnintendo\s*switch\b",
    r"\bswitch\s*2\b",
    r"\bswitch\b",
    r"\b(nsw\s*2|nsw|ns2|ns)\b",
    r"\b(game[\s-]*)?key[\s-]*car[dt]\b",
    r"\bgame[\s-]*card\b",
    r"\b(video\s*)?game(s)?\b",
    r"\b(cartridge|cart|physical|standard|edition)\b",
    r"\b(pre[- ]?owned|used|new|sealed|import|brand\s*new|open\s*box)\b",
    r"\bfor\s+nintendo\b",
)
BRACKET = r"[(\[]([^)\]]*)[)\]]"
WHOLE_NOTE = r"^\s*(incl(udes?|uding)?|inkl)\b(?!\s+only\b)|\bcover\b"
BRACKET_NOTES = (
    "asia", "asian", "japan", "japanese", "jp", "jpn", "us", "usa", "na", "eu", "europe", "european", "uk", "korea",
    "korean", "mde", "english", "eng", "en", "chinese", "chs", "cht", "zh", "french", "multi", "language",
    "languages", "version", "ver", "import", "imported", "region", "free", "pal", "ntsc", "no", "tbd", "dates",
    "replen", "normal", "cib", "nla", "pegi", "at", "uae", "pre", "order", "preorder", "best", "price", "exclusive",
    "video", "australia", "subs", "subtitle", "subtitles",
)

# ---- fixed values: grouping keys ---------------------------------------------

STOPWORDS = (
    "the", "of", "and", "for", "nintendo", "asia", "asian", "english", "chinese", "japanese", "eng", "version",
    "multi", "language", "pal", "ntsc", "cd", "tbd", "nla", "videogioco", "nintedo", "ninteno", "nnintendo", "lite",
    "oled", "subtitle",
)
VARIANT_WORDS = (
    "deluxe", "definitive", "complete", "collector", "collectors", "limited", "special", "gold", "ultimate", "goty",
    "year", "anniversary", "bundle", "pack", "twin", "steelbook", "amiibo", "dlc", "season", "pass", "expansion",
    "royal", "remaster", "remastered", "hd", "trilogy", "collection", "directors", "cut", "plus", "launch",
    "chapter", "part", "episode", "volume", "vol", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi",
    "xii",
)
EDITION = r"\bedition\b"
#: Dropped from the front of a key when at least two words remain.
PUBLISHER_PREFIXES = (
    "warner bros interactive entertainment uk",
    "warner bros interactive entertainment",
    "warner bros interactive",
    "warner bros",
    "square enix",
    "bandai namco entertainment",
    "bandai namco",
    "u i entertainment",
    "ubisoft",
    "electronic arts",
)
#: Dropped only when the rest is the key of another listing on the platform.
CONFIRMED_PREFIXES = (
    "sega", "capcom", "konami", "atlus", "activision", "bandai", "namco", "koei tecmo",
    "thq nordic", "wb", "ubi soft", "fireshine", "2k", "rockstar", "maximum gaming",
    "maximum", "outright", "funbox media", "merge", "microids", "gearbox publishing",
    "nighthawk interactive", "fangamer", "tesura", "nis america", "marvelous", "xseed",
    "pqube", "deep silver", "plaion", "focus entertainment", "nacon", "bigben", "numskull",
    "limited run", "team17", "devolver digital", "astragon", "maximum entertainment",
    "secret mode", "blizzard", "just",
)

# ---- fixed values: pages and URLs --------------------------------------------

CLAIMED_TOTAL = (
    r"of\s+([\d,]+)\s+(?:results?|items?|products?)",
    r"([\d,]+)\s+(?:results?|items?|products?)\s+found",
    r"showing[^.\n]*?of\s+([\d,]+)",
)
ASIN = r"/dp/([A-Z0-9]{10})"
PRODUCT_ID_PARAM = "pid"
PLATFORM_CODES = {"NSW": "SWITCH", "NSW2": "SWITCH2"}
JSONLD_NESTING_KEYS = ("@graph", "itemListElement", "item", "mainEntity")
STATE_TITLE_KEYS = ("title", "productTitle", "name")
STATE_PRICE_KEYS = ("finalPrice", "price", "sellingPrice")
STATE_URL_KEYS = ("baseUrl", "url", "pageUri")
