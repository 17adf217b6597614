"""DuckDB spellings of the text rules, for the SQL side of the comparison.

RE2 has no lookaround, so the three patterns that use it are written as two
tests or with a leading character class.  Results agree on the texts compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pricetide import vocab

_NO_LOOKBEHIND = {r"(?<!\+)\bdlc\b": r"(^|[^+\w])dlc\b"}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(sources: str | Sequence[str]) -> str:
    sources = [sources] if isinstance(sources, str) else sources
    return quote("|".join(f"(?:{_NO_LOOKBEHIND.get(s, s)})" for s in sources))


def has(text: str, sources: str | Sequence[str]) -> str:
    return f"regexp_matches({text}, {_any(sources)}, 'i')"


def gsub(text: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({text}, {quote(pattern)}, {quote(to)}, 'gi')"


def squeeze(text: str) -> str:
    return gsub(text, r"\s+")


def unmark(text: str) -> str:
    return f"translate({text}, {quote(vocab.TRADE_MARKS)}, '   ')"


def parse_price(text: str) -> str:
    kept = f"regexp_replace({gsub(text, vocab.CURRENCY_MARKER)}, '[^0-9.,]', '', 'g')"
    number = (
        f"CASE WHEN regexp_matches(x, '[.]') AND regexp_matches(x, ',[0-9]*$') "
        f"THEN regexp_replace(replace(x, '.', ''), '^([^,]*),', '\\1.') ELSE replace(x, ',', '') END"
    )
    prefix = f"regexp_extract({number}, {quote(vocab.NUMBER_PREFIX)}, 1)"
    return f"(SELECT TRY_CAST(NULLIF({prefix}, '') AS DOUBLE) FROM (SELECT {kept} AS x) _p)"


def first_rupee_price(text: str) -> str:
    return parse_price(f"regexp_extract({text}, {quote(vocab.RUPEE_FIGURE)}, 1, 'i')")


def named_platform(text: str) -> str:
    t = unmark(text)
    return (
        f"CASE WHEN {has(t, vocab.BOTH_SWITCHES)} AND NOT {has(t, vocab.EXPLICIT_SWITCH2)} THEN 'SWITCH' "
        f"WHEN {has(t, vocab.SWITCH2)} THEN 'SWITCH2' WHEN {has(t, vocab.SWITCH)} THEN 'SWITCH' "
        f"WHEN {has(t, vocab.OTHER_CONSOLE)} THEN 'UNKNOWN' WHEN {has(t, vocab.SWITCH_LOOSE)} THEN 'SWITCH' END"
    )


def classify(relation: str, context: str, hint: str = "NULL", title: str | None = None) -> str:
    """A relation with ``platform`` and ``kind`` added (its own columns of those names replaced)."""
    text = context if title is None else title
    named = f"COALESCE({named_platform(title)}, " if title else "("
    return f"""
SELECT * EXCLUDE (_product, _platform, _clean, _head), _platform AS platform,
  CASE WHEN {has('_clean', vocab.SERVICE)} THEN 'SERVICE'
    WHEN {has('_clean', vocab.DIGITAL)} OR ({has('_head', vocab.DIGITAL_HEAD)} AND NOT {has('_clean', vocab.PHYSICAL)}) THEN 'DIGITAL'
    WHEN {has('_clean', vocab.HARDWARE)} OR {has('_head', vocab.HARDWARE_HEAD)} THEN 'HARDWARE'
    WHEN {has('_clean', vocab.ACCESSORY)} THEN 'ACCESSORY' WHEN _platform = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'GAME' END AS kind
FROM (SELECT *, split_part(_clean, '|', 1) AS _head FROM (
  SELECT *, CASE WHEN regexp_matches(_product, '\\blite\\b', 'i') AND regexp_matches(_product, '\\boled\\b', 'i')
    THEN {gsub('_product', vocab.COMPATIBLE_MODELS)} ELSE _product END AS _clean FROM (
  SELECT *, {gsub(squeeze(text), vocab.INCLUDES)} AS _product,
    {named}COALESCE({named_platform(squeeze(context))}, {hint}, 'UNKNOWN')) AS _platform
  FROM {relation}) _a) _b) _c"""


def infer_region(text: str, default: str) -> str:
    rules = " ".join(f"WHEN {has(text, source)} THEN '{region}'" for source, region in vocab.REGION_RULES)
    return f"CASE {rules} ELSE {default} END"


def infer_condition(text: str) -> str:
    return f"CASE WHEN {has(text, vocab.PRE_OWNED)} THEN 'PRE_OWNED' ELSE 'NEW' END"


def fold_accents(text: str) -> str:
    return f"regexp_replace(translate(strip_accents({unmark(text)}), '''`', ''), '[^\\x00-\\x7F]', '', 'g')"


def _words_in(values: Sequence[str]) -> str:
    return ", ".join(quote(v) for v in values)


def normalise_title(text: str) -> str:
    out = f"lower({text})"
    for noise in vocab.NOISE:
        out = gsub(out, noise)
    marked = f"regexp_replace({out}, {quote(vocab.BRACKET)}, concat(chr(1), '\\1', chr(2)), 'g')"
    # "(?!\s+only\b)" as two tests.
    whole_note = (
        "(regexp_matches(i, '^\\s*(incl(udes?|uding)?|inkl)\\b') "
        "AND NOT regexp_matches(i, '^\\s*(incl(udes?|uding)?|inkl)\\b\\s+only\\b')) OR regexp_matches(i, '\\bcover\\b')"
    )
    words = (
        "array_to_string(list_filter(regexp_split_to_array(i, '[^a-z0-9]+'), "
        f"lambda w: w <> '' AND w NOT IN ({_words_in(vocab.BRACKET_NOTES)})), ' ')"
    )
    inside = f"(CASE WHEN {whole_note} THEN ' ' ELSE concat(' ', {words}, ' ') END)".replace("(i, ", "(split_part(p, chr(2), 1), ")
    pieces = (
        f"list_transform(string_split({marked}, chr(1)), lambda p: "
        f"CASE WHEN contains(p, chr(2)) THEN concat({inside}, split_part(p, chr(2), 2)) ELSE p END)"
    )
    flat = f"regexp_replace(array_to_string({pieces}, ''), '[^a-z0-9 ]', ' ', 'g')"
    return f"trim(regexp_replace({flat}, '\\s+', ' ', 'g'))"


def key_words(normalised: str) -> str:
    """Words of an already normalised title without stop words."""
    return f"list_filter(string_split({normalised}, ' '), lambda w: w <> '' AND w NOT IN ({_words_in(vocab.STOPWORDS)}))"


def variant_word(word: str) -> str:
    return f"({word} IN ({_words_in(vocab.VARIANT_WORDS)}) OR regexp_matches({word}, '[0-9]'))"


def _longest_first(prefixes: Sequence[str]) -> list[str]:
    return sorted(prefixes, key=lambda p: -len(p.split()))


def match_keys(relation: str, title: str = "raw_title", out: str = "key") -> str:
    """A relation of distinct titles with the grouping key added."""
    cases = " ".join(
        f"WHEN _key = '{p}' OR starts_with(_key, '{p} ') THEN CASE WHEN contains(substr(_key, {len(p) + 2}), ' ') "
        f"THEN substr(_key, {len(p) + 2}) ELSE _key END"
        for p in _longest_first(vocab.PUBLISHER_PREFIXES)
    )
    return f"""
SELECT * EXCLUDE (_fold, _whole, _segments, _raw, _head, _key), CASE {cases} ELSE _key END AS {out} FROM (
SELECT *, array_to_string(CASE WHEN _head IS NOT NULL AND len(_head) > 0 THEN _head ELSE _whole END, ' ') AS _key FROM (
SELECT *, CASE WHEN len(_raw) > 1 AND COALESCE({named_platform('_raw[1]')}, 'UNKNOWN') <> 'UNKNOWN'
  AND len(list_filter(list_zip(_raw[2:], _segments[2:]), lambda z:
    (regexp_matches(z[1], '\\bedition\\b', 'i') AND len(z[2]) > 0)
    OR len(list_filter(z[2], lambda v: {variant_word('v')})) > 0)) = 0 THEN _segments[1] END AS _head FROM (
SELECT *, {key_words(normalise_title('_fold'))} AS _whole, string_split({title}, '|') AS _raw,
  list_transform(string_split(_fold, '|'), lambda s: {key_words(normalise_title('s'))}) AS _segments FROM (
SELECT *, {fold_accents(title)} AS _fold FROM {relation}) _a) _b) _c) _d"""


def confirmed_rest(key: str) -> str:
    names = "|".join(_longest_first(vocab.CONFIRMED_PREFIXES))
    return f"regexp_extract({key}, '^(?:{names})(?: |$)(.*)$', 1)"


def word_set(key: str) -> str:
    return f"list_sort(list_distinct(string_split({key}, ' ')))"


def claimed_total(text: str) -> str:
    options = []
    for source in vocab.CLAIMED_TOTAL:
        number = f"TRY_CAST(replace(regexp_extract({text}, {quote(source)}, 1, 'i'), ',', '') AS BIGINT)"
        options.append(f"CASE WHEN {number} > 0 THEN {number} END")
    return f"COALESCE({', '.join(options)})"
