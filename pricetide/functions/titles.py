"""Title cleaning and product grouping keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import vocab
from pricetide.functions import charmap
from pricetide.functions.platforms import platform_of, unmark
from pricetide.functions.regex import let, matches, once, pattern, squeeze

_OPEN, _CLOSE = "\x01", "\x02"


def fold_accents(text: Column) -> Column:
    """ASCII spelling: trade marks to spaces, accents folded, apostrophes and the rest dropped."""
    return F.translate(charmap.rewrite(unmark(text), charmap.compatibility_ascii, drop_rest=True), "'`", "")


def _clean_bracket(inside: Column) -> Column:
    """The words of a bracket without shop notes; nothing when the whole bracket is one."""
    words = F.filter(
        F.split(inside, r"[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*vocab.BRACKET_NOTES)
    )
    return F.when(inside.rlike(pattern(vocab.WHOLE_NOTE)), " ").otherwise(
        F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    )


def normalise_title(title: Column) -> Column:
    """Lower-case title without console, format and condition words or shop notes.

    Brackets are marked by two control characters, so that each marked piece
    holds one bracket followed by plain text and can be cleaned on its own.
    """
    text = F.lower(title)
    for noise in vocab.NOISE:
        text = F.regexp_replace(text, pattern(noise), " ")
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "  "), vocab.BRACKET, f"{_OPEN}$1{_CLOSE}")
    pieces = F.transform(
        F.split(marked, _OPEN),
        lambda piece: F.when(
            piece.contains(_CLOSE),
            F.concat(
                _clean_bracket(F.substring_index(piece, _CLOSE, 1)), F.substring_index(piece, _CLOSE, -1)
            ),
        ).otherwise(piece),
    )
    return F.trim(squeeze(F.regexp_replace(F.array_join(pieces, ""), r"[^a-z0-9 ]", " ")))


def _key_words(folded: Column) -> Column:
    return F.filter(
        F.split(normalise_title(folded), " "), lambda w: (w != "") & ~w.isin(*vocab.STOPWORDS)
    )


def variant_word(word: Column) -> Column:
    """A word that tells two products apart: a number or a variant name."""
    return word.isin(*vocab.VARIANT_WORDS) | word.rlike("[0-9]")


def _longest_first(prefixes: tuple[str, ...]) -> list[str]:
    return sorted(prefixes, key=lambda p: -len(p.split()))


def without_publisher(key: Column) -> Column:
    """Drop the longest leading publisher name when two or more words remain.

    The atomic group settles on the longest name: a shorter one is not tried
    when too little would remain.
    """
    names = "|".join(_longest_first(vocab.PUBLISHER_PREFIXES))
    return F.regexp_replace(key, f"^(?>(?:{names})(?= |$)) (?=[^ ]+ )", "")


def confirmed_prefix_rest(key: Column) -> Column:
    """What follows the longest leading optional publisher name; '' for none."""
    names = "|".join(_longest_first(vocab.CONFIRMED_PREFIXES))
    return F.regexp_extract(key, f"^(?:{names})(?: |$)(.*)$", 1)


def _tells_apart(raw: Column, words: Column) -> Column:
    """A segment naming an edition, or holding a word or number that tells products apart."""
    return (matches(raw, vocab.EDITION) & (F.size(words) > 0)) | F.exists(words, variant_word)


def _name_words(raw: Column, words: Column) -> Column:
    """The words that make the key: those of the part before the first ``|`` or of the whole title.

    ``words`` holds the whole title's words, then those of each segment.  The
    first segment is the whole name when it names a console, keeps a word and
    nothing after it tells products apart.
    """
    segments = F.zip_with(F.split(raw, r"\|"), F.slice(words, 2, F.size(words)), _tells_apart)
    tail = F.slice(segments, 2, F.size(words))
    names_console = platform_of(F.substring_index(raw, "|", 1)) != "UNKNOWN"
    use_head = (F.size(words) > 1) & names_console & (F.size(F.get(words, F.lit(1))) > 0)
    return F.when(use_head & ~F.exists(tail, lambda apart: apart), F.get(words, F.lit(1))).otherwise(
        F.get(words, F.lit(0))
    )


def match_key(title: Column) -> Column:
    """The grouping key of a title; '' means it cannot be grouped."""

    def texts(folded: Column) -> Column:
        whole = F.array(folded)
        return F.when(folded.contains("|"), F.concat(whole, F.split(folded, r"\|"))).otherwise(whole)

    def key(raw: Column) -> Column:
        ascii_text = charmap.rewrite(unmark(raw), charmap.compatibility_ascii_no_bar, drop_rest=True)
        words = F.transform(let(F.translate(ascii_text, "'`", ""), texts), _key_words)
        return F.array_join(let(words, lambda w: _name_words(raw, w)), " ")

    return without_publisher(let(title, key))


def with_match_key(df: DataFrame, title: str, out: str) -> DataFrame:
    """Add the grouping key of a title; no filter on it computes it again."""
    return once(df, {out: match_key(F.col(title))})


def word_set(key: Column) -> Column:
    """A key's words as a set, spelled in one order."""
    return F.array_sort(F.array_distinct(F.split(key, " ")))


def truncated_title(title: Column) -> Column:
    """The shop cut the title short."""
    return title.endswith("...") | title.endswith("…")


def uncut_title(title: Column, candidates: Column) -> Column:
    """A cut title, replaced by the first longer candidate that starts with its stem."""
    full = F.transform(candidates, lambda c: F.trim(squeeze(F.coalesce(c, F.lit("")))))

    def longer(stem: Column) -> Column:
        fits = F.filter(full, lambda c: (stem != "") & (F.length(c) > F.length(stem)) & c.startswith(stem))
        return F.get(fits, F.lit(0))

    stem = F.trim(squeeze(F.regexp_replace(title, r"(\.\.\.|…)$", "")))
    return F.when(truncated_title(title), F.coalesce(let(stem, longer), title)).otherwise(title)


def literal_contains(title: Column, term: str) -> Column:
    """Case-insensitive search in which %, _ and \\ mean themselves."""
    return F.contains(F.lower(title), F.lower(F.lit(term)))
