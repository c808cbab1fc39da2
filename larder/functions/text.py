"""Text analysis as column expressions: words, Czech stems, tolerance to typing errors, highlights."""

from __future__ import annotations

from functools import lru_cache
from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case Latin letters that don't decompose, and what they fold to, by one letter and by two.
SINGLE = {"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ħ": "h", "ı": "i", "ŧ": "t", "ŋ": "n"}
DOUBLE = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij"}
# All others fold to the letter that they decompose to.
_FOLDED = {c: normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250)) if c.islower() and normalize("NFD", c)[0].isascii() and len(normalize("NFD", c)) > 1} | SINGLE
ACCENTED, PLAIN = "".join(_FOLDED), "".join(_FOLDED.values())

# The public stop list of Czech.
STOPWORDS = """
a aby aj ale ani asi atd atp až bez bude budem budeš by byl byla byli bylo být co což cz či článek článku články dnes do
ho i já jak jako jakmile jakož je jeho jehož jej její jejich jelikož jemu jen jenž ještě ji jí jiné jíž již jsem jseš jsme
jsou jste k kam kde kdo když ke která které kterou který kteří ku ma má máte mě mezi mi mít mne mnou můj může my na nad
nám napište náš naši nás ne nebo nechť nejsou němu němuž není než nic nové nový o od on ona oni ono ony pak po pod podle
pokud pouze práve pravé pro proč proto protože první před přede při přičemž pta re s se si sice strana své svých svým
svými ta tak také takže tam tato těm tema téma ten tedy tento této tím tímto tipy to tohle toho tohoto tom tomto tomu
tomuto tu tuto ty tyto u už v vám vás váš vaše ve vedle více však všechen vy z za zda zde ze zpět zprávy že
""".split()

# Fixed values of the light stemmer: case endings, of which the longest that leaves three letters goes.
CASE_ENDINGS = """
atech ětem etem atům ech ich ích ého ěmi emi ému ěte ete ěti eti ího iho ími ímu imu ách ata aty ých ama ami ové ovi ými
em es ém ím ům at ám os us ým mi ou a e i o u ů y á é í ý ě
""".split()
POSSESSIVES = "ov in ův".split()

_SPLIT = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case words in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda x: x != "")


def fold(word: Column) -> Column:
    word = F.translate(word, ACCENTED, PLAIN)
    for letter, two in DOUBLE.items():
        word = F.replace(word, F.lit(letter), F.lit(two))
    return word


def folded_words(text: Column) -> Column:
    return F.transform(tokens(text), fold)


def _without(word: Column, endings: list[str], least: int) -> Column:
    """The word without the longest of the endings that leaves so many letters."""
    out = None
    for size in sorted({len(e) for e in endings}, reverse=True):
        ends = (F.char_length(word) >= least + size) & F.right(word, F.lit(size)).isin([e for e in endings if len(e) == size])
        shorter = F.substring(word, F.lit(1), F.char_length(word) - size)
        out = F.when(ends, shorter) if out is None else out.when(ends, shorter)
    return out.otherwise(word)


def _without_case(word: Column) -> Column:
    return _without(word, CASE_ENDINGS, 3)


def _without_possessive(word: Column) -> Column:
    return _without(word, POSSESSIVES, 4)


def _palatalised(word: Column) -> Column:
    size, last, last_but_one = F.char_length(word), F.right(word, F.lit(1)), F.substring(word, -2, 1)
    but = lambda n: F.substring(word, F.lit(1), size - n)
    return (
        F.when(word.endswith("čt"), F.concat(but(2), F.lit("ck")))
        .when(word.endswith("št"), F.concat(but(2), F.lit("sk")))
        .when(last.isin("c", "č"), F.concat(but(1), F.lit("k")))
        .when(last.isin("z", "ž"), F.concat(but(1), F.lit("h")))
        .when((size >= 2) & (last_but_one == "e"), F.concat(but(2), last))
        .when((size >= 3) & (last_but_one == "ů"), F.concat(but(2), F.lit("o"), last))
        .otherwise(word)
    )


def stem(word: Column) -> Column:
    """The folded stem of one lower-case word; null for a word of the stop list."""
    # a step to an array each: nested in one another, the steps would be repeated within each other
    out = F.array(word)
    for step in (_without_case, _without_possessive, _palatalised, fold):
        out = F.transform(out, step)
    return F.when(~word.isin(STOPWORDS), F.get(out, F.lit(0)))


_STOP, _FOLDS = frozenset(STOPWORDS), str.maketrans(_FOLDED | DOUBLE)
_ENDINGS = [({e[-1] for e in endings}, [(n, {e for e in endings if len(e) == n}) for n in sorted({len(e) for e in endings}, reverse=True)], least) for endings, least in ((CASE_ENDINGS, 3), (POSSESSIVES, 4))]


@lru_cache(1 << 17)
def analysed_word(word: str) -> tuple[str | None, str]:
    """The folded stem (see stem; None for a word of the stop list) and the folded form of a word as it stands in a text."""
    word = word.lower()
    folded = word if word.isascii() else word.translate(_FOLDS)
    if word in _STOP:
        return None, folded
    for last, sizes, least in _ENDINGS:
        if word[-1] in last:
            word = next((word[:-n] for n, endings in sizes if len(word) >= least + n and word[-n:] in endings), word)
    if word.endswith(("čt", "št")):
        word = word[:-2] + {"č": "ck", "š": "sk"}[word[-2]]
    elif word[-1] in "cčzž":
        word = word[:-1] + ("k" if word[-1] in "cč" else "h")
    elif len(word) >= 2 and word[-2] == "e":
        word = word[:-2] + word[-1]
    elif len(word) >= 3 and word[-2] == "ů":
        word = word[:-2] + "o" + word[-1]
    return word if word.isascii() else word.translate(_FOLDS), folded


def stems(text: Column) -> Column:
    """Folded Czech stems: the stop list and the stemmer see the diacritics, folding comes last."""
    words = F.filter(tokens(text), lambda x: ~x.isin(STOPWORDS))
    for step in (_without_case, _without_possessive, _palatalised, fold):
        words = F.transform(words, step)
    return words


def allowed_edits(term: Column) -> Column:
    """Typing errors allowed by the analysed term's length: none below 3, one to 5, then two."""
    size = F.char_length(term)
    return F.when(size < 3, 0).when(size <= 5, 1).otherwise(2)


def _swaps(term: Column) -> Column:
    """The term with each pair of neighbouring letters swapped."""
    places = F.when(F.char_length(term) > 1, F.sequence(F.lit(1), F.char_length(term) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.lit(1)), F.substring(term, i, F.lit(1)), F.substring(term, i + 2, F.char_length(term))))


def _swap_and_edit(term: Column, word: Column) -> Column:
    """Whether word is the term with two neighbouring letters swapped, and one more edit before or after them.

    What is swapped isn't edited again, so that the pair must stand in the word as it is, after what
    the term holds before it or before what the term holds after it.
    """
    size = F.char_length(term)
    places = F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        pair = F.concat(F.substring(term, i + 1, F.lit(1)), F.substring(term, i, F.lit(1)))
        before, after = F.substring(term, F.lit(1), i - 1), F.substring(term, i + 2, size)
        head, tail = F.concat(before, pair), F.concat(pair, after)
        rest = F.substring(word, i + 2, F.char_length(word))
        start = F.substring(word, F.lit(1), F.char_length(word) - F.char_length(tail))
        return (word.startswith(head) & (F.levenshtein(after, rest) <= 1)) | (word.endswith(tail) & (F.levenshtein(before, start) <= 1))

    return F.exists(places, at)


def _swap_apart(term: Column, word: Column) -> Column:
    """Whether word is the term with two letters swapped between which one was put in, or which one stood between that was left out."""
    size = F.char_length(term)
    places = F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        letter = lambda k: F.substring(term, i + k, F.lit(1))
        before = F.substring(term, F.lit(1), i - 1)
        put = (F.char_length(word) == size + 1) & word.startswith(F.concat(before, letter(1))) & word.endswith(F.concat(letter(0), F.substring(term, i + 2, size)))
        left = (i + 2 <= size) & (word == F.concat(before, letter(2), letter(0), F.substring(term, i + 3, size)))
        return put | left

    return F.exists(places, at)


def within_edits(term: Column, word: Column, apart: bool = False) -> Column:
    """Whether word is within the term's allowed edits, a swap of neighbours counting as one and none within another edit.

    apart: two letters may also be swapped around a letter that is put in or left out, which makes two edits
    (the unrestricted distance). The built-in distance counts a swap as two, so the swapped forms of the term are
    tried as well.
    """
    k = allowed_edits(term)
    plain = F.levenshtein(term, word) <= k
    swapped = F.when(k == 1, F.exists(_swaps(term), lambda t: t == word)).otherwise(_swap_and_edit(term, word))
    twice = (k == 2) & (F.char_length(term) == F.char_length(word)) & F.exists(_swaps(term), lambda t: F.exists(_swaps(t), lambda u: u == word))
    more = (k == 2) & _swap_apart(term, word) if apart else F.lit(False)
    return (F.abs(F.char_length(term) - F.char_length(word)) <= k) & (plain | ((k >= 1) & swapped) | twice | more)


def edits(term: Column, word: Column) -> Column:
    """0, 1 or 2 edits, for words within two: the swap of two neighbours is one edit."""
    one = (F.levenshtein(term, word) <= 1) | ((F.char_length(term) == F.char_length(word)) & F.exists(_swaps(term), lambda t: t == word))
    return F.when(term == word, 0).when(one, 1).otherwise(2)


def closeness(term: Column, words: Column) -> Column:
    """1 for an exact word, less the more edits the nearest allowed word needs, 0 without one."""
    near = F.filter(words, lambda w: within_edits(term, w))
    each = F.transform(near, lambda w: F.lit(1.0) - F.levenshtein(term, w) / (F.char_length(term) + 1.0))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def html_escaped(text: Column) -> Column:
    # The characters that highlighting escapes.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def marked(text: Column, hit) -> Column:
    """Escaped text with <mark> around the words for which hit(word) is true; null where there is none."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))
    flagged = F.transform(pieces, lambda p: F.struct(html_escaped(p).alias("text"), (p.rlike(r"^[\p{L}\p{N}_]") & hit(p)).alias("hit")))
    joined = F.array_join(F.transform(flagged, lambda p: F.when(p["hit"], F.concat(F.lit("<mark>"), p["text"], F.lit("</mark>"))).otherwise(p["text"])), "")
    return F.when(F.exists(flagged, lambda p: p["hit"]), joined)
