"""Text functions as Spark columns: everything runs inside a row, with built-in expressions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as L

#: White space, letters and word characters as in Unicode-aware regular expressions, for Java's dialect.
WS = r"\s\x1c-\x1f\x{85}\p{Z}"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD = rf"{LETTER}+(?:[-']{LETTER}+)*"
WORD_CHAR = r"[\p{L}\p{N}_]"
#: The characters of WS, one by one.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(c).startswith("Z"))
#: Joins the two parts and the entries of a table that is one literal.
_PART, _ENTRY = "\x01", "\x02"


def _table(entries: dict[str, str]) -> Column:
    """A map as one literal, which is parsed once when the query is planned."""
    return F.str_to_map(F.lit(_ENTRY.join(f"{k}{_PART}{v}" for k, v in entries.items())), F.lit(_ENTRY), F.lit(_PART))


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, dict[str, str]]:
    """(characters, what each becomes, those that become several): compatibility decompositions without combining marks.

    Characters beyond the end of what they become are dropped. Syllables of Hangul stay whole.
    """
    one, gone, several = {}, [], {}
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000))):
        if unicodedata.combining(c):
            gone.append(c)
        elif (plain := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) != c:
            (one if len(plain) == 1 else several)[c] = plain
    return "".join([*one, *gone]), "".join(one.values()), several


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a column that a lambda captures would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, join: Callable[[Column, Column], Column], block: int = 64, zero: float = 0) -> Column:
    """What an associative join makes of all elements up to each, zero first. Appending copies an array, so it goes block by block, and what precedes a block joins in then.

    A block has `block` elements, in long arrays more, so that blocks stay few as well.
    """
    step = 4  # elements appended at once
    each = lambda x: F.when(F.size(x) > 1 << 20, 1024).when(F.size(x) > 1 << 16, 256).otherwise(-(-block // step) * step)

    def plain(x: Column) -> Column:
        return F.slice(F.aggregate(x, F.array(F.lit(zero)), lambda a, v: F.concat(a, F.array(join(F.element_at(a, -1), v)))), F.lit(2), F.size(x))

    def one(x: Column, at: Column) -> Column:
        def grown(a: Column, k: Column) -> Column:
            joined = [join(F.element_at(a, -1), F.get(x, k))]
            for i in range(1, step):
                joined.append(join(joined[-1], F.get(x, k + i)))
            return F.concat(a, F.array(*joined))

        n = F.least(each(x), F.size(x) - at)
        return F.slice(F.aggregate(F.sequence(at, at + F.greatest(n, F.lit(1)) - 1, F.lit(step)), F.array(F.lit(zero)), grown), F.lit(2), n)

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), each(x)), lambda at: one(x, at))

    def shifted(parts: Column, totals: Column) -> Column:
        return F.flatten(F.transform(parts, lambda y, i: let(F.coalesce(F.get(totals, i - 1), F.lit(zero)), lambda base: F.transform(y, lambda v: join(base, v)))))

    total = lambda y: F.coalesce(F.get(y, F.size(y) - 1), F.lit(zero))
    return let(values, lambda x: let(blocks(x), lambda parts: let(plain(F.transform(parts, total)), lambda t: shifted(parts, t))))


def running(lengths: Column, block: int = 64, zero: float = 0) -> Column:
    """Inclusive prefix sums of an array of numbers of zero's kind."""
    return scanned(lengths, lambda a, v: a + v, block, zero)


def held_at_zero(steps: Column) -> Column:
    """The depth after each of many steps up and down, where a step below zero stays at zero: sums less the least sum so far."""
    return let(running(steps), lambda s: F.zip_with(s, scanned(s, F.least), lambda a, low: a - low))


def bisect(n: Column, holds: Callable[[Column], Column]) -> Column:
    """The least x in [0, n) for which holds(x), if it holds for all that follow; n if for none."""

    def narrow(span: Column, _: Column) -> Column:
        middle = F.shiftright(span["lo"] + span["hi"], 1)
        found = F.when(holds(middle), F.struct(span["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), span["hi"].alias("hi")))
        return F.when(span["lo"] < span["hi"], found).otherwise(span)

    whole = lambda size: F.aggregate(F.sequence(F.lit(0), F.length(F.bin(size.cast("long")))), F.struct(F.lit(0).alias("lo"), size.alias("hi")), narrow)["lo"]
    return let(n.cast("int"), whole)


def runs(array: Column, key: Callable[[Column], Column]) -> Column:
    """An array cut where key changes: an array of arrays."""

    def cut(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (key(F.get(x, i)) != key(F.get(x, i - 1))))
        return let(starts, lambda at: F.transform(at, lambda a, k: F.slice(x, a + 1, F.coalesce(F.get(at, k + 1), F.size(x)) - a)))

    return let(array, lambda x: F.when(F.size(x) > 0, cut(x)).otherwise(F.slice(F.array(x), 1, 0)))


def exploded(rows: DataFrame, keep: Sequence[str], array: Column, name: str, place: str | None = None) -> DataFrame:
    """A row per element of array, with the columns of keep and, if asked for, the element's place.

    For an inner explode the optimizer infers a filter on the array and pushes it to the scan, where the array is
    computed a second time; the outer one leaves it alone.
    """
    made = F.posexplode_outer(array).alias("__at", name) if place else F.explode_outer(array).alias(name)
    out = rows.select(*keep, made).where(F.col(name).isNotNull())
    return out.withColumnRenamed("__at", place) if place else out


def computed(rows: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """The columns of keep and the named ones, each computed once: a filter on them is not pushed to where they would be computed again."""
    return rows.select(*keep, F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def normalize(c: Column) -> Column:
    """Unix line ends, no non-breaking spaces, single blanks, at most one empty line, stripped. Null stays null."""
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("\xa0", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    # a search for bytes is cheap next to a regular expression, which most texts do not need
    blanks = lambda t: F.when(t.contains("  ") | t.contains("\t"), F.regexp_replace(t, r" [ \t]+|\t[ \t]*", " ")).otherwise(t)
    lines = lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    return strip(let(let(c, blanks), lines))


def truncate(c: Column, limit: int) -> Column:
    return F.substring(c, 1, limit)


def words(c: Column) -> Column:
    """Runs of letters, with inner hyphens and apostrophes."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), 0)


def lower_words(c: Column) -> Column:
    """Lower-cased words; one call for all of a text's words, since each call is dear."""
    return let(words(c), lambda w: F.when(F.size(w) > 0, F.split(F.lower(F.array_join(w, "\x01")), "\x01", -1)).otherwise(F.array().cast("array<string>")))


def blank_words(c: Column) -> Column:
    """What white space separates."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"[^{WS}]+"), 0)


def count_blank_words(c: Column) -> Column:
    return F.size(blank_words(c))


def fold(c: Column) -> Column:
    """Lower case, compatibility forms and accents replaced by plain letters (see fold_table)."""
    before, after, several = fold_table()
    # a look-up in a table is a search through it: it is for a text's distinct characters that become several, not for all characters
    distinct = lambda t: F.array_distinct(F.split(F.regexp_replace(t, r"[\x00-\x7f]+", ""), ""))
    spell = lambda t, rest: F.aggregate(F.filter(F.array_except(distinct(t), distinct(rest)), lambda x: x != ""), t, lambda a, x: F.replace(a, x, F.try_element_at(_table(several), x)))
    plain = lambda t: F.octet_length(t) == F.length(t)
    # the large tables are for texts that need them; a regular expression of so many ranges is slower than a look-up
    folded = lambda low: let(F.translate(low, before, after), lambda t: F.when(plain(t), t).otherwise(let(F.translate(t, "".join(several), ""), lambda rest: F.when(rest != t, spell(t, rest)).otherwise(t))))
    return let(F.lower(c), lambda low: F.when(plain(low), low).otherwise(folded(low)))


def fold_tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def word_chars(c: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"{WORD_CHAR}+"), 0)


def ngrams(tokens: Column, n: int = 5) -> Column:
    """The distinct n-grams of an array, each joined by blanks, in order of first appearance."""
    steps = lambda t: F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1)))
    grams = lambda t: F.when(F.size(t) >= n, F.array_distinct(F.transform(steps(t), lambda i: F.array_join(F.slice(t, i, n), " ")))).otherwise(F.array().cast("array<string>"))
    return let(tokens, grams)


#: Places in an array that fit in the low bits of a hash.
_PLACE = 1 << 20


def mattr(tokens: Column, window: int = 50) -> Column:
    """Moving-average type-token ratio; the plain ratio if there is one window at most; 0 without tokens."""

    # all tokens of all windows, less those whose word comes again within the window; sorting brings occurrences together
    def repeats(r: Column, n: Column, pair: Callable[[Column, Column, Column], Column], at: Callable[[Column], Column]) -> Column:
        both = lambda x, y: F.when(at(y) - at(x) < window, F.least(at(x), n - window) - F.greatest(at(y) - (window - 1), F.lit(0)) + 1).otherwise(F.lit(0))
        return F.aggregate(F.zip_with(r, F.slice(r, F.lit(2), n), lambda x, y: pair(x, y, both(x, y))), F.lit(0).cast("long"), lambda a, x: a + x)

    def ratio(t: Column) -> Column:
        n = F.size(t)
        # by hashes and places in one number, which sort fast; null if words of one hash differ, then by the words themselves
        place = lambda x: x.bitwiseAND(F.lit(_PLACE - 1)).cast("int")
        same = lambda x, y: x.bitwiseAND(F.lit(-_PLACE)) == y.bitwiseAND(F.lit(-_PLACE))
        equal = lambda x, y: F.get(t, place(x)) == F.get(t, place(y))
        hashed = lambda: F.sort_array(F.transform(t, lambda w, i: F.xxhash64(w).bitwiseAND(F.lit(-_PLACE)).bitwiseOR(i.cast("long"))))
        fast = F.when(n <= _PLACE, let(hashed(), lambda r: repeats(r, F.size(r), lambda x, y, k: F.when(same(x, y), F.when(equal(x, y), k)).otherwise(F.lit(0)), place)))
        placed = F.sort_array(F.transform(t, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        plain = let(placed, lambda r: repeats(r, F.size(r), lambda x, y, k: F.when(x["w"] == y["w"], k).otherwise(F.lit(0)), lambda x: x["i"]))
        windows = F.greatest(n - (window - 1), F.lit(1))
        average = (windows.cast("long") * F.lit(window) - F.coalesce(fast, plain)) / (windows * F.lit(float(window)))
        return F.when(n == 0, F.lit(0.0)).when(n <= window, F.size(F.array_distinct(t)) / n).otherwise(average)

    return let(tokens, ratio)


def members(tokens: Column, allowed: Sequence[str]) -> Column:
    """How many elements of tokens are in a fixed list."""
    return F.size(F.filter(tokens, lambda w: w.isin(*sorted(set(allowed)))))


def detect_language(c: Column) -> Column:
    """en if English stop-words outnumber Spanish ones, else es."""
    tokens = lower_words(c)
    return F.when(members(tokens, L.STOP_EN) > members(tokens, L.STOP_ES), F.lit("en")).otherwise(F.lit("es"))


IBERIAN = rf"(?iu)(?<!{WORD_CHAR})(?:{'|'.join(L.IBERIAN_WORDS)})(?!{WORD_CHAR})|(?:{'|'.join(L.IBERIAN_ENDINGS)})(?!{WORD_CHAR})|(?<!{WORD_CHAR})[ld]'(?={WORD_CHAR})"


def is_spanish(c: Column, least: int = 50) -> Column:
    """At least `least` tokens, over a fifth of them Spanish stop-words, under 3 % English ones and 1 % marks of neighbours."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-záéíóúñü]+"), 0)
    n = F.greatest(F.size(tokens), F.lit(1))
    other = F.regexp_count(F.coalesce(c, F.lit("")), F.lit(IBERIAN))
    return (F.size(tokens) >= least) & (members(tokens, L.CORPUS_ES) / n > 0.2) & (members(tokens, L.CORPUS_EN) / n < 0.03) & (other / n < 0.01)


def phrase_pattern(lexicon: L.Lexicon) -> str:
    return "(?iu)(?:" + "|".join(f"(?:{p})" for p in lexicon.phrases) + ")"


def connector_pattern(lexicon: L.Lexicon) -> str:
    return f"(?iu)^(?:{'|'.join(lexicon.connectors)})(?!{WORD_CHAR})"


def phrase_hits(sentence: Column, lexicon: L.Lexicon) -> Column:
    """The lexicon phrases in a sentence, left to right, without overlap."""
    return F.regexp_extract_all(sentence, F.lit(phrase_pattern(lexicon)), 0)


def connector(sentence: Column, lexicon: L.Lexicon) -> Column:
    """The connector that a sentence starts with; null without one."""
    return F.nullif(F.regexp_extract(sentence, connector_pattern(lexicon), 0), F.lit(""))


def by_language(lang: Column, make, lexicons: dict[str, L.Lexicon] | None = None) -> Column:
    """make(lexicon) for the row's language; Spanish where no lexicon is known."""
    lexicons = L.LEXICONS if lexicons is None else lexicons
    out = make(lexicons["es"])
    for name, lexicon in lexicons.items():
        if name != "es":
            out = F.when(lang == name, make(lexicon)).otherwise(out)
    return out


def asks(c: Column) -> Column:
    """Number of ? and !."""
    return F.length(c) - F.length(F.replace(F.replace(c, F.lit("?"), F.lit("")), F.lit("!"), F.lit("")))


def slice_text(c: Column, start: Column, end: Column) -> Column:
    """Characters from start (from 0) up to end."""
    return F.substring(c, start + 1, end - start)


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(blank_words(c), 1, n), " ")


def cut_at_sentence(c: Column, n: int = 200) -> Column:
    """The first n words, cut back to the last sentence end if that lies beyond half of them in characters; a text of n words or fewer as it is."""
    head = first_words(c, n)
    # from the back, the first " " that follows an end mark; its place from the front is the sentence's length
    back = F.least(*[F.when(F.instr(F.reverse(head), F.lit(e)) > 0, F.instr(F.reverse(head), F.lit(e))) for e in (" .", " ?", " !")])
    at = F.length(head) - back
    return F.when(F.size(blank_words(c)) <= n, c).when(at - 1 > F.length(head) / 2, F.substring(head, F.lit(1), at)).otherwise(head)


def clean_generated(c: Column) -> Column:
    """A model's answer without reasoning, preamble lines, loose titles, marks of emphasis and bullets."""
    plain = F.split(strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", "")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1)
    keeps = lambda line: ~(line.rlike(L.PREAMBLE_LINE) | ((count_blank_words(line) <= 12) & ~F.regexp_replace(line, rf"[{WS}]+\z", "").rlike(r"[.:]\z")))
    first = F.array_position(F.transform(plain, keeps), True)
    text = F.when(first > 0, F.array_join(F.slice(plain, first.cast("int"), F.size(plain)), "\n")).otherwise(F.lit(""))
    for pattern, new in ((r"(?m)\*\*|__|^#+[\s\x{85}\p{Z}]*", ""), (r"(?m)^[\s\x{85}\p{Z}]*[-*•][\s\x{85}\p{Z}]+", ""), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, new)
    return strip(text)


def clean_paraphrase(c: Column) -> Column:
    return strip(F.replace(F.regexp_replace(strip(c), L.PARAPHRASE_PREFIX, ""), F.lit("**"), F.lit("")))


@lru_cache(maxsize=1)
def _low_references() -> dict[str, str]:
    """Numeric references below 160 whose character is not the numbered one, by number."""
    return {str(k): html.unescape(f"&#{k};") for k in range(160) if html.unescape(f"&#{k};") != chr(k)}


def unescape(c: Column) -> Column:
    """Character references, named and numeric, as browsers read them; each once, so nothing is unescaped twice."""
    legacy = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))

    def numbered(n: Column) -> Column:
        plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        none = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        low = F.when(n < 160, F.try_element_at(_table(_low_references()), n.cast("string")))
        return F.coalesce(low, F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd")).when(none, F.lit("")).otherwise(plain))

    def reference(part: Column) -> Column:
        after = lambda mark: F.substring(part, F.length(mark) + 1, F.length(part))
        mark = F.regexp_extract(part, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)
        digits = F.regexp_extract(part, r"^#[xX]?0*([0-9a-fA-F]{0,8})", 1)
        number = F.when(part.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.regexp_extract(digits, "^[0-9]*", 0))
        named = F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};?", 0)
        short = F.regexp_extract(part, f"^(?:{legacy})", 0)
        by_name = lambda mark: F.concat(F.try_element_at(_table(dict(html5)), mark), after(mark))
        by_number = F.concat(numbered(F.coalesce(number.try_cast("long"), F.lit(0).cast("long"))), after(mark))
        return F.when(part.startswith("#"), F.when(mark != "", by_number)).otherwise(F.coalesce(F.when(named != "", by_name(named)), F.when(short != "", by_name(short))))

    parts = F.transform(F.split(c, "&", -1), lambda part, k: F.when(k == 0, part).otherwise(F.coalesce(reference(part), F.concat(F.lit("&"), part))))
    return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)


def contains_any(c: Column, *parts: str) -> Column:
    """Whether a text holds any of parts, whatever its case; null is the empty text."""
    text = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, stripped."""
    return strip(F.regexp_replace(c, rf"[{WS}]+", " "))


def plain_abstract(c: Column) -> Column:
    """An abstract without tags and entities; all of its words stay."""
    return squeeze(let(F.regexp_replace(c, "<[^>]+>", " "), unescape))


def clean_abstract(c: Column) -> Column:
    """An abstract without tags, entities, its heading, and what follows in other languages: for a corpus."""
    plain = F.regexp_replace(let(F.regexp_replace(c, "<[^>]+>", " "), unescape), L.ABSTRACT_HEADING, "")
    return squeeze(F.element_at(F.split(plain, L.ABSTRACT_TAIL, 2), 1))


def wiki_residue(c: Column) -> Column:
    """Without footnote marks, citation requests and zero-width spaces."""
    return F.regexp_replace(c, r"\[\d+\]|\[cita requerida\]|\x{200B}", "")


def wiki_url(title: Column, lang: Column | str = "es") -> Column:
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9.-]+", "_")


def highlight(c: Column, lexicon: L.Lexicon) -> Column:
    return F.regexp_replace(c, phrase_pattern(lexicon), "<mark>$0</mark>")


def is_reference(c: Column) -> Column:
    """Whether a paragraph is a bibliography entry."""
    return c.rlike(L.REFERENCE_LINE)


def without_references(paragraphs: Column) -> Column:
    """An array of paragraphs as one text, without empty ones and bibliography entries."""
    return F.array_join(F.filter(paragraphs, lambda p: (p != "") & ~is_reference(p)), "\n\n")


def index_words(c: Column) -> Column:
    """The inverted index of a text: a map of what white space separates to its positions, in the row."""
    places = F.sort_array(F.transform(blank_words(c), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.map_from_entries(F.transform(runs(places, lambda x: x["w"]), lambda own: F.struct(F.get(own, F.lit(0))["w"].alias("key"), F.transform(own, lambda x: x["i"]).alias("value"))))


def unindex(positions: Column) -> Column:
    """The text of an inverted index (map of word to positions); of words at one place the last in map order stays."""
    flat = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ranked = F.sort_array(F.transform(flat, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w"))))
    last = let(ranked, lambda r: F.filter(r, lambda x, i: (i == F.size(r) - 1) | (F.get(r, i + 1)["p"] != x["p"])))
    return F.array_join(F.transform(last, lambda x: x["w"]), " ")


#: Sentence ends: a run of end marks with closers, at white space or the end. A full stop after an abbreviation or a
#: single letter ends nothing, nor one between digits that one blank separates.
_BEFORE = rf"(?:^|[^\p{{L}}\p{{N}}_])"
_DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
_CLOSERS = r"""["'»”)\]]*"""
SENTENCE_END = (
    rf"(?iu)(?=[.!?…])(?<![.!?…])(?!(?=\.)(?<={_BEFORE}(?:{'|'.join(a for a in L.ABBREVIATIONS if '.' not in a)}|\p{{L}})\n?))"
    rf"(?!(?=\.[.!?…]*{_CLOSERS}[{WS}]{_DIGIT})(?<={_BEFORE}{_DIGIT}{{1,40}}\n?))[.!?…]+{_CLOSERS}(?=[{WS}]|\z)"
)
_SENTENCE, _PARAGRAPH = "\x01", "\x02"


def paragraphs(c: Column) -> Column:
    """The parts between empty lines."""
    return F.split(c, rf"\n[{WS}]*\n", -1)


def sentences(c: Column) -> Column:
    """Array of (paragraph, start, end, text): offsets are code points of c, text is stripped, empty ones are left out.

    One regular expression marks the ends and splits follow the marks, so nothing leaves the row.
    """
    # marks must not occur in the text itself
    clean = let(c, lambda t: F.when(t.contains(_SENTENCE) | t.contains(_PARAGRAPH), F.translate(t, _SENTENCE + _PARAGRAPH, "\x03\x03")).otherwise(t))
    marked = F.regexp_replace(clean, SENTENCE_END, f"$0{_SENTENCE}")
    marked = F.regexp_replace(marked, rf"(\n[{WS}]*\n)", f"{_PARAGRAPH}$1")
    parts = F.flatten(F.transform(F.split(marked, _PARAGRAPH, -1), lambda p, i: F.transform(F.split(p, _SENTENCE, -1), lambda s: F.struct(i.alias("paragraph"), s.alias("raw")))))

    def place(p: Column, end: Column) -> Column:
        start = lambda x, i: F.get(end, i) - F.length(F.ltrim(x["raw"], F.lit(BLANKS)))
        placed = F.transform(p, lambda x, i: F.struct(x["paragraph"].alias("paragraph"), start(x, i).alias("start"), strip(x["raw"]).alias("text")))
        return F.filter(placed, lambda s: s["text"] != "")

    kept = let(parts, lambda p: let(running(F.transform(p, lambda x: F.length(x["raw"]))), lambda e: place(p, e)))
    return F.transform(kept, lambda s: F.struct(s["paragraph"].alias("paragraph"), s["start"].alias("start"), (s["start"] + F.length(s["text"])).alias("end"), s["text"].alias("text")))
