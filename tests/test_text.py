"""Text functions against restatements of their rules in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill import lexicon as L
from glyphmill.functions import text as T


def column(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    return [r[1] for r in sorted(rows.select("i", make(F.col("t"))).collect())]


def split_by_tokens(text):
    """(paragraph, start, end, text) by a rule on single tokens: whether a sentence ends at a token depends on it and its neighbours only."""
    found = []
    at = 0
    for k, part in enumerate(re.split(r"(\n\s*\n)", text)):
        if k % 2 == 0:
            sizes = [len(t) for t in re.findall(r"\s+(?=\S|$)|\S+", part)]
            bounds = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
            ends = [b for a, b in zip(bounds, bounds[1:]) if closes(part, a, b)]
            for a, b in zip([0, *ends], [*ends, len(part)]):
                body = part[a:b].strip()
                if body:
                    start = at + a + part[a:b].index(body)
                    found.append((k // 2, start, start + len(body), body))
        at += len(part)
    return found


def closes(part, a, b):
    """Whether the token part[a:b] ends a sentence: it ends in marks and closers, and no full stop of an abbreviation, an initial or a number."""
    token, rest = part[a:b], part[b:]
    stem = re.sub(r"""[.!?…]+["'»”)\]]*\Z""", "", token)
    if stem == token or token.isspace():
        return False
    word = re.search(r"\w*\Z", stem)[0].lower()
    if not stem and part[:a].endswith("\n"):  # a mark at the start of a line follows the word that ends the line before
        word = re.search(r"\w*\Z", part[: a - 1])[0].lower()
    if not word or token[len(stem)] != ".":
        return True
    number = word.isdigit() and re.match(r"\s", rest) and rest[1:2].isdigit()
    return not (word in L.ABBREVIATIONS or (len(word) == 1 and word.isalpha()) or number)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Uno. Dos? ¡Tres! Cuatro", ["Uno.", "Dos?", "¡Tres!", "Cuatro"]),
        ("El Dr. Ruiz vio a J. Pérez. Sí.", ["El Dr. Ruiz vio a J. Pérez.", "Sí."]),
        ("Mide 3. 5 metros. Y 4. Más.", ["Mide 3. 5 metros.", "Y 4.", "Más."]),
        ("«Hola.» Adiós (bien). Fin…", ["«Hola.»", "Adiós (bien).", "Fin…"]),
        ("Son las 5.30. etc. y más", ["Son las 5.30.", "etc. y más"]),
        ("Primera\nlínea. Otra\n\nNueva", ["Primera\nlínea.", "Otra", "Nueva"]),
        ("", []),
        (" . ! ", [".", "!"]),
    ],
)
def test_sentences_of_given_texts(spark, text, want):
    assert [s.text for s in column(spark, [text], T.sentences)[0]] == want


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    parts = ["Dr", "Sra", "a", "hola", "mundo", "3", "5", "12", "etc", ".", "!", "?", "…", ")", '"', " ", " ", "  ", "\n", "\n\n", "\n \n", "»", "J", "é", "²", "_x", "pág", "No", "😀", "·"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_sentences_match_the_token_rule(spark):
    texts = random_texts(1500) + ["El Dr. Ruiz midió 3.5 m. ¿Seguro? Sí."]
    for text, got in zip(texts, column(spark, texts, T.sentences), strict=True):
        assert [tuple(s) for s in got] == split_by_tokens(text), text
        assert all(text[s.start : s.end] == s.text for s in got)


def test_normalize(spark):
    def rule(t):
        t = t.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()

    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab \t\n\r\xa0\x1c 　") for _ in range(30)) for _ in range(500)]
    assert column(spark, texts, T.normalize) == [rule(t) for t in texts]


def test_words_fold_and_blanks(spark):
    texts = ["Año-nuevo d'été x2 ñandú ÉL", "", "  ", "co-op's 12", "ﬁn"]
    assert column(spark, texts, T.words)[:4] == [["Año-nuevo", "d'été", "x", "ñandú", "ÉL"], [], [], ["co-op's"]]
    assert column(spark, texts, T.lower_words)[0] == ["año-nuevo", "d'été", "x", "ñandú", "él"]
    assert column(spark, texts, T.fold_tokens)[0] == ["ano", "nuevo", "d", "ete", "x2", "nandu", "el"]
    assert column(spark, ["a b\x1cc d", "", None], T.count_blank_words) == [4, 0, 0]


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 130])
def test_mattr(spark, n):
    rnd = random.Random(n)
    words = [rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(n)]
    want = 0.0 if not n else len(set(words)) / n if n <= 50 else sum(len(set(words[i : i + 50])) / 50 for i in range(n - 49)) / (n - 49)
    assert abs(column(spark, [" ".join(words)], lambda c: T.mattr(T.lower_words(c)))[0] - want) < 1e-12


def test_ngrams_of_short_and_repeating_texts(spark):
    grams = column(spark, ["a b c d", "a b c d e", "a a a a a a a", ""], lambda c: T.ngrams(T.fold_tokens(c)))
    assert [len(g) for g in grams] == [0, 1, 1, 0]


def test_language_and_spanish(spark):
    es = "La casa de la que se habla en el texto no es una casa más, y por eso los que la ven como algo para su familia la quieren. " * 4
    en = "The house is on the hill and it was not for us to have that view from this side of the town. " * 4
    assert column(spark, [es, en, ""], T.detect_language) == ["es", "en", "es"]
    assert column(spark, [es, en, "de la"], T.is_spanish) == [True, False, False]


def test_lexicons(spark):
    hits = column(spark, ["ADEMÁS, cabe destacar que no solo llueve sino también nieva.", "nada"], lambda c: T.phrase_hits(c, L.SPANISH))
    assert hits == [["ADEMÁS,", "cabe destacar", "no solo llueve sino también"], []]
    starts = column(spark, ["Sin embargo, sí.", "Sin embargos no.", "Overall good"], lambda c: T.connector(c, L.SPANISH))
    assert starts == ["Sin embargo", None, None]
    assert column(spark, ["A pivotal point"], lambda c: T.highlight(c, L.ENGLISH)) == ["A <mark>pivotal</mark> point"]


def test_cleaning(spark):
    raw = "<think>plan\nplan</think>\nClaro, aquí va:\n**Un título corto**\n\nEste es **el** texto.\n\n\n\n- Punto uno."
    assert column(spark, [raw], T.clean_generated) == ["Este es el texto.\nPunto uno."]
    assert column(spark, ["solo título", ""], T.clean_generated) == ["", ""]
    assert column(spark, ["Aquí tienes el párrafo: **Hola**"], T.clean_paraphrase) == ["Hola"]
    assert column(spark, ["<b>Resumen</b>: Uno  &amp; dos. Keywords: x"], T.clean_abstract) == ["Uno & dos."]
    assert column(spark, ["a[12] b[cita requerida]​"], T.wiki_residue) == ["a b"]
    assert column(spark, ["org/Model v1:2"], T.slug) == ["org_Model_v1_2"]


def test_cut_at_sentence(spark):
    text = "uno dos tres. cuatro cinco seis. siete ocho nueve diez"
    assert column(spark, [text], lambda c: T.cut_at_sentence(c, 8)) == ["uno dos tres. cuatro cinco seis."]
    assert column(spark, ["a. b c d e f g h i j"], lambda c: T.cut_at_sentence(c, 8)) == ["a. b c d e f g h"]
    assert column(spark, ["a b", ""], lambda c: T.cut_at_sentence(c, 8)) == ["a b", ""]


def test_references_are_dropped(spark):
    rows = spark.createDataFrame([(["Texto normal.", "García, A. B. (2020). Título.", ""],)], "p array<string>")
    assert rows.select(T.without_references(F.col("p"))).first()[0] == "Texto normal."


def test_inverted_index(spark):
    rows = spark.createDataFrame([({"hola": [0, 2], "mundo": [1]},), ({},)], "m map<string,array<int>>")
    assert [r[0] for r in rows.select(T.unindex(F.col("m"))).collect()] == ["hola mundo hola", ""]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 16, 17])
def test_running_sums(spark, n):
    x = [(k * 7) % 5 for k in range(n)]
    row = spark.createDataFrame([(x,)], "x array<int>").select(T.running(F.col("x"), 4).alias("r")).first()
    assert row.r == [sum(x[: k + 1]) for k in range(n)]
