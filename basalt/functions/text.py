"""Text analysis as column expressions: tokens, stems, analyzers, query matching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that carry no search meaning.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can "
    "to of in for on with at by from as into through during before after and but or not no if then than so that this "
    "it its i me my we our you your he him his she her they them their what which who whom"
).split()

#: Suffixes by language, in the order tried. A word that ends in one of the suffixes and has
#: more bytes than the number beside them loses the suffix and gets the ending. Only the first rule that
#: applies is used.
SUFFIXES: dict[str, list[tuple[str, int, str]]] = {
    "english": [
        ("ies", 4, "y"), ("sses", 0, "ss"), ("ness ment", 5, ""), ("tion", 5, "t"), ("ation", 6, ""), ("ing", 5, ""),
        ("ed ly er", 4, ""), ("est", 5, ""), ("s", 3, ""),
    ],
    "german": [("ungen", 6, ""), ("ung", 4, ""), ("heit keit isch lich igen", 5, ""), ("en er es", 3, ""), ("e", 3, "")],
    "french": [("euses ement", 6, ""), ("tion", 5, "t"), ("ment euse", 5, ""), ("eux ant", 4, ""), ("er es", 3, ""), ("e s", 3, "")],
    "spanish": [("amente", 7, ""), ("mente iendo", 6, ""), ("ador ando", 5, ""), ("ado ido", 4, ""), ("ión", 5, ""), ("ar er ir es", 3, ""), ("s", 3, "")],
    "italian": [("mente zione", 6, ""), ("ando endo", 5, ""), ("ato ito are ere ire", 4, ""), ("ia ie", 3, ""), ("i e", 3, "")],
    "portuguese": [("mente", 6, ""), ("ando endo indo", 5, ""), ("ado ido", 4, ""), ("ar er ir os as", 3, ""), ("s", 3, "")],
}

Tokens = Column
Stage = Callable[[Column], Column]


def stem(word: Column, language: str = "english") -> Column:
    """The word without its ending, by the language's suffix rules."""
    found = None
    for suffixes, least, ending in SUFFIXES[language]:
        for suffix in suffixes.split():
            hit = word.endswith(suffix) & (F.octet_length(word) > least)
            if suffix == "s" and language in ("english", "french"):
                hit = hit & ~word.endswith("ss")
            cut = F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(ending))
            if (language, suffix) == ("english", "ing"):  # what is left loses such a last consonant, too
                cut = F.when((F.octet_length(cut) > 3) & cut.rlike("[bdglmnprt]$"), F.left(cut, F.length(cut) - 1)).otherwise(cut)
            found = F.when(hit, cut) if found is None else found.when(hit, cut)
    return found.otherwise(word)


def words(text: Column) -> Tokens:
    """Runs of letters, digits and apostrophes, without apostrophes at their ends, in lower case."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[^\p{IsAlphabetic}\p{N}']+")
    parts = F.transform(parts, lambda w: F.lower(F.trim(w, F.lit("'"))))
    return F.filter(parts, lambda w: w != "")


def kept_words(text: Column) -> Tokens:
    """The words that are no stop words."""
    return F.filter(words(text), lambda w: ~w.isin(STOP_WORDS))


def tokens(text: Column, language: str = "english") -> Tokens:
    """Stems of the words that are no stop words, in order; a token's position is its index."""
    return F.transform(kept_words(text), lambda w: stem(w, language))


def stems_to(word: Column, term: str, language: str = "english") -> Column:
    """Whether the word's stem is `term`. A stem is its word up to the ending that a rule gives, so only words that begin as
    the term does are stemmed."""
    most = max(len(ending) for rules in SUFFIXES[language] for ending in rules[2:])
    return F.when(word.startswith(term[: max(0, len(term) - most)]), stem(word, language) == term).otherwise(False)


# Analyzer stages: text to text, text to tokens, tokens to tokens.


def html_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]*>", "")


def mapping(pairs: dict[str, str]) -> Stage:
    def run(text: Column) -> Column:
        for a, b in pairs.items():
            text = F.replace(text, F.lit(a), F.lit(b))
        return text

    return run


def ascii_folding(text: Column) -> Column:
    return F.translate(text, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def whitespace_tokens(text: Column) -> Tokens:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ngram_tokens(least: int, most: int) -> Stage:
    """Substrings of least to most characters, by start, then length."""

    def run(text: Column) -> Tokens:
        n = F.length(text)
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        sizes = F.sequence(F.lit(least), F.lit(most))
        cut = F.transform(starts, lambda i: F.transform(F.filter(sizes, lambda k: i + k - 1 <= n), lambda k: F.substring(text, i, k)))
        return F.flatten(cut)

    return run


def edge_ngram_tokens(least: int, most: int) -> Stage:
    def run(text: Column) -> Tokens:
        sizes = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda k: k <= F.length(text))
        return F.transform(sizes, lambda k: F.left(text, k))

    return run


def lowercase(t: Tokens) -> Tokens:
    return F.transform(t, F.lower)


def stop_filter(listed: Sequence[str] = STOP_WORDS) -> Stage:
    return lambda t: F.filter(t, lambda w: ~w.isin(list(listed)))


def stem_filter(language: str = "english") -> Stage:
    return lambda t: F.transform(t, lambda w: stem(w, language))


def synonym_filter(groups: dict[str, Sequence[str]]) -> Stage:
    """Each token, followed by its synonyms."""

    def run(t: Tokens) -> Tokens:
        table = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        none = F.array().cast("array<string>")
        return F.flatten(F.transform(t, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(table, w), none))))

    return run


def length_filter(least: int, most: int) -> Stage:
    return lambda t: F.filter(t, lambda w: F.length(w).between(least, most))


def analyzer(*stages: Stage) -> Stage:
    def run(text: Column) -> Column:
        for s in stages:
            text = s(text)
        return text

    return run


standard_english = analyzer(words, stop_filter(), stem_filter())


# Matching one text with one query.


def ts_match(text: Column, query: Column) -> Column:
    """Whether any term of the query is in the text."""
    return F.arrays_overlap(tokens(text), tokens(query))


def ts_rank(text: Column, query: Column) -> Column:
    """Sum over the query's terms of the share of the text's tokens that are that term."""
    t, q = tokens(text), tokens(query)
    hits = F.aggregate(q, F.lit(0), lambda s, w: s + F.size(F.filter(t, lambda x: x == w)))
    return F.when(F.size(t) > 0, hits / F.size(t)).otherwise(0.0)


def to_tsvector(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def to_tsquery(text: Column) -> Column:
    return F.array_join(tokens(text), " & ")


def ts_headline(text: Column, query: Column) -> Column:
    """The text's words between single spaces, those with a stem of the query in <b></b>."""
    q = tokens(query)
    parts = whitespace_tokens(text)
    return F.array_join(F.transform(parts, lambda w: F.when(F.arrays_overlap(tokens(w), q), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)), " ")


def highlight(text: Column, query: Column, context: int = 5) -> Column:
    """The words within `context` words of a match, stretches joined by ` ... `; without a match, the text."""
    q, parts = tokens(query), whitespace_tokens(text)
    at = F.filter(F.transform(parts, lambda w, i: F.when(F.arrays_overlap(tokens(w), q), i)), lambda i: i.isNotNull())
    shown = lambda i: F.exists(at, lambda a: F.abs(a - i) <= context)
    gap = lambda i: ~shown(i - 1) & (i > F.element_at(at, 1) + context)
    near = F.transform(parts, lambda w, i: F.when(shown(i), F.when(gap(i), F.concat(F.lit("... "), w)).otherwise(w)))
    near = F.array_join(F.filter(near, lambda w: w.isNotNull()), " ")
    return F.when(F.size(at) > 0, near).otherwise(text)
