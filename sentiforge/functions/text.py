"""Column functions for social-media text (JVM-side, whole-stage codegen).

Every function takes and returns a ``Column`` so it composes inside one
projection; nothing here leaves the JVM except the optional stemmer.

Regex parity: the rules below are written in Python ``re`` notation, where
``\\w``/``\\s``/``\\S`` are Unicode-aware.  Java and RE2 read them as ASCII,
so ``unicode_regex`` rewrites them into explicit Unicode classes that Java
(Spark) and RE2 (the SQL oracle) read the same way.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, written so that Java and RE2 agree on it.
SPACE = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
NONSPACE = r"[^\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

_CLASS_MAP = {r"\w": WORD, r"\s": SPACE, r"\S": NONSPACE}


def unicode_regex(py_pattern: str) -> str:
    """Rewrite ``\\w``, ``\\s``, ``\\S`` of a Python pattern into Unicode classes."""
    return re.sub(r"\\[wsS]", lambda m: _CLASS_MAP[m.group(0)], py_pattern)


# ---------------------------------------------------------------------------
# The three tweet-cleaning variants.  Each is an ordered list of
# (pattern in Python notation, replacement); order matters because '@' and
# '#' inside URLs are rewritten before the URL is cut.
# ---------------------------------------------------------------------------
MARK_RULES = [  # variant A: mark mentions / hashtags with a word and a blank
    (r"RT\s@\w+:", "Retweet"),
    (r"@", "mention "),
    (r"#", "hashtag "),
    (r"http\S+", ""),
]
GLUE_RULES = [  # variant B: glue the marker word to the name
    (r"RT\s@\s\w+", ""),
    (r"@", "mention"),
    (r"#", "hashtag"),
    (r"http\S+", ""),
]
STRIP_RULES = [  # variant C: delete retweet marks, mentions, hashtags and URLs
    (r"RT\s@\w+:", ""),
    (r"@\w+ ?", ""),
    (r"RT", ""),
    (r"#\w+ ?", ""),
    (r"http\S+", ""),
]

# English stop-word list used by the full normaliser (the
# common 179-word list of the NLTK corpus, in its published order).
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its "
    "itself they them their theirs themselves what which who whom this that that'll "
    "these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down "
    "in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don don't should should've now d ll m o re ve y "
    "ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn "
    "hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't "
    "shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# ASCII punctuation (Python's string.punctuation) as one regex class.
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
DIGITS = r"\p{Nd}"


def apply_rules(col: Column, rules) -> Column:
    for pattern, repl in rules:
        col = F.regexp_replace(col, F.lit(unicode_regex(pattern)), F.lit(repl))
    return col


def clean_mark(col: Column) -> Column:
    """Variant A: ``RT @x:`` -> ``Retweet``, ``@`` -> ``mention ``, ``#`` -> ``hashtag ``, URLs cut."""
    return apply_rules(col, MARK_RULES)


def clean_glue(col: Column) -> Column:
    """Variant B: ``RT @ x`` cut, ``@`` -> ``mention``, ``#`` -> ``hashtag``, URLs cut."""
    return apply_rules(col, GLUE_RULES)


def clean_strip(col: Column) -> Column:
    """Variant C regex part: retweet marks, mentions, ``RT`` anywhere, hashtags and URLs removed."""
    return apply_rules(col, STRIP_RULES)


def split_ws(col: Column) -> Column:
    """``str.split()``: split on Unicode blanks, empty pieces dropped."""
    return F.filter(F.split(col, SPACE + "+"), lambda t: t != F.lit(""))


def normalise(col: Column, stem: bool = False) -> Column:
    """Full normaliser: squeeze blanks, lower-case, drop digits and ASCII
    punctuation, drop English stop-words, optionally Porter-stem, re-join.

    Our spec (the reference calls a library): the steps run in this order
    and tokens are re-joined with one blank.
    """
    t = F.lower(col)
    t = F.regexp_replace(t, F.lit(DIGITS), F.lit(""))
    t = F.regexp_replace(t, F.lit(PUNCT_CLASS), F.lit(""))
    toks = F.filter(split_ws(t), lambda w: ~w.isin(*STOP_WORDS))
    if stem:
        from sentiforge.functions.stem import porter_stem_tokens
        toks = porter_stem_tokens(toks)
    return F.array_join(toks, " ")


def word_tokens(col: Column) -> Column:
    """Vectoriser tokens: lower-case, maximal runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD + "{2,}"), 0)


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by adjacent pairs joined by a blank (n-gram range 1..2).

    ``zip_with`` of the array with itself shifted by one: the token array is
    an argument (evaluated once), never referenced from inside the lambda,
    which would re-evaluate the whole token expression per element."""
    n = F.size(tokens)
    m = F.greatest(n - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, 1, m), F.slice(tokens, 2, m), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, pairs)


def _accent_table() -> tuple[str, str]:
    """Derived by rule for all of Unicode: a character whose decomposition without
    combining marks is one character maps to it, a combining mark to nothing.
    Below U+0250 only canonical decompositions count, above compatible ones too.
    Deleted characters stand last, where ``translate`` finds no partner."""
    one, gone = [], []
    for cp in [*range(0xC0, 0xD800), *range(0xE000, 0x20000)]:
        ch = chr(cp)
        form = "NFD" if cp < 0x250 else "NFKD"
        base = "".join(c for c in unicodedata.normalize(form, ch) if not unicodedata.combining(c))
        if not base:
            gone.append(ch)
        elif base != ch and len(base) == 1:
            one.append((ch, base))
    return "".join(ch for ch, _ in one) + "".join(gone), "".join(base for _, base in one)


ACCENT_FROM, ACCENT_TO = _accent_table()
_LIGATURES = {chr(cp): unicodedata.normalize("NFKD", chr(cp)) for cp in range(0xFB00, 0xFB07)}


def strip_accents(col: Column) -> Column:
    """Drop diacritics and combining marks of any script with one ``translate`` (no
    Python worker); Latin ligatures are spelled out.  Other characters that stand
    for several (Hangul syllables, fractions) stay as they are."""
    spelled = col
    for ch, letters in _LIGATURES.items():
        spelled = F.replace(spelled, F.lit(ch), F.lit(letters))
    return F.translate(F.when(col.rlike("[\ufb00-\ufb06]"), spelled).otherwise(col), ACCENT_FROM, ACCENT_TO)


def squeezed(col: Column) -> Column:
    """``' ' + lower text, each run of white space one blank + ' '``: what character n-grams are cut from."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(col), SPACE + "+", " "), F.lit(" "))


def char_ngrams(col: Column, n: int = 3) -> Column:
    """Overlapping character n-grams (code points) of ``' ' + squeezed lower text + ' '``.

    One linear regex scan: a zero-width lookahead at every position captures
    the next n characters (``substring`` per position would rescan the
    UTF-8 string from its start each time)."""
    return F.regexp_extract_all(squeezed(col), F.lit("(?s)(?=(.{%d}))" % n), 1)


def json_field(col: Column, path: str) -> Column:
    return F.get_json_object(col, path)


# Pluggable tokenizers: name -> (text Column -> array<string> Column).
TOKENIZERS = {
    "whitespace": split_ws,
    "vectoriser": word_tokens,
    "lower_whitespace": lambda c: split_ws(F.lower(c)),
}


def tokens(col: Column, kind: str = "whitespace") -> Column:
    """Tokenise with a registered tokenizer (add entries to ``TOKENIZERS`` to plug one in)."""
    return TOKENIZERS[kind](col)
