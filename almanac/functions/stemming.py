"""English suffix stemming (the published Porter2 rules) of a frame of distinct words, as native column expressions.

Each rule is a column over the word so far, so a corpus is stemmed once per distinct word and joined back by word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words the published rules treat as exceptions.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
_KEEP = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_KEEP_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Suffix replacements of the two region-1 steps and removals of the region-2 step.
# Longer suffixes come first.
_STEP2 = (
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
)
_STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
    "al", "er", "ic",
)
_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_SHORT_END = f"(?:{_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$"
_HEADS = "^(?:gener|commun|arsen)"


def _cut(w: Column, suffix: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(suffix))


def _first_suffix(w: Column, rules: Sequence[tuple[str, Column]], otherwise: Column) -> Column:
    """What the rule of the first suffix that the word ends with makes of it."""
    out = otherwise
    for suffix, made in reversed(rules):
        out = F.when(w.endswith(suffix), made).otherwise(out)
    return out


def _after_first_syllable(w: Column) -> Column:
    """Length up to and with the first consonant behind a vowel; the whole length if there is none."""
    found = F.regexp_extract(w, f"^.*?{_VOWEL}{_OTHER}", 0)
    return F.when(found == "", F.length(w)).otherwise(F.length(found))


def stem_words(words: DataFrame, word: str = "word", out: str = "stem") -> DataFrame:
    """Adds the stem of every lower-case word.  Words of one or two letters stay."""
    w, r1, r2 = F.col("_w"), F.col("_r1"), F.col("_r2")
    head = F.regexp_extract(w, _HEADS, 0)
    in_r1 = lambda suffix: F.length(w) - len(suffix) >= r1
    in_r2 = lambda suffix: F.length(w) - len(suffix) >= r2
    short = lambda c: (F.length(c) <= r1) & c.rlike(_SHORT_END)
    df = words.withColumn("_w", F.regexp_replace(F.regexp_replace(F.col(word), "^y", "Y"), "([aeiouy])y", "$1Y"))
    df = df.withColumn("_r1", F.when(head != "", F.length(head)).otherwise(_after_first_syllable(w)))
    df = df.withColumn("_r2", r1 + _after_first_syllable(F.substring(w, r1 + 1, F.length(w))))

    # plurals
    ie = F.when(F.length(w) > 4, _cut(w, "es")).otherwise(_cut(w, "s"))
    ied = F.when(F.length(w) > 4, _cut(w, "ed")).otherwise(_cut(w, "d"))
    plural = F.when(w.rlike(f"{_VOWEL}.+s$"), _cut(w, "s")).otherwise(w)
    df = df.withColumn("_w", _first_suffix(w, [("sses", _cut(w, "es")), ("ied", ied), ("ies", ie), ("us", w), ("ss", w), ("s", plural)], w))
    kept = w.isin(*sorted(_KEEP_AFTER_PLURAL))
    df = df.withColumn("_done", kept)

    # past and progressive forms
    def without(suffix: str) -> Column:
        part = _cut(w, suffix)
        mended = (
            F.when(part.rlike("(?:at|bl|iz)$"), F.concat(part, F.lit("e")))
            .when(part.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.substring(part, F.lit(1), F.length(part) - 1))
            .when(short(part), F.concat(part, F.lit("e")))
            .otherwise(part)
        )
        return F.when(part.rlike(_VOWEL), mended).otherwise(w)

    eed = lambda suffix: F.when(in_r1(suffix), F.concat(_cut(w, suffix), F.lit("ee"))).otherwise(w)
    forms = [("eedly", eed("eedly")), ("eed", eed("eed"))] + [(x, without(x)) for x in ("ingly", "edly", "ing", "ed")]
    df = df.withColumn("_w", F.when(F.col("_done"), w).otherwise(_first_suffix(w, forms, w)))
    df = df.withColumn("_w", F.when(F.col("_done"), w).otherwise(F.regexp_replace(w, f"^(.+{_OTHER})[yY]$", "$1i")))

    # derivations
    def replaced(suffix: str, new: str) -> Column:
        fits = in_r1(suffix)
        if suffix == "ogi":
            fits = fits & w.endswith("logi")
        if suffix == "li":
            fits = fits & w.rlike("[cdeghkmnrt]li$")
        if suffix == "ative":
            fits = fits & in_r2(suffix)
        return F.when(fits, F.concat(_cut(w, suffix), F.lit(new))).otherwise(w)

    for step in (_STEP2, _STEP3):
        df = df.withColumn("_w", F.when(F.col("_done"), w).otherwise(_first_suffix(w, [(a, replaced(a, b)) for a, b in step], w)))

    def removed(suffix: str) -> Column:
        fits = in_r2(suffix) & w.rlike("[st]ion$") if suffix == "ion" else in_r2(suffix)
        return F.when(fits, _cut(w, suffix)).otherwise(w)

    df = df.withColumn("_w", F.when(F.col("_done"), w).otherwise(_first_suffix(w, [(a, removed(a)) for a in _STEP4], w)))
    last_e = F.when(in_r2("e") | (in_r1("e") & ~_cut(w, "e").rlike(_SHORT_END)), _cut(w, "e")).otherwise(w)
    last_l = F.when(in_r2("l") & w.endswith("ll"), _cut(w, "l")).otherwise(w)
    df = df.withColumn("_w", F.when(F.col("_done"), w).otherwise(_first_suffix(w, [("e", last_e), ("l", last_l)], w)))

    given = F.col(word)
    stem = F.when((F.length(given) <= 2) | given.isin(*sorted(_KEEP)), given)
    for a, b in _WHOLE.items():
        stem = stem.when(given == a, b)
    return df.withColumn(out, stem.otherwise(F.lower(w))).drop("_w", "_r1", "_r2", "_done")
