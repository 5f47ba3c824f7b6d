"""Text measures: scripts, degeneracy, refusal, folding, prices, tokens."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Cuts and limits of the coding rules.
SCRIPT_HIGH, SCRIPT_LOW = 0.60, 0.20
LOOP_REPEATS, LOOP_PERIOD, LOOP_SPAN, BAD_SHARE = 5, 60, 20, 0.10
BENGALI = "\\u0980-\\u09FF"
LATIN = "A-Za-z"
#: White space of any script, brackets with what they hold, and marks that may stand before a word.
BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
BRACKETS = r"\([^)]*\)|\[[^\]]*\]|（[^）]*）"
LEADING = "[\"'“‘(«\\[*–—•·-]*"


def fold_text(s: str | None) -> str | None:
    """Compatibility form without combining marks, a final bracket or outer blanks, case-folded.

    Only characters with a combining class go: vowel signs of Indic scripts have none and stay.
    """
    if s is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"\s*\([^()]*\)\s*$", "", plain).strip().casefold()


@pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it: Catalyst may copy a plain expression to each use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def script_ratio(text: Column, script: str = BENGALI, other: str = LATIN) -> Column:
    """Characters of a script among those of it and of another; 0 without either."""
    counts = F.struct(_count(text, f"[{script}]").alias("a"), _count(text, f"[{other}]").alias("b"))
    return let(counts, lambda c: F.when(c["a"] + c["b"] > 0, c["a"] / (c["a"] + c["b"])).otherwise(0.0))


def script_ratio_words(text: Column, script: str = BENGALI, other: str = LATIN) -> Column:
    """Words of which the script has at least half of the letters, among words with a letter of either; 0 without.

    The text is first reduced to its words' letters, one mark for each script, so that words are
    compared by lengths and not searched one by one.
    """
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, f"{BLANK}+", " "), f"[^ {script}{other}]+", ""), f"[{script}]", "\u0001")
    words = F.filter(F.split(marks, " "), lambda w: w != "")
    mine = lambda w: 2 * F.length(F.replace(w, F.lit("\u0001"), F.lit(""))) <= F.length(w)
    return let(words, lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, mine)) / F.size(ws)).otherwise(0.0))


def prose_ratio(text: Column, script: str = BENGALI, other: str = LATIN) -> Column:
    """script_ratio without bracketed parts, words with digits, and Latin words that begin with a capital.

    Capitalised Latin words are names; marks before the first letter do not hide it. If no letter is
    left, the ratio is that of the whole text.
    """
    flat = F.regexp_replace(F.regexp_replace(text, BRACKETS, " "), f"{BLANK}+", " ")
    prose = F.regexp_replace(flat, r"(?<![^ ])[^ ]*\p{Nd}[^ ]*", "")
    prose = F.regexp_replace(prose, rf"(?<![^ ])(?![^ ]*[{script}])(?=[^ ]*[{other}]){LEADING}\p{{Lu}}[^ ]*", "")
    return let(prose, lambda p: F.when(p.rlike(f"[{script}{other}]"), script_ratio(p, script, other)).otherwise(script_ratio(text, script, other)))


def script_class(ratio: Column) -> Column:
    return F.when(ratio >= SCRIPT_HIGH, "bn").when(ratio <= SCRIPT_LOW, "latin").otherwise("mixed")


def degenerate(text: Column) -> Column:
    """empty, unreadable_chars or loop:period<p>x<n> (a unit that ends the text n times or more), else null.

    A unit of p characters, not all blank, must repeat to the text's end at least LOOP_REPEATS times
    and over LOOP_SPAN characters, white space being one space. The shortest unit is named.
    """
    def loop(flat: Column) -> Column:
        found = []
        for period in range(1, LOOP_PERIOD + 1):
            times = max(LOOP_REPEATS, -(-LOOP_SPAN // period))
            unit = F.substring(flat, -period, period)
            same = (F.length(flat) >= period * times) & (F.trim(unit) != "") & (F.substring(flat, -period * times, period * times) == F.repeat(unit, times))
            found.append(F.when(same, F.lit(f"loop:period{period}x{times}")))
        return F.coalesce(*found)

    def reason(body: Column) -> Column:
        bad = _count(body, r"[\uFFFD[\p{Cc}&&[^\n\r\t]]]")
        # a loop's tail has at most LOOP_PERIOD * LOOP_REPEATS characters: only those are compared
        return (F.when(body == "", "empty").when(bad > BAD_SHARE * F.length(body), "unreadable_chars")
                .otherwise(let(F.trim(F.regexp_replace(body, f"{BLANK}+", " ")), lambda flat: let(F.substring(flat, -LOOP_PERIOD * LOOP_REPEATS, LOOP_PERIOD * LOOP_REPEATS), loop))))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANK}+|{BLANK}+$", ""), reason)


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first (name, pattern) rule that matches, else null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules]) if rules else F.lit(None).cast("string")


def persona(text: Column, vendors: list[tuple[str, str]], generic: str) -> Column:
    """The first vendor named, else generic if the text speaks of itself as a model, else null."""
    return F.coalesce(first_rule(text, vendors), F.when(text.rlike(generic), "generic"))


# Spellings of currencies after lower-casing.
CURRENCIES = {"BDT": ("bdt", "taka", "tk", "৳", "টাকা"), "USD": ("usd", "dollar", "dollars"), "other": ("other",), "unstated": ("unstated",)}


def fold_currency(token: Column) -> Column:
    """BDT, USD, unstated or other, which is any other word of letters; null for anything else."""
    t = F.lower(F.trim(token))
    known = None
    for name, spellings in CURRENCIES.items():
        known = F.when(t.isin(*spellings), name) if known is None else known.when(t.isin(*spellings), name)
    return known.when(t.rlike(r"^\p{L}+$"), "other")


def price(line: Column) -> Column:
    """struct(amount, currency) of a line like '38000 BDT': a number, blanks and one currency word; null for any other line."""
    form = r"^([0-9]+(?:\.[0-9]+)?)\s+(\S{1,14})$"
    number, unit = (F.regexp_extract(F.trim(line), form, k) for k in (1, 2))
    currency = F.when(number != "", fold_currency(unit))
    return F.when(currency.isNotNull(), F.struct(number.cast("double").alias("amount"), currency.alias("currency")))


def lines(text: Column) -> Column:
    """Non-blank trimmed lines."""
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), F.trim), lambda x: x != "")


BENGALI_DIGITS, DIGITS = "০১২৩৪৫৬৭৮৯", "0123456789"


def digit_runs(text: Column) -> Column:
    """Numbers of a text with Bengali digits as Western ones and thousands separators gone."""
    plain = F.regexp_replace(F.translate(text, BENGALI_DIGITS, DIGITS), r"(?<=[0-9]),(?=[0-9])", "")
    return F.regexp_extract_all(plain, F.lit("([0-9]+)"), 1)


def traceable(amount: Column, text: Column) -> Column:
    """Whether a whole amount stands in a text."""
    return F.array_contains(digit_runs(text), amount.cast("long").cast("string"))


def tokens(text: Column) -> Column:
    """Distinct lower-cased words of letters and digits, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_script(text: Column, script: str = BENGALI) -> Column:
    return text.rlike(f"[{script}]")


def alias_pattern(alias: str) -> str:
    """A regular expression for an alias as a word: Latin ones may take 's or s, others a short case ending."""
    body = re.escape(alias)
    if re.search(r"[ঀ-৿]", alias):
        return f"(?<![\\u0980-\\u09FF]){body}(?:[\\u0980-\\u09FF]{{0,3}})(?![\\u0980-\\u09FF])"
    return f"(?i)(?<![A-Za-z0-9]){body}(?:'s|s)?(?![A-Za-z0-9])"


def target(arm: Column) -> Column:
    """The language an arm asks for."""
    return F.when(arm.isin("en", "bn"), arm).otherwise("banglish")


def conformity(arm: Column, script: Column) -> Column:
    """struct(language, pending, conforming) from the script alone.

    The script decides between Bengali and Latin; which Latin language it is, and any mixed answer,
    is pending until the extractor has spoken.
    """
    none = F.lit(None)
    return (F.when(script == "bn", F.struct(F.lit("bn").alias("language"), F.lit(False).alias("pending"), (arm == "bn").alias("conforming")))
            .when((script == "latin") & (arm == "bn"), F.struct(none.cast("string").alias("language"), F.lit(False).alias("pending"), F.lit(False).alias("conforming")))
            .otherwise(F.struct(none.cast("string").alias("language"), F.lit(True).alias("pending"), none.cast("boolean").alias("conforming"))))


def resolve_language(arm: Column, script: Column, extracted: Column) -> Column:
    """struct(language, conforming, reason): the script's word on Bengali or Latin, else the extractor's.

    reason is set where the two disagree on that boundary; conforming is null while undecided.
    """
    wanted, none = target(arm), F.lit(None)
    out = lambda language, conforming, reason: F.struct(language.cast("string").alias("language"), conforming.cast("boolean").alias("conforming"), reason.cast("string").alias("reason"))
    against = F.when(extracted != "bn", F.concat(F.lit("script=bn but extractor="), extracted))
    no_bn = F.when(arm == "bn", F.lit(False))
    return (F.when(script == "bn", out(F.lit("bn"), wanted == "bn", against))
            .when((script == "latin") & (extracted == "bn"), out(F.lit("latin_unresolved"), no_bn, F.lit("script=latin but extractor=bn")))
            .when((script == "latin") & extracted.isNull(), out(none, no_bn, none))
            .when(script == "latin", out(extracted, F.when(arm == "bn", F.lit(False)).otherwise(extracted == wanted), none))
            .when(extracted.isNull(), out(F.lit("mixed"), none, none))
            .otherwise(out(extracted, extracted == wanted, none)))


def outcome(degenerate_: Column, refusal: Column, extracted: Column, content: Column, pending: Column, arm: Column, script: Column, language: Column) -> Column:
    """struct(outcome, hedged, language, reason) of an answer.

    refusal: whether a refusal rule fired, null without rules; extracted: whether a valid extraction
    exists; content: whether it names anything. A refusal that names something is hedged and keeps its code.
    """
    got = resolve_language(arm, script, language)
    coded = F.when(got["conforming"].isNull(), "pending_adjudication").when(got["conforming"], "valid").otherwise("language_reversion")
    code = (F.when(degenerate_, "degenerate").when(refusal.isNull(), "pending_refusal_rules").when(~extracted & (refusal | pending), "pending_extractor")
            .when(refusal & ~content, "refusal"))
    done = code.isNull()
    return F.struct(F.coalesce(code, coded).alias("outcome"), F.coalesce(done & refusal, F.lit(False)).alias("hedged"),
                    F.when(done, got["language"]).alias("language"), F.when(done, got["reason"]).alias("reason"))


def serialised_price(s: Column) -> Column:
    """(currency, amount) of a pair written as "(12.5, 'USD')"; anything else is an error, as such strings come from a program."""
    pair = r"^\((\d+(?:\.\d+)?), '([^']+)'\)$"
    parsed = F.struct(F.regexp_extract(s, pair, 2).alias("currency"), F.regexp_extract(s, pair, 1).cast("double").alias("amount"))
    return F.when(s.rlike(pair), parsed).otherwise(F.raise_error(F.concat(F.lit("bad serialised price "), F.coalesce(s, F.lit("null")))))
