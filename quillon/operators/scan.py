"""Texts scanned for a dictionary of terms in one pass: an Aho-Corasick automaton with rules on where a hit may stand."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of one automaton; a longer table is cut into several, which each read the texts.
MOST_TERMS = 200_000
#: Case endings that may follow a Latin or a Bengali name.
LATIN_ENDINGS = ("er", "r", "e", "te", "ke", "ta", "ti", "tar", "gulo", "guli", "ra", "o")
BENGALI_ENDINGS = ("ে", "ের", "েও", "েতে", "েতেই", "েই", "েরও", "েরই", "র", "রও", "কে", "তে", "তেই", "দের", "টা", "টি", "টার", "টির", "টাই",
                   "গুলো", "গুলি", "গুলোর", "গুলোতে", "রা", "ও", "খানা", "\u09df", "\u09dfে", "\u09dfের")
#: The letter U+09DF is also written as U+09AF with a dot.
BENGALI_ENDINGS += tuple(e.replace("\u09df", "\u09af\u09bc") for e in BENGALI_ENDINGS if "\u09df" in e)
#: Letters and signs of Bengali words: from the first vowel to the last vowel sign; digits and currency marks come after.
BENGALI_WORD = "\u0985-\u09e3"
KINDS = ("word", "substring", "suffix")
_LATIN, _BENGALI = re.compile("[A-Za-z0-9]*"), re.compile(f"[{BENGALI_WORD}]*")
_BEFORE = {False: re.compile("[A-Za-z0-9]"), True: re.compile(f"[{BENGALI_WORD}]")}


def is_bengali(term: str) -> bool:
    return any("ঀ" <= c <= "৿" for c in term)


def stands(text: str, start: int, end: int, kind: str, bengali: bool) -> bool:
    """Whether a hit text[start:end] counts: a word has no letter or digit of its script on either side, a suffix term may have an ending after it."""
    if kind == "substring":
        return True
    if start and _BEFORE[bengali].match(text[start - 1]):
        return False
    rest = (_BENGALI if bengali else _LATIN).match(text, end).group()
    return not rest or (kind == "suffix" and rest.lower() in (BENGALI_ENDINGS if bengali else LATIN_ENDINGS))


def pattern(term: str, kind: str) -> str:
    """The same rule as a regular expression for one term; the scan itself uses none."""
    if kind == "substring":
        return re.escape(term)
    bengali = is_bengali(term)
    letters, endings = (BENGALI_WORD, BENGALI_ENDINGS) if bengali else ("A-Za-z0-9", LATIN_ENDINGS)
    more = f"(?:{'|'.join(sorted(endings, key=len, reverse=True))})?" if kind == "suffix" else ""
    return f"(?<![{letters}]){re.escape(term)}{more}(?![{letters}])"


def term_hits(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, kind, n, first): how often each term stands in each text, without regard to A-Z case, and where first.

    terms: (term, kind), kind word, substring or suffix; null and empty terms find nothing. Overlapping hits all count. The terms are
    the driver's and each task's, in automata of MOST_TERMS; texts are read once for each automaton, never shuffled.
    """
    low = lambda s: s.translate(_TO_LOWER)
    known = sorted({(low(r["term"]), r["kind"]) for r in terms.select("term", "kind").distinct().toLocalIterator() if r["term"]})
    kind = texts.select(key).schema[0].dataType.simpleString()
    ddl = f"`{key}` {kind}, term string, kind string, n long, first long"

    def scan(some: list[tuple[str, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            by: dict[str, list[str]] = {}
            for term, k in some:
                by.setdefault(term, []).append(k)
            for term, kinds in by.items():
                machine.add_word(term, (term, kinds, is_bengali(term)))
            machine.make_automaton()
            for b in batches:
                out: list[tuple] = []
                for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    found: dict[tuple[str, str], list[int]] = {}
                    s = low(t or "")
                    for last, (term, kinds, bengali) in machine.iter(s):
                        start = last + 1 - len(term)
                        for k in kinds:
                            if stands(s, start, last + 1, k, bengali):
                                found.setdefault((term, k), []).append(start)
                    out += [(name, term, k, len(at), at[0]) for (term, k), at in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((b.column(0).type, pa.string(), pa.string(), pa.int64(), pa.int64()))], names=[key, "term", "kind", "n", "first"])

        return texts.select(key, text).mapInArrow(run, ddl)

    parts = [scan(known[i:i + MOST_TERMS]) for i in range(0, len(known), MOST_TERMS)] or [texts.sparkSession.createDataFrame([], ddl)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def word_hits(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term) of terms that are single words of letters and digits: an equi-join on words, for tables of any size."""
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))).alias("term"))
    return words.join(terms.select(F.lower("term").alias("term")).distinct(), "term").select(key, "term")


_TO_LOWER = {c: c + 32 for c in range(65, 91)}
