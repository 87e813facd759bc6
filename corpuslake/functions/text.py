"""Text functions as columns. Patterns are Java regular expressions with Unicode classes where the data need them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# How questions and prose name provisions (two patterns on purpose), named patterns that mark an attempt to steer the answering side, questions for medical advice,
# personal data with their labels, and scripts with their languages in order of precedence.
INJECTIONS = {
    "ignore_instructions": r"(?i)\b(ignore|disregard|forget|override)\s+(all\s+|any\s+|the\s+)?(previous|prior|above|earlier|your|system)\s+(instructions|rules|prompts?|guidelines)",
    "role_override": r"(?i)\b(you are now|from now on,? you|pretend (to be|you are)|act as (an? |if you)(?!.{0,20}\b(licen[cs]|agent|authority|distributor)))",
    "system_prompt_probe": r"(?i)\b(reveal|show|print|repeat)\b.{0,30}\b(system prompt|your (instructions|rules|prompt))\b",
    "fake_citation": r"(?i)\b(cite|say|state|claim)\b.{0,60}\b(section|article|rule)\s*\d+.{0,60}\b(even if|regardless|anyway|whether or not)\b",
    "delimiter_spoof": r"(?i)</?(source|document|system)\b|\[\[c:|【c:",
}
MEDICAL = r"(?i)\b(how much|what dose|dosage|how many (tablets|capsules|grams)|should i take|can i take|cure (my|for)|treat my|is it safe for me|my (child|baby|mother|father) has|i have (diabetes|cancer|bp|blood pressure|a fever))\b"
PERSONAL = ((r"[\w.+-]+@[\w-]+\.[\w.]+", "[email]"), (r"\b[A-Z]{5}\d{4}[A-Z]\b", "[pan]"), (r"\b\d{4}\s?\d{4}\s?\d{4}\b", "[aadhaar]"), (r"(?:\+91[\s-]?)?\b[6-9]\d{9}\b", "[phone]"))
SCRIPTS = (("[஀-௿]", "ta"), ("[ఀ-౿]", "te"), ("[ಀ-೿]", "kn"), ("[ঀ-৿]", "bn"), ("[઀-૿]", "gu"), ("[ऀ-ॿ]", "hi"))
LOCATOR = r"(?i)\b(sec(?:tion)?s?\.?|s\.|rule|reg(?:ulation)?\.?|art(?:icle)?\.?)\s*(\d{1,4}[A-Z]{0,3})(\.\d{1,2})?(\([a-z0-9]{1,4}\))?"
PROVISION = r"(?i)\b(sections?|secs?\.|s\.|rules?|articles?|art\.)\s*(\d{1,4}[A-Z]{0,3})(?:\.\d{1,2})?(?:\s?\([a-z0-9]{1,4}\))*"
WORD3 = "[A-Za-z][A-Za-z0-9]{2,}"
MAX_QUESTION, SCRIPT_CHARS, MIN_PIECE = 2000, 3, 12


class Known(dict):
    """What a function gives for a word, kept for at most ``most`` words: a look at a known word is a look in a dictionary."""

    def __init__(self, of: Callable[[str], int], most: int = 200_000):
        self.of, self.most = of, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = self.of(word)
        return found


_LOW = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 0 for c in range(256)], np.uint8)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_places(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """``row, number, words`` of all matches of WORD3, in order, for some texts at a time (about ``most`` bytes): whose text it's in, and its place among ``words``, the different ones in lower case.

    A match is a run of letters and digits from its first letter on, found by bytes for all texts at once; up to eight bytes are one number, so equal words are told without a look at each.
    """
    held, first, n = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text.encode("utf-8", "surrogatepass"))
        n += len(held[-1])
        if n >= most or i == len(texts) - 1:
            low = _LOW[np.frombuffer(b"\n" + b"\n".join(held) + b"\n" * 8, np.uint8)]
            edges = np.flatnonzero((low[1:] > 0) != (low[:-1] > 0)) + 1
            begin, end = edges[::2].copy(), edges[1::2]
            late = np.flatnonzero(low[begin] < 97)
            letters = np.append(np.flatnonzero(low >= 97), len(low))
            begin[late] = np.minimum(letters[np.searchsorted(letters, begin[late])], end[late])
            begin, end = begin[end - begin > 2], end[end - begin > 2]
            size, all_ = end - begin, low.tobytes()
            short = size <= 8
            key = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))[begin[short]] & _MASK[size[short]]
            _, at, of = np.unique(key, return_index=True, return_inverse=True)
            words = [all_[b:e].decode() for b, e in zip(begin[short][at].tolist(), end[short][at].tolist(), strict=True)]
            longer = {}
            number = np.empty(len(begin), np.int64)
            number[short] = of
            number[~short] = [longer.setdefault(all_[b:e], len(words) + len(longer)) for b, e in zip(begin[~short].tolist(), end[~short].tolist(), strict=True)]
            row = first + np.searchsorted(np.cumsum([1, *(len(t) + 1 for t in held)])[1:], begin, "right")
            yield row, number, words + [w.decode() for w in longer]
            held, first, n = [], i + 1, 0


def nfkc(text: Column) -> Column:
    """Compatibility forms composed (NFKC). Only texts beyond ASCII go through Arrow."""

    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    compose.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.coalesce(F.pandas_udf(compose, "string")(F.when(F.octet_length(text) != F.char_length(text), text)), text)


def clean(text: Column) -> Column:
    """Control and format characters out, tabs to blanks, words rejoined over hyphened line ends, blanks and blank lines collapsed."""
    out = F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")
    for pattern, new in ((r"\t", " "), (r"(?U)(\w)-\n(\w)", "$1$2"), ("[  ]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+\z", "")):
        out = F.regexp_replace(out, pattern, new)
    return out


def for_match(text: Column) -> Column:
    """The form in which quotes are compared: lower case, no quotes or brackets, plain dashes, single blanks, bare edges."""
    out = F.regexp_replace(F.lower(text), "[“”\"'‘’`\\[\\]­]", "")
    for pattern, new in (("[‐‑‒–—―−-]", "-"), (r"\s*-\s*", "-"), (r"\s+", " "), (r"^[ .;:,]+|[ .;:,]+\z", "")):
        out = F.regexp_replace(out, pattern, new)
    return out


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words3(text: Column) -> Column:
    """Distinct lower-case words of at least three characters, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD3), F.lit(0)), F.lower))


def locators(text: Column) -> Column:
    """Named provisions, the finer form before its base, distinct in order."""
    group = lambda i: F.regexp_extract_all(text, F.lit(LOCATOR), F.lit(i))

    def forms(x: Column) -> Column:
        kind = F.lower(x["0"])
        prefix = F.when(kind.startswith("rule"), "Rule ").when(kind.startswith("reg"), "Reg. ").when(kind.startswith("art"), "Art. ").otherwise("s.")
        base = F.concat(prefix, F.upper(x["1"]))
        return F.filter(F.array(F.when(x["2"] != "", F.concat(base, x["2"])), F.when((x["3"] != "") & (x["2"] == ""), F.concat(base, F.lower(x["3"]))), base), lambda y: y.isNotNull())

    return F.array_distinct(F.flatten(F.transform(F.arrays_zip(*[group(i).alias(str(i - 1)) for i in range(1, 5)]), forms)))


def locator_matches(wanted: Column, at: Column) -> Column:
    return (at == wanted) | F.startswith(at, F.concat(wanted, F.lit("("))) | F.startswith(at, F.concat(wanted, F.lit(".")))


def provisions(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PROVISION), F.lit(2)), F.upper))


def injection_flags(text: Column) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in INJECTIONS.items()]), lambda x: x.isNotNull())


def scrub(text: Column) -> Column:
    for pattern, label in PERSONAL:
        text = F.regexp_replace(text, pattern, label)
    return text


def screen(text: Column) -> Column:
    """too_long, empty, unsafe, medical_advice or ok; the cheapest test first."""
    return F.when(F.char_length(text) > MAX_QUESTION, "too_long").when(F.trim(text) == "", "empty").when(F.size(injection_flags(text)) > 0, "unsafe").when(text.rlike(MEDICAL), "medical_advice").otherwise("ok")


def language(text: Column, chosen: Column | None = None) -> Column:
    """The language chosen, unless that is null or 'auto'; else the first script of which the text has enough characters; else English."""
    out = F.lit("en")
    for script, code in reversed(SCRIPTS):
        out = F.when(F.regexp_count(text, F.lit(script)) >= SCRIPT_CHARS, code).otherwise(out)
    return out if chosen is None else F.when(chosen != "auto", chosen).otherwise(out)


def cache_key(question: Column, mode: Column, person: Column, language: Column, context: Column, version: Column) -> Column:
    """One key for all that decides an answer; blanks and case of the question don't."""
    return F.md5(F.concat_ws("|", F.regexp_replace(F.lower(F.trim(question)), r"\s+", " "), mode, person, language, context, version))


def question_hash(text: Column, digits: int = 32) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, digits)


def occurrences(text: Column, needle: Column) -> Column:
    return F.when(needle == "", 0).otherwise(((F.char_length(text) - F.char_length(F.replace(text, needle, F.lit("")))) / F.char_length(needle)).cast("long"))


def pieces(quote: Column) -> Column:
    """A quotation's parts around its ellipses, as they are compared."""
    return F.filter(F.transform(F.split(quote, r"\.{3,}|…"), for_match), lambda p: p != "")


def held(parts: Column, hay: Column) -> Column:
    """Are a quote's ``pieces`` in a text, in order? Both as compared already, in columns of their own, so that neither is made anew for each look. The longest must have MIN_PIECE characters."""
    step = lambda at, p: F.when((at > 0) & (F.call_function("locate", p, hay, at) > 0), F.call_function("locate", p, hay, at) + F.char_length(p)).otherwise(F.lit(0))
    return (F.coalesce(F.array_max(F.transform(parts, F.char_length)), F.lit(0)) >= MIN_PIECE) & (F.aggregate(parts, F.lit(1), step) > 0)


def quote_in(quote: Column, source: Column) -> Column:
    """``held`` of a quote (cut at its ellipses) and a source, both as written."""
    return held(pieces(quote), for_match(source))
