"""Columns over passages and pages: plain text of markup, shortening, script share, loose matching, assertions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content is not text, character references, words that assert a legal duty.
SKIPPED = ("script", "style", "nav", "header", "footer", "noscript", "form")
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
ASSERTION = r"(?i)\b(shall|must|required|requires|prohibit|not patentable|not allowed|permitted|mandatory|approval|licen[cs]e|liable|penalt|under (section|rule|article))\w*"
GAP = "[…]"


def html_text(html: Column) -> Column:
    """The page's text on one line, without the elements of SKIPPED, comments and tags."""
    for tag in SKIPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    html = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for reference, char in REFERENCES:
        html = F.replace(html, F.lit(reference), F.lit(char))
    return F.trim(F.regexp_replace(html, r"[ \t\r\n\f]+", " "))


def shorten(text: Column, limit: int) -> Column:
    """A text beyond 1.25 x limit keeps 55 % of the limit at its start and the rest at its end, both cut at line breaks."""
    head = int(limit * 0.55)
    first, last = F.left(text, F.lit(head)), F.right(text, F.lit(limit - head))
    start = F.when(first.rlike(r"(?s)^.+\n"), F.regexp_replace(first, r"\n[^\n]*\z", "")).otherwise(first)
    end = F.when(last.rlike(r"(?s)\n."), F.regexp_replace(last, r"^[^\n]*\n", "")).otherwise(last)
    cut = F.concat(F.regexp_replace(start, r"[ \t\r\n\f]+\z", ""), F.lit(f"\n{GAP}\n"), F.regexp_replace(end, r"^[ \t\r\n\f]+", ""))
    return F.when(F.char_length(text) <= limit * 1.25, text).otherwise(cut)


def script_share(text: Column, script: str) -> Column:
    """The share of ``script`` (a character class's content) among the text's letters and marks; 0 without any."""
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))
    return F.when(letters > 0, F.char_length(F.regexp_replace(text, f"[^{script}]", "")) / letters).otherwise(F.lit(0.0))


def subsequence_score(text: Column, needle: str) -> Column:
    """1 less the gaps' share if the needle's characters occur in order, else 0; needles under three characters score 0."""
    if len(needle) < 3:
        return F.lit(0.0)
    pattern = "".join(rf"[^\x{{{ord(c):x}}}]*\x{{{ord(c):x}}}" if i else rf"\x{{{ord(c):x}}}" for i, c in enumerate(needle))
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found == "", 0.0).otherwise(1 - (F.char_length(found) - len(needle)) / (F.char_length(text) + 1))


def assertions(text: Column) -> Column:
    """How many lines assert a duty or permission."""
    return F.size(F.filter(F.split(text, "\n"), lambda p: p.rlike(ASSERTION))).cast("long")


def deep_link(url: Column, page: Column) -> Column:
    return F.when(F.lower(url).endswith(".pdf") & page.isNotNull(), F.concat(url, F.lit("#page="), page.cast("string"))).otherwise(url)
