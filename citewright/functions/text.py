"""Text functions: cleaning, sentences, chunks, labels, tokens, quotes, sanitising. Native columns unless said otherwise."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MIN_CHUNK, MAX_CHUNK, OVERLAP = 40, 1500, 1
MARK, HOLD = "\u001e", "\u001f"

#: Fixed value: words that carry no meaning for ranking.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can shall "
    "to of in for on with at by from as into about between through after before during without and or but not no if then than "
    "that this it its what which who whom how when where why all each every both few more most some such only very just so also"
).split()

#: Characters that quotes are allowed to differ in, and what they count as.
QUOTE_EQUIVALENTS = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"',
    "–": "-", "—": "-", "―": "-", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ",
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "​": "", "­": "", "…": "...",
}
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|St|vs|etc|Fig|No|e\\.g|i\\.e"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


@F.pandas_udf(StringType())
def decode_references(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def strip_fragment(raw: Column) -> Column:
    """Text of an HTML fragment: no scripts, styles and tags, references decoded, at most two line ends in a row."""
    bare = F.regexp_replace(F.regexp_replace(raw, "(?is)<(script|style)[^>]*>.*?</\\1>", ""), "<[^>]+>", "")
    text = F.when(bare.contains("&"), decode_references(bare)).otherwise(bare)
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def is_document(raw: Column) -> Column:
    """Whether a text is a whole HTML document rather than a fragment."""
    return F.substring(raw, 1, 1000).rlike("(?i)<\\s*html[\\s>]|<!doctype\\s+html")


def sentences(text: Column) -> Column:
    """Sentences end at line ends and at .!? before white space, but for abbreviations."""
    held = F.regexp_replace(text, f"\\b({ABBREVIATIONS})\\.\\s", f"$1.{HOLD}")
    cut = F.split(F.regexp_replace(F.regexp_replace(held, "([.!?])\\s+", f"$1{MARK}"), "\n+", MARK), MARK)
    return F.filter(F.transform(cut, lambda s: strip(F.translate(s, HOLD, " "))), lambda s: s != "")


WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PARAGRAPH = re.compile(r"\n\s*\n", re.A)
_HELD = re.compile(f"\\b({ABBREVIATIONS})\\.\\s", re.A)
_STOP = re.compile(r"(?<=[.!?])\s+|\n+", re.A)


def sentence_list(text: str) -> list[str]:
    """sentences() of a string."""
    parts = _STOP.split(_HELD.sub(rf"\1.{HOLD}", text))
    return [s for p in parts if (s := p.replace(HOLD, " ").strip(WHITE))]


def piece_list(sentence: str) -> list[str]:
    """A sentence in pieces of up to MAX_CHUNK characters that lose none of its words; one ends at white space where it has any."""
    out, at = [], 0
    while len(sentence) - at > MAX_CHUNK:
        gap = next((i for i in range(at + MAX_CHUNK, at, -1) if sentence[i] in WHITE), at + MAX_CHUNK)
        out.append(sentence[at:gap].strip(WHITE))
        at = gap
    return [p for p in [*out, sentence[at:].strip(WHITE)] if p]


def window_list(parts: list[str], whole: bool = False) -> list[str]:
    """Sentences packed into windows of up to MAX_CHUNK characters; each next window begins with the last sentence of the one before. Of a longer sentence the beginning counts, or with `whole` each piece
    as a sentence of its own."""
    done, held, n = [], [], 0
    for s in [p for s in parts for p in piece_list(s)] if whole else parts:
        s = s[:MAX_CHUNK]
        if held and n + len(s) + 1 > MAX_CHUNK:
            done.append(" ".join(held))
            held = held[-OVERLAP:]
            n = len(" ".join(held)) + 1
        held.append(s)
        n += len(s) + 1
    return done + [" ".join(held)] if held else done


def chunk_list(text: str | None, whole: bool = False) -> list[str] | None:
    """Paragraphs of MIN_CHUNK characters or more; longer ones than MAX_CHUNK in sentence windows, or by length where there is no sentence. whole: no sentence is cut off at MAX_CHUNK."""
    if text is None:
        return None
    out = []
    for p in _PARAGRAPH.split(text):
        p = p.strip(WHITE)
        if len(p) <= MAX_CHUNK:
            out.append(p)
        else:
            ss = sentence_list(p)
            out += window_list(ss, whole) if ss else [p[at : at + MAX_CHUNK].strip(WHITE) for at in range(0, len(p), MAX_CHUNK)]
    return [c for c in out if len(c) >= MIN_CHUNK]


@F.pandas_udf(ArrayType(StringType()))
def _chunks(s: pd.Series) -> pd.Series:
    return s.map(chunk_list)


@F.pandas_udf(ArrayType(StringType()))
def _whole_chunks(s: pd.Series) -> pd.Series:
    return s.map(lambda t: chunk_list(t, whole=True))


def chunks(text: Column, whole: bool = False) -> Column:
    """chunk_list of a column: packing is a loop with state, which an Arrow function does once a text; explode its result straight away."""
    return _whole_chunks(text) if whole else _chunks(text)


def chunk_label(i: Column) -> Column:
    """A, B, .. Z, AA, .. ZZ, AAA, .. (bijective base 26 of i + 1), up to seven letters, which number all places of an int."""
    letter = lambda x: F.chr((F.pmod(x, F.lit(26)) + 65).cast("int"))
    at, out = i.cast("long"), None
    for _ in range(7):
        one = F.when(at >= 0, letter(at)).otherwise("")
        out = one if out is None else F.concat(one, out)
        at = F.floor(at / 26) - 1
    return out


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, less stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(STOP_WORDS))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def normalise_text(text: str) -> str:
    """The form in which quotes are looked for."""
    t = unicodedata.normalize("NFKD", text.translate(str.maketrans(QUOTE_EQUIVALENTS)))
    kept = [c for c in t if unicodedata.category(c)[0] not in "PS" and unicodedata.category(c) not in ("Mn", "Cf")]
    return " ".join("".join(kept).casefold().split())


@F.pandas_udf(StringType())
def _normalise(s: pd.Series) -> pd.Series:
    return s.map(normalise_text, na_action="ignore")


def normalise_quote(text: Column) -> Column:
    """Native for ASCII; Python only for rows with other characters."""
    plain = strip(F.regexp_replace(F.lower(F.regexp_replace(text, "[\\p{P}\\p{S}]", "")), "\\s+", " "))
    ascii_only = ~text.rlike("[^\\x00-\\x7F]")
    return F.when(ascii_only, plain).otherwise(_normalise(F.when(~ascii_only, text)))


def sanitise_untrusted(text: Column, cap: int = 6000) -> Column:
    """Fence marks redacted, then cut to `cap` characters."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)<<<\\s*(?:END_?)?(?:CHUNK|QUOTE|META)\\s*>>>", "[redacted-fence]")
    return F.when(F.length(t) > cap, F.concat(F.substring(t, 1, cap), F.lit("\n…[truncated]"))).otherwise(t)


def sanitise_chunk(text: Column, cap: int = 1800) -> Column:
    """Cut to `cap` characters, then fence marks redacted (so that redaction cannot be used up by the cut)."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(F.length(t) > cap, F.concat(F.substring(t, 1, cap), F.lit("\n…[truncated]"))).otherwise(t)
    return F.regexp_replace(t, "(?i)<<<\\s*/?\\s*(?:END_?)?CHUNK[^>]*>>>", "[redacted-fence]")


#: Fixed value: phrases that a failure reason must not carry into a prompt.
INJECTIONS = "(?i)(ignore (?:all|previous|prior) (?:instructions|directions)|disregard (?:all|previous|prior)|system\\s*[:>]|you are now|act as|</?(?:system|user|assistant)>|```)"


def sanitise_reason(reason: Column, cap: int = 280) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), "[\\r\\n]", " "))
    clean = F.regexp_replace(flat, INJECTIONS, "[redacted]")
    clean = F.when(F.length(clean) > cap, F.concat(F.substring(clean, 1, cap), F.lit("…"))).otherwise(clean)
    return F.when(clean == "", F.lit("unspecified semantic mismatch")).otherwise(clean)


def rewrite_request(tier: int, sentence: Column, citation: Column, chunk: Column, reason: Column) -> Column:
    label = "hallucinated" if tier == 5 else "misrepresented"
    safe = reason if tier == 5 else sanitise_reason(reason)
    return F.concat(F.lit("Sentence "), sentence, F.lit(", citation "), citation, F.lit(" (chunk "), chunk, F.lit(f"): Tier {tier} ({label}) failure — "), safe)
