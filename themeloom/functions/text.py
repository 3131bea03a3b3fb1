"""Text Column builders.

Each builder maps a string Column to a Column and stays inside Catalyst, except for the Unicode
normal form in ``repair_encoding``, an Arrow UDF over only those values that can need it, and
``words_of_clean``, an Arrow UDF that looks chunks of cleaned texts up.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.entities import name2codepoint
from itertools import chain
from unicodedata import category

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from themeloom.functions import fixed

#: Unicode white space, as a character-class body understood by Java and RE2 alike.
SPACE = r"\s\x0b\p{Z}\x{85}\x{1c}-\x{1f}"

HTML_TAG = r"<[^>]+>"
URL = r"https?://(?:[a-zA-Z0-9$-_@.&+!*\\(),]|%[0-9a-fA-F][0-9a-fA-F])+"
#: A run can only match from its first character on, so anchoring it there keeps the
#: match linear in the run length.
EMAIL = rf"(?<![^{SPACE}])[^{SPACE}]+@[^{SPACE}]+"
OTHER_CHARS = rf"[^\p{{L}}\p{{N}}_{SPACE}.!?,;:()\-]"
WORD_ONLY = r"^[\p{L}\p{N}]+$"

#: (pattern, replacement) pairs that put blanks around token boundaries, in order.
TOKEN_RULES = [
    (r'\.{2,}|--|[;@#$%&?!()\[\]{}<>"]', " "),
    (r"\.(\s|$)", " $1"),
    (r"[:,](\D)", " $1"),
    (r"[:,]$", " "),
    (r"([^' ])('ll|'re|'ve|n't|'s|'m|'d|')(\s|$)", "$1 $3"),
]


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ascii(t: Column) -> Column:
    return F.octet_length(t) == F.char_length(t)


def _holding(t: Column, sign: str, change) -> Column:
    """``change`` of a text that holds ``sign``; others are not searched by a pattern."""
    return bound(t, lambda x: F.when(F.contains(x, F.lit(sign)), change(x)).otherwise(x))


def strip_html(t: Column) -> Column:
    return _holding(t, "<", lambda x: F.regexp_replace(x, HTML_TAG, ""))


def strip_urls(t: Column) -> Column:
    return _holding(t, "://", lambda x: F.regexp_replace(x, URL, ""))


def strip_emails(t: Column) -> Column:
    return _holding(t, "@", lambda x: F.regexp_replace(x, EMAIL, ""))


def keep_chars(t: Column) -> Column:
    return F.regexp_replace(t, OTHER_CHARS, "")


def normalize_space(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, rf"[{SPACE}]+", " "))


#: What the bytes 80 to 9F are in cp1252, in order; five of them are nothing there and stay control
#: characters, as all do in Latin-1.
_HIGH = "".join(bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in range(0x80, 0xA0))
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_BYTE = rf"[\x{{80}}-\x{{bf}}{_HIGH}]"
#: Characters that stand for the bytes of one UTF-8 character: Latin-1 letters and signs, general
#: punctuation and symbols, emoji. Other first bytes are letters that may well precede a sign.
MOJIBAKE = rf"[ÂÃ]{_BYTE}|â{_BYTE}{{2}}|ð[\x{{9f}}Ÿ]{_BYTE}{{2}}"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"
#: Marks, Hangul letters, and signs that are another character in normal form.
DECOMPOSED = r"[\p{M}\x{1100}-\x{11ff}\x{2126}\x{212a}\x{212b}]"


def _each_match(t: Column, pattern: str, change) -> Column:
    """``change`` of every match of a pattern, other characters as they are. NUL marks the matches and
    goes from the text, as all control characters do."""
    marked = F.regexp_replace(F.translate(t, "\x00", ""), f"((?:{pattern}))", "\x00$1\x00")
    parts = F.transform(F.split(marked, "\x00"), lambda x, i: F.when(i % 2 == 1, change(x)).otherwise(x))
    return F.array_join(parts, "")


def _reread(run: Column) -> Column:
    return F.decode(F.encode(F.translate(run, _HIGH, _C1), "ISO-8859-1"), "UTF-8")


def _entity(e: Column) -> Column:
    body = F.lower(F.regexp_replace(e, "^&#?|;$", ""))
    code = F.when(body.startswith("x"), F.conv(F.substr(body, F.lit(2)), 16, 10)).otherwise(F.conv(body, 10, 10)).cast("int")
    bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(~bad, code)), 8, "0")), "UTF-32")
    numeric = F.when(bad, F.lit("\ufffd")).otherwise(F.translate(char, _C1, _HIGH))
    names = F.create_map(*[F.lit(x) for name, n in name2codepoint.items() for x in (name, chr(n))], F.lit("apos"), F.lit("'"))
    name = F.regexp_replace(e, "^&|;$", "")
    return F.when(e.startswith("&#"), numeric).otherwise(F.coalesce(F.try_element_at(names, name), e))


@F.pandas_udf(StringType())
def _composed(values: pd.Series) -> pd.Series:
    from unicodedata import normalize

    return values.map(lambda s: s if s is None else normalize("NFC", s))


def repair_encoding(t: Column) -> Column:
    """Undo entities (in texts without tags), UTF-8 that was read as cp1252 or Latin-1, run by run,
    control characters, decomposed characters and curly quotes.

    All steps are built-in expressions on those values that need them, but for the normal form, an
    Arrow batch of the values with decomposed characters or numbered entities.
    """
    # no mark lies below U+0300
    needs = bound(t, lambda x: F.contains(x, F.lit("&#")) | (~is_ascii(x) & x.rlike(r"[^\x00-\x{2ff}]") & x.rlike(DECOMPOSED)))
    quotes = lambda x: F.when(~is_ascii(x) & x.rlike("[‘-‟]"), F.translate(x, "‘’‚‛“”„‟", "''''\"\"\"\"")).otherwise(x)
    return bound(F.coalesce(_composed(F.when(needs, _repaired(t))), _repaired(t)), quotes)


def _repaired(t: Column) -> Column:
    def entities(x):
        return F.when(F.contains(x, F.lit("&")) & ~F.contains(x, F.lit("<")) & x.rlike(ENTITY), _each_match(x, ENTITY, _entity)).otherwise(x)

    def reread(x):
        return F.when(~is_ascii(x) & x.rlike("[ÂÃâð]") & x.rlike(MOJIBAKE), _each_match(x, f"(?:{MOJIBAKE})+", _reread)).otherwise(x)

    return F.regexp_replace(bound(bound(t, entities), reread), CONTROL, "")


def clean_text(t: Column, repair: bool = False) -> Column:
    """Repair, drop tags, URLs, e-mails and odd characters, collapse blanks; NULL -> ''."""
    out = F.coalesce(t.cast("string"), F.lit(""))
    if repair:
        out = repair_encoding(out)
    for step in (strip_html, strip_urls, strip_emails, keep_chars, normalize_space):
        out = step(out)
    return out


def remove_boilerplate(t: Column) -> Column:
    for words in fixed.BOILERPLATE:
        t = F.regexp_replace(t, rf"(?i)^[{SPACE}]*({words})[{SPACE}]*[:#][{SPACE}]*", "")
    return bound(t, lambda x: F.when(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(f"[{SPACE}]"), normalize_edges(x)).otherwise(x))


def sentences(t: Column) -> Column:
    parts = F.transform(F.split(t, rf"(?<=[.!?])[{SPACE}]+"), normalize_edges)
    return F.filter(parts, lambda s: s != "")


def normalize_edges(t: Column) -> Column:
    return F.regexp_replace(t, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def word_tokens(t: Column) -> Column:
    """Lower-cased word tokens; tokens holding anything but letters and digits go."""
    t = F.lower(t)
    for pattern, replacement in TOKEN_RULES:
        t = F.regexp_replace(t, pattern, replacement)
    halves = "|".join(f"({left})({right})" for left, right in fixed.FUSED_WORDS)
    n = len(fixed.FUSED_WORDS)
    # groups that took no part in the match are empty, so this is "left right"
    apart = "".join(f"${2 * i + 1}" for i in range(n)) + " " + "".join(
        f"${2 * i + 2}" for i in range(n)
    )
    t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}_])(?:{halves})(?![\p{{L}}\p{{N}}_])", apart)
    return F.filter(F.split(t, rf"[{SPACE}]+"), lambda w: w.rlike(WORD_ONLY))


#: TOKEN_RULES for what lies between two blanks; its last sign stands before a blank.
_CHUNK_RULES = [(re.compile(a.replace(r"(\D)", "([^0-9])"), re.ASCII), re.sub(r"\$(\d)", r"\\\1", b)) for a, b in TOKEN_RULES]
_FUSED = re.compile(rf"(?<!\w)(?:{'|'.join(a + b for a, b in fixed.FUSED_WORDS)})(?!\w)")
_APART = {a + b: f"{a} {b}" for a, b in fixed.FUSED_WORDS}

#: Different chunks that a worker remembers.
REMEMBERED = 1 << 18


@lru_cache(REMEMBERED)
def _chunk_words(chunk: str) -> tuple[str, ...]:
    """What ``drop_stop_words(word_tokens)`` gives for a lower-cased text without blanks."""
    plain = chunk[:-1] if chunk[-1:] in _LAST else chunk
    if plain.isascii() and plain.isalnum() and plain not in _APART:  # most are: no rule but for the last sign
        return () if plain in _STOPS else (plain,)
    t = f"{chunk} "
    for pattern, replacement in _CHUNK_RULES:
        t = pattern.sub(replacement, t)
    t = _FUSED.sub(lambda m: _APART[m.group()], t)
    return tuple(w for w in t.split(" ") if w and w not in _STOPS and all(category(c)[0] in "LN" for c in w))


_STOPS, _LAST = frozenset(fixed.STOP_WORDS), frozenset(".,:;!?)")


@F.arrow_udf(ArrayType(StringType()))
def words_of_clean(texts: pa.Array) -> pa.Array:
    """``drop_stop_words(word_tokens)`` of texts that ``clean_text`` left, in which single blanks are the
    only white space: every rule stays between two blanks, and a chunk that comes again is looked up."""
    words, ends = [], [0]
    for t in texts.to_pylist():
        words.extend(chain.from_iterable(map(_chunk_words, (t or "").lower().split(" "))))
        ends.append(len(words))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()))


def drop_stop_words(words: Column, extra: list[str] | None = None) -> Column:
    stops = [*fixed.STOP_WORDS, *(extra or [])]
    return F.filter(words, lambda w: ~F.lower(w).isin(stops))


def letter_runs(t: Column) -> Column:
    return F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: w != "")


def strip_quotes(t: Column) -> Column:
    """Trim a model response and take its quote marks out."""
    return F.translate(normalize_edges(t), "\"'", "")


def bullet_block(samples: Column, n: int = 10) -> Column:
    """First ``n`` samples, one '- ' line each."""
    return F.concat_ws(
        "\n", F.transform(F.slice(samples, 1, n), lambda s: F.concat(F.lit("- "), s))
    )
