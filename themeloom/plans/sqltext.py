"""SQL fragments of the text steps, for the check queries (RE2 dialect)."""

from __future__ import annotations

from themeloom.functions import fixed

# The patterns are written out here a second time, so that a slip in one place shows.
W = r"\s\x0b\p{Z}\x{85}\x{1c}-\x{1f}"
URL = r"https?://(?:[a-zA-Z0-9$-_@.&+!*\(),]|%[0-9a-fA-F][0-9a-fA-F])+"
OTHER = rf"[^\p{{L}}\p{{N}}_{W}.!?,;:()\-]"
TOKENS = [
    (r'\.{2,}|--|[;@#$%&?!()\[\]{}<>"]', " "),
    (r"\.(\s|$)", r" \1"),
    (r"[:,](\D)", r" \1"),
    (r"[:,]$", " "),
    (r"([^' ])('ll|'re|'ve|n't|'s|'m|'d|')(\s|$)", r"\1 \3"),
]


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replace(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, 'g')"


def html(x: str) -> str:
    return replace(x, "<[^>]+>")


def urls(x: str) -> str:
    return replace(x, URL)


def emails(x: str) -> str:
    return replace(x, rf"[^{W}]+@[^{W}]+")


def chars(x: str) -> str:
    return replace(x, OTHER)


def blanks(x: str) -> str:
    return f"trim({replace(x, f'[{W}]+', ' ')})"


def edges(x: str) -> str:
    return replace(x, f"^[{W}]+|[{W}]+$")


def clean(x: str) -> str:
    return blanks(chars(emails(urls(html(f"coalesce({x}, '')")))))


def boilerplate(x: str) -> str:
    for words in fixed.BOILERPLATE:
        x = replace(x, rf"(?i)^[{W}]*({words})[{W}]*[:#][{W}]*")
    return edges(x)


def sentences(x: str) -> str:
    marked = replace(x, rf"([.!?])[{W}]+", r"\1" + "\x01")
    trimmed = f"list_transform(string_split({marked}, chr(1)), lambda s: {edges('s')})"
    return f"list_filter({trimmed}, lambda s: s <> '')"


def words(x: str) -> str:
    x = f"lower({x})"
    for pattern, by in TOKENS:
        x = replace(x, pattern, by)
    kept = (
        f"list_filter(string_split_regex({x}, {quote(f'[{W}]+')}), "
        f"lambda w: regexp_matches(w, {quote(r'^[\p{L}\p{N}]+$')}))"
    )
    cases = " ".join(
        f"WHEN {quote(a + b)} THEN [{quote(a)}, {quote(b)}]" for a, b in fixed.FUSED_WORDS
    )
    return f"flatten(list_transform({kept}, lambda w: CASE w {cases} ELSE [w] END))"


def content_words(x: str) -> str:
    stops = ", ".join(quote(w) for w in fixed.STOP_WORDS)
    return f"list_filter({words(x)}, lambda w: w NOT IN ({stops}))"


def letters(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}]+'), lambda w: w <> '')"


def vec(x: str = "embedding") -> str:
    return f"{x}::DOUBLE[]"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


def means(source: str, by: str | None, column: str) -> str:
    """Rows (by..., v DOUBLE[]): element-wise means of list column ``column``."""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
      SELECT {key}list(m ORDER BY pos) AS v FROM (
        SELECT {key}pos, avg(x) AS m FROM (
          SELECT {key}unnest({column}) AS x, generate_subscripts({column}, 1) AS pos FROM {source}
        ) GROUP BY {key}pos
      ) {group}"""
