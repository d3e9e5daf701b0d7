"""Column functions over text: word sets, links, identities, numbers, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never count as terms.
STOP_WORDS = [
    "about", "after", "again", "against", "also", "because", "before", "being", "between", "could", "during", "each", "from", "have", "into", "more", "must", "need", "only", "other",
    "over", "should", "than", "that", "their", "there", "these", "this", "through", "under", "using", "where", "which", "while", "with", "within", "without", "would",
]

#: Patterns that mark secrets, by label.
SECRET_PATTERNS = {
    "private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "github token": r"\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{20,}\b",
    "github fine-grained token": r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    "openai api key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "aws access key": r"\b(A3T[A-Z0-9]|AKIA|ASIA)[A-Z0-9]{16}\b",
    "slack token": r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}
#: The shape of payment cards and of terms, and what is taken out of a note before its terms, in this order.
CARD_PATTERN = r"\b(?:\d[ -]*?){13,19}\b"
TERM_PATTERN = "[a-z0-9][a-z0-9-]{2,}"
NO_TERMS = [
    (r"(?s)```.*?```", " "),
    (r"`[^`]*`", " "),
    (r"https?://\S+", " "),
    (r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]", "$1"),
    (r"!\[[^\]]*\]\([^)]+\)", " "),
    (r"\[[^\]]+\]\([^)]+\)", " "),
]


def terms(text: Column) -> Column:
    """The distinct terms of a text without code, links and stop words."""
    plain = F.coalesce(text, F.lit(""))
    for pattern, instead in NO_TERMS:
        plain = F.regexp_replace(plain, pattern, instead)
    return F.array_except(F.regexp_extract_all(F.lower(plain), F.lit(TERM_PATTERN), F.lit(0)), F.array(*map(F.lit, STOP_WORDS)))


TERMS_SQL = """list_filter(list_distinct(regexp_extract_all(lower(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''),
    '```.*?```', ' ', 'gs'), '`[^`]*`', ' ', 'g'), 'https?://\\S+', ' ', 'g'), '\\[\\[([^\\]|#]+)(?:[#|][^\\]]*)?\\]\\]', '\\1', 'g'),
    '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '\\[[^\\]]+\\]\\([^)]+\\)', ' ', 'g')), '[a-z0-9][a-z0-9-]{{2,}}')),
  lambda w: NOT list_contains([""" + ", ".join(f"'{w}'" for w in STOP_WORDS) + """], w))"""


def jaccard(left: Column, right: Column) -> Column:
    """Shared part of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), shared / (F.size(left) + F.size(right) - shared)).otherwise(F.lit(0.0))


def trimmed(text: Column) -> Column:
    """Without any white space at the ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def wiki_targets(body: Column, fields: Column | None = None) -> Column:
    """Targets of double-bracket links without heading and alias: of a body outside inline code, and of an array of frontmatter values as they are.

    A bar with a backslash before it, as tables need it, starts the alias too.
    """
    link = F.lit(r"\[\[([^\]]+?)\]\]")
    links = F.regexp_extract_all(F.regexp_replace(F.coalesce(body, F.lit("")), r"`+[^`]*`+", ""), link, F.lit(1))
    if fields is not None:
        links = F.concat(links, F.flatten(F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda v: F.coalesce(F.regexp_extract_all(v, link, F.lit(1)), F.array().cast("array<string>")))))
    return F.filter(F.transform(links, lambda x: trimmed(F.regexp_replace(F.replace(x, F.lit("\\|"), F.lit("|")), r"(?s)[#|].*$", ""))), lambda x: x != "")


def identity(prefix: str, *parts: Column) -> Column:
    """`prefix_` and 20 hexadecimal digits of the SHA-256 of the parts with NUL between."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 20))


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the modulo-10 check."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.length(digits).between(13, 19) & (F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0)


def card_numbers(text: Column) -> Column:
    """Digit runs of payment-card shape that pass the Luhn check."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CARD_PATTERN), F.lit(0)), lambda x: F.regexp_replace(x, r"\D", ""))
    return F.filter(found, luhn)


def secret_labels(text: Column) -> Column:
    """Labels of the secret patterns that a text has, each once, in the order of the list."""
    return F.filter(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(label)) for label, p in SECRET_PATTERNS.items()]), lambda x: x.isNotNull())


def slug(value: Column) -> Column:
    """Lower-case runs of letters and digits joined by `-`."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def css_fragment(value: Column) -> Column:
    """Lower case, other characters than letters, digits, `-` and `_` as `-`, none at the ends; `unknown` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", "")
    return F.when(clean == "", "unknown").otherwise(clean)


def safe_identity(value: Column) -> Column:
    """A file name of an identity: other characters than letters, digits, `-`, `_` and `.` as `-`; a hash if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(trimmed(value), r"[^\p{L}\p{N}_.-]", "-"), "^[.-]+|[.-]+$", "")
    return F.when(clean == "", F.left(F.sha2(value, 256), F.lit(20))).otherwise(clean)


def href(path: Column) -> Column:
    """A relative link to a path, with other characters than letters, digits and `/._-~` as percent codes."""
    return F.concat(F.lit("./"), F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~")))


def humanize(stem: Column) -> Column:
    return F.trim(F.translate(stem, "_-", "  "))


def markdown_escape(value: Column) -> Column:
    return F.regexp_replace(value, r"([\\\[\]])", r"\\$1")


def html_escape(value: Column) -> Column:
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(char), F.lit(code))
    return value


def capped(text: Column, cap: int, mark: str) -> Column:
    """Trimmed; a placeholder if empty; cut at `cap` characters with a mark."""
    clean = trimmed(F.coalesce(text, F.lit("")))
    return F.when(clean == "", F.lit("_(no text)_")).when(F.length(clean) > cap, F.concat(F.left(clean, F.lit(cap)), F.lit(mark))).otherwise(clean)


def one_line(note: Column, cap: int = 400) -> Column:
    """A note without blanks at its ends; null if it has several lines or is longer than `cap`."""
    clean = trimmed(F.coalesce(note, F.lit("")))
    return F.when(~clean.contains("\n") & ~clean.contains("\r") & (F.length(clean) <= cap), clean)


def note_problem(note: Column, cap: int = 400) -> Column:
    """Why a note is refused; null if it is not."""
    clean = trimmed(F.coalesce(note, F.lit("")))
    return F.when(clean.contains("\n") | clean.contains("\r"), "several lines").when(F.length(clean) > cap, "too long")


def table_cells(line: Column) -> Column:
    """Cells of a Markdown table row; an escaped bar is no separator."""
    inner = F.regexp_replace(trimmed(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(trimmed(c), F.lit("\\|"), F.lit("|")))


def separator_row(cells: Column) -> Column:
    return (F.size(cells) > 0) & F.forall(cells, lambda c: c.rlike("^[-: ]*-[-: ]*$"))


def noise_cell(cell: Column) -> Column:
    return F.lower(F.trim(F.translate(cell, "`", ""))).isin("", "nan")


def truth(value: Column) -> Column:
    """A configuration's boolean; null where it is none."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off"), False)


def utc_parsed(text: Column) -> Column:
    """The time of an ISO text; without a zone it is UTC; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def utc_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def generated_region(text: Column, sentinel: str) -> Column:
    """From the line that equals the sentinel to the end; null without such a line."""
    found = F.regexp_extract(text, rf"(?sm)^(\Q{sentinel}\E$.*)", 1)
    return F.when(found != "", found)


def before_sentinel(text: Column, sentinel: str) -> Column:
    region = generated_region(text, sentinel)
    return F.when(region.isNull(), text).otherwise(F.left(text, F.length(text) - F.length(region)))


def region_hash(text: Column, sentinel: str) -> Column:
    """The SHA-256 of the generated region; null without one."""
    return F.sha2(generated_region(text, sentinel), 256)


def canonical_json(**fields: Column) -> Column:
    """A JSON object of texts and structs with its keys in order, no blanks, and characters beyond ASCII as they are."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def dump_fields(fields: dict[str, Column]) -> Column:
    """Frontmatter of scalar fields in their order; empty values as quotes, values that YAML reads as something else in quotes."""
    quoted = lambda v: F.when(v == "", F.lit("''")).when(v.rlike(r"^[\s\-?:,\[\]{}#&*!|>'\"%@`]|: |:$| #|^[0-9.+-]+$|^(?i:true|false|null|yes|no|on|off|~)$"), F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(v)
    lines = [F.concat(F.lit(f"{k}: "), quoted(F.coalesce(v, F.lit("")))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))
