"""Text functions as Column expressions. Character classes are those under which Java agrees with the vault's text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultspark.schema import REPRODUCIBILITY, WEIGHTS

#: Character classes, the forms of links, references, headings and dates.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
LINK = r"\[\[([^\]|#]+?)(?:\|[^\]]+)?(?:#[^\]]+)?\]\]"
ARXIV_REF = r"(?i)(?:arxiv[:\s]+|abs/|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5})(?:v\d+)?"
DOI_REF = r"(?i)\b(10\.\d{4,}/[^\s,;)]+)"
BIBLIOGRAPHY = r"(?i)(?:^|\n)\s*(?:\d+[.\s]+)?(?:references|bibliography)\s*\n"
NUMERIC_CITE = r"\[\s*\d+(?:\s*[-–,]\s*\d+)*\s*\]"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def kebab(c: Column, max_len: int = 60) -> Column:
    low = F.lower(c)
    for a, b in (("α", "alpha"), ("β", "beta"), ("→", "to")):
        low = F.replace(low, F.lit(a), F.lit(b))
    dashed = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, max_len), "-+$", "")


def paper_slug(title: Column, date: Column, as_of: str) -> Column:
    """Month of the date, or of as_of (YYYY-MM-DD) where it is malformed, then the title."""
    month = F.substring(F.coalesce(date, F.lit("")), 1, 7)
    well = (F.length(month) == 7) & (F.substring(month, 5, 1) == "-")
    return F.concat(F.when(well, month).otherwise(F.lit(as_of[:7])), F.lit("-"), kebab(title, 40))


def finding_slug(statement: Column) -> Column:
    k = kebab(statement, 55)
    for word in ("the", "a", "an", "is", "are"):
        k = F.regexp_replace(k, f"^{word}-", "")
    return F.substring(F.concat(F.lit("finding-"), k), 1, 60)


def normalize(c: Column) -> Column:
    """Lower case, punctuation to spaces, white space collapsed; null becomes empty."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(low, NOT_WORD_OR_SPACE, " "), f"{SPACE}+", " "))


def wrap_link(c: Column) -> Column:
    s = strip(c)
    return F.when(F.startswith(s, F.lit("[[")) & F.endswith(s, F.lit("]]")), s).otherwise(F.concat(F.lit("[["), s, F.lit("]]")))


def unwrap_link(c: Column) -> Column:
    s = strip(c)
    inner = F.when(F.startswith(s, F.lit("[[")) & F.endswith(s, F.lit("]]")), F.substring(s, F.lit(3), F.greatest(F.length(s) - 4, F.lit(0)))).otherwise(s)
    return strip(F.substring_index(F.substring_index(inner, "|", 1), "#", 1))


def links(c: Column) -> Column:
    """Targets of all links in order, with repeats."""
    return F.regexp_extract_all(c, F.lit(LINK), F.lit(1))


def bibliography(c: Column) -> Column:
    """From the references heading on, or the whole text without one."""
    at = F.regexp_instr(c, F.lit(BIBLIOGRAPHY))
    return F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(c)


def arxiv_refs(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(ARXIV_REF), F.lit(1)), F.lower)


def doi_refs(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(DOI_REF), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, "[.,;)]+$", "")))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, NUMERIC_CITE, ""), "[ \t]+", " "), "\n{3,}", "\n\n")


def html_strip(c: Column) -> Column:
    """Scripts, styles and tags removed, white space collapsed; character references stay as they are."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<script.*?</script>", ""), r"(?is)<style.*?</style>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), f"{SPACE}+", " "))


def overall_quality(credibility: Column, rigor: Column, reproducibility: Column) -> Column:
    """Weighted score to one decimal; an unknown or missing reproducibility scores least, a null score makes the result null."""
    score = F.lit(1)
    for name, value in REPRODUCIBILITY.items():
        score = F.when(reproducibility == name, value).otherwise(score)
    a, b, c = WEIGHTS
    return F.round(F.lit(a) * credibility + F.lit(b) * rigor + F.lit(c) * score, 1)


def is_iso(c: Column) -> Column:
    """The shape of a date, not its validity."""
    return c.rlike(ISO_DATE)


def sha_key(c: Column) -> Column:
    return F.sha2(c, 256)


def pdf_url(arxiv_id: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/pdf/"), F.substring_index(arxiv_id, "v", 1), F.lit(".pdf"))


def identity(c: Column, arxiv: bool = False) -> Column:
    """A key for equality: trimmed, lower case, empty as null; an arXiv id without its version."""
    s = F.substring_index(c, "v", 1) if arxiv else c
    return F.nullif(F.lower(strip(s)), F.lit(""))


def falsy_to(c: Column, other: Column) -> Column:
    """The other value for null and for an empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def render(template: Column, values: dict[str, Column]) -> Column:
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), v)
    return template


def file_name(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("-"))


def split_list(c: Column, by: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), strip), lambda x: x != "")


def open_url(vault: Column, file: Column) -> Column:
    return F.concat(F.lit("obsidian://open?vault="), vault, F.lit("&file="), file)


def file_sort_key(stem: Column) -> Column:
    """Files order by name with the extension, so 'a-b' comes before 'a'."""
    return F.concat(stem, F.lit(".md"))
