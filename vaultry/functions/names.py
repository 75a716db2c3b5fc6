"""Keys under which names, titles and paths are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths, text, vocab

# Characters that names drop, date prefixes and source suffixes of titles.
_SUBSTITUTED = r"""[_:!#$%&*<>?/\\|'"-]|[^\x00-\x7f]"""
_DATE_PREFIX = rf"(?U)\A\d{{4}}-\d{{2}}-\d{{2}}{text.SPACE}+"
_SOURCE_SUFFIX = r"(?i)\.(?:docx?|pptx?|xlsx?|pdf|html?|eml|vtt|txt)\z"


def straight_quotes(c: Column) -> Column:
    return F.translate(c, vocab.CURLY, vocab.STRAIGHT)


def has_curly(c: Column) -> Column:
    return c.rlike(f"[{vocab.CURLY}]")


def fuzzy_name(c: Column) -> Column:
    """Substituted characters become blanks, blanks collapse, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, _SUBSTITUTED, " "), r"[\s\x1c-\x1f]+", " ")))


def plain_title(c: Column) -> Column:
    """Trimmed, lower-cased title with single blanks."""
    # ASCII words with one blank between them need no more than lower case
    plain = c.rlike(r"\A[!-~]++(?: [!-~]++)*+\z")
    return F.when(plain, F.lower(c)).otherwise(text.collapse_spaces(F.lower(text.strip(c))))


def title_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[^A-Za-z0-9]+", " ")))


def path_key(c: Column) -> Column:
    """Alphanumeric key per component; components without any are dropped."""
    keyed = F.transform(paths.parts(c), title_key)
    return F.array_join(F.filter(keyed, lambda k: k != ""), "/")


def title_variants(c: Column) -> Column:
    """A title and its shorter spellings: no date prefix, no source extension, text after " - ".

    The strips are repeated until nothing is left to strip; a title cannot need more rounds than
    it has separators, dates and extensions.
    """

    def after_dash(v: Column) -> Column:
        return F.when(v.contains(" - "), text.strip(F.regexp_replace(v, r"(?s)\A.*? - ", ""))).otherwise("")

    def shorter(found: Column) -> Column:
        spelled = F.transform(
            found,
            lambda v: F.array(
                v,
                text.strip(F.regexp_replace(v, _DATE_PREFIX, "")),
                text.strip(F.regexp_replace(v, _SOURCE_SUFFIX, "")),
                after_dash(v),
            ),
        )
        return F.array_distinct(F.flatten(spelled))

    marks = F.regexp_count(c, F.lit(r" - |\d{4}-\d{2}-\d{2}|\.[A-Za-z]{3,4}"))
    found = F.aggregate(
        F.sequence(F.lit(0), marks), F.array(text.strip(c)), lambda acc, _: shorter(acc)
    )
    return F.filter(found, lambda v: v != "")


def is_external(c: Column) -> Column:
    return c.rlike(r"\A(?:http://|https://|ftp://|mailto:)")


def file_name_safe(c: Column) -> Column:
    """ASCII spelling of typographic characters; accented letters stay."""
    return text.replace_each(c, vocab.FILENAME_SPELLING)


def shell_safe_name(c: Column) -> Column:
    """Shell-unsafe and non-ASCII characters become ``_``; blanks before the extension go."""
    replaced = F.regexp_replace(c, r"""['"!#$%&*<>?/\\|]|[^\x00-\x7f]""", "_")
    return F.regexp_replace(replaced, r"[\s\x1c-\x1f]+(?=\.[^.]*\z)", "")


def page_argument(c: Column, keep_anchor: bool = False) -> Column:
    """Page path named by a user: link brackets, alias and (for queries) anchor removed."""
    value = text.strip(c)
    inner = F.regexp_extract(value, r"(?s)\A\[\[(.*)\]\]\z", 1)
    value = F.when(
        value.startswith("[[") & value.endswith("]]"), F.substring_index(inner, "|", 1)
    ).otherwise(value)
    if not keep_anchor:
        value = F.substring_index(value, "#", 1)
    value = F.when(value.endswith(".md"), value).otherwise(F.concat(value, F.lit(".md")))
    return value if keep_anchor else F.regexp_replace(value, r"\A/+", "")
