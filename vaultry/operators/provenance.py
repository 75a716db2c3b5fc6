"""Provenance callouts: parsing and validation.

Parsing, the metadata of the blocks and the checks stay inside the row of their page (array
functions, no shuffle), so a task holds one page at a time, however many pages its split has.
A path is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab

# Callout grammar ---------------------------------------------------------------
BLOCK_ID = r"(?U)(?<!\S)\^([A-Za-z0-9][A-Za-z0-9_-]*)\b"
_OPENING = r"(?iU)\A[\s\x1c-\x1f]*>[\s\x1c-\x1f]*\[!provenance\]"
_TOP = r"(?U)\A([A-Za-z0-9_-]+)[\s\x1c-\x1f]*:[\s\x1c-\x1f]*(.*)\z"
_BLOCK = r"(?U)\A  ([A-Za-z0-9][A-Za-z0-9_-]*)[\s\x1c-\x1f]*:[\s\x1c-\x1f]*\z"
_FIELD = r"(?U)\A    ([A-Za-z0-9_-]+)[\s\x1c-\x1f]*:[\s\x1c-\x1f]*(.*)\z"
_SOURCE_START = r"""\A[\s\x1c-\x1f]*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:|[A-Za-z0-9._-]+/|/|\./)"""
# A comma-free run, where quotes protect commas and a backslash protects a quote.
_PIECE = (
    r"""(?:[^,'"]++|(?<=\\)['"]"""
    r"""|(?<!\\)'(?:[^']++|(?<=\\)')*+(?:(?<!\\)'|\z)"""
    r"""|(?<!\\)"(?:[^"]++|(?<=\\)")*+(?:(?<!\\)"|\z))++"""
)
_CSV_CELL = r'(?:\A|,)[ ]*((?:"(?:[^"]++|"")*+(?:"|\z))?+[^,]*+)'

NAMED_FIELDS = [
    "status", "confidence", "observed", "checked", "superseded_by", "provenance_quality",
    "review_mode", "evidence_latest",
]


# values ----------------------------------------------------------------------------------------
def unquoted(c: Column) -> Column:
    """One pair of equal quotes removed."""
    return F.when(
        c.rlike(r"(?s)\A(?:'.*'|\".*\")\z"), F.substring(c, F.lit(2), F.length(c) - 2)
    ).otherwise(c)


def is_list(raw: Column) -> Column:
    value = text.strip(raw)
    return value.startswith("[") & value.endswith("]")


def scalar(raw: Column) -> Column:
    """Text of a scalar value; NULL for null words."""
    return text.let(
        text.strip(raw), lambda value: F.when(~F.lower(value).isin("null", "none", "~"), unquoted(value))
    )


def _inner(raw: Column) -> Column:
    value = text.strip(raw)
    return text.strip(F.substring(value, F.lit(2), F.length(value) - 2))


def list_items(raw: Column) -> Column:
    """Comma-separated items with double-quoted cells; NULL when the value is no list."""
    inner = _inner(raw)
    cells = F.transform(
        F.regexp_extract_all(inner, F.lit(_CSV_CELL), F.lit(1)),
        lambda cell: F.when(
            cell.startswith('"'),
            F.replace(
                F.regexp_replace(cell, r'(?s)\A"((?:[^"]|"")*)"?', "$1"), F.lit('""'), F.lit('"')
            ),
        ).otherwise(cell),
    )
    items = F.transform(cells, lambda cell: unquoted(text.strip(cell)))
    return F.when(
        is_list(raw), F.when(inner == "", F.array().cast("array<string>")).otherwise(items)
    )


def source_items(raw: Column) -> Column:
    """Items of a source list.

    An unquoted comma belongs to the value when the item so far reads like a source and the text
    after the comma does not.  So once an item reads like a source, later pieces that do not are
    glued to it.
    """
    pieces = F.regexp_extract_all(_inner(raw), F.lit(_PIECE), F.lit(0))
    items = text.let(pieces, _glued)
    return F.when(
        is_list(raw), F.transform(F.filter(items, lambda item: item != ""), unquoted)
    )


def _glued(pieces: Column) -> Column:
    indexed = F.transform(
        pieces, lambda p, i: F.struct(i.alias("at"), p.rlike(_SOURCE_START).alias("starts"))
    )

    def heads(marked: Column) -> Column:
        first = F.array_position(F.transform(marked, lambda p: p["starts"]), F.lit(True))
        return text.let(
            first,
            lambda f: F.transform(
                F.filter(marked, lambda p: p["starts"] | (f == 0) | (p["at"] < f)),
                lambda p: p["at"],
            ),
        )

    def join(starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, i: text.strip(
                F.array_join(
                    F.slice(
                        pieces, at + 1, F.coalesce(F.get(starts, i + 1), F.size(pieces)) - at
                    ),
                    ",",
                )
            ),
        )

    return text.let(text.let(indexed, heads), join)


# callouts --------------------------------------------------------------------------------------
def _payload(all_lines: Column) -> Column:
    """Lines of the first callout without their quote marks; NULL when there is none."""
    opening = F.array_position(F.transform(all_lines, lambda l: l.rlike(_OPENING)), F.lit(True))

    def quoted(rest: Column) -> Column:
        stop = F.array_position(
            F.transform(rest, lambda l: text.lstrip(l).startswith(">")), F.lit(False)
        ).cast("int")
        return text.let(
            stop, lambda s: F.slice(rest, F.lit(1), F.when(s > 0, s - 1).otherwise(F.size(rest)))
        )

    def bodies(at: Column) -> Column:
        rest = F.slice(all_lines, at.cast("int") + 1, F.size(all_lines))
        return F.transform(
            text.let(rest, quoted),
            lambda l: text.rstrip(F.regexp_replace(text.lstrip(l), r"\A> ?", "")),
        )

    return text.let(F.nullif(opening, F.lit(0)), bodies)


_STATE = (
    "struct<inside:boolean,block:string,form:string,"
    "top:array<struct<key:string,raw:string>>,"
    "entries:array<struct<block:string,key:string,raw:string>>>"
)


def _grammar(payload: Column) -> Column:
    """Fold the payload into top-level entries and block entries.

    Every block header adds an entry with an empty key, so blocks without fields are kept.
    """
    start = F.from_json(
        F.lit('{"inside":false,"form":"absent","top":[],"entries":[]}'), _STATE
    )

    def state(acc, inside=None, block=None, form=None, top=None, entries=None):
        return F.struct(
            (acc["inside"] if inside is None else inside).alias("inside"),
            (acc["block"] if block is None else block).alias("block"),
            (acc["form"] if form is None else form).alias("form"),
            (acc["top"] if top is None else F.concat(acc["top"], F.array(top))).alias("top"),
            (acc["entries"] if entries is None else F.concat(acc["entries"], F.array(entries))).alias(
                "entries"
            ),
        )

    def entry(block, key, raw):
        return F.struct(block.alias("block"), key.alias("key"), raw.alias("raw"))

    none = F.lit(None).cast("string")

    def step(acc: Column, line: Column) -> Column:
        top_key, top_raw = F.regexp_extract(line, _TOP, 1), F.regexp_extract(line, _TOP, 2)
        opens = (top_key == "blocks") & (text.strip(top_raw) == "")
        block_id = F.regexp_extract(line, _BLOCK, 1)
        field_key, field_raw = F.regexp_extract(line, _FIELD, 1), F.regexp_extract(line, _FIELD, 2)
        return (
            F.when(
                line.rlike(_TOP) & opens, state(acc, F.lit(True), none, F.lit("mapping"))
            )
            .when(
                line.rlike(_TOP),
                state(
                    acc, F.lit(False), none,
                    F.when(top_key == "blocks", "other").otherwise(acc["form"]),
                    F.struct(top_key.alias("key"), top_raw.alias("raw")),
                ),
            )
            .when(~acc["inside"], acc)
            .when(
                line.rlike(_BLOCK),
                state(acc, block=block_id, entries=entry(block_id, F.lit(""), none)),
            )
            .when(
                line.rlike(_FIELD) & acc["block"].isNotNull(),
                state(acc, entries=entry(acc["block"], field_key, field_raw)),
            )
            .otherwise(acc)
        )

    return F.aggregate(payload, start, step)


def callouts(pages: DataFrame, content: str = "content") -> DataFrame:
    """``pages`` plus ``callout``: NULL or struct(form, schema, migration_status, entries)."""
    # the substring test spares pages without a callout the line split
    marked = F.when(F.lower(content).contains("[!provenance]"), text.lines(F.col(content)))
    parsed = pages.withColumn("_payload", text.let(marked, _payload)).withColumn(
        "_parsed", F.when(F.col("_payload").isNotNull(), _grammar(F.col("_payload")))
    )

    def last(key: str) -> Column:
        hits = F.filter(F.col("_parsed.top"), lambda e: e["key"] == key)
        return scalar(F.try_element_at(hits, F.lit(-1))["raw"])

    return parsed.withColumn(
        "callout",
        F.when(
            F.col("_parsed").isNotNull(),
            F.struct(
                F.col("_parsed.form").alias("form"), last("schema").alias("schema"),
                last("migration_status").alias("migration_status"),
                F.col("_parsed.entries").alias("entries"),
            ),
        ),
    ).drop("_payload", "_parsed")


def _block_fields(entries: Column) -> Column:
    """Fields under every block id, in order of its first header: array<struct(block_id, position, fields)>."""
    marked = F.transform(
        entries,
        lambda e, i: F.struct(i.alias("position"), e["block"].alias("block"), e["key"].alias("key"), e["raw"].alias("raw")),
    )

    def runs(all_entries: Column) -> Column:
        def of(heads: Column) -> Column:
            def fields(h: Column, i: Column) -> Column:
                end = F.coalesce(F.get(heads, i + 1)["position"], F.size(all_entries))
                return F.slice(all_entries, h["position"] + 2, end - h["position"] - 1)

            return F.transform(
                heads,
                lambda h, i: F.struct(h["block"].alias("block_id"), h["position"].alias("position"), fields(h, i).alias("fields")),
            )

        return text.let(F.filter(all_entries, lambda e: e["key"] == ""), of)

    def merged(found: Column) -> Column:
        ids = F.transform(found, lambda r: r["block_id"])

        def one(same: Column) -> Column:
            return F.struct(
                F.get(same, F.lit(0))["block_id"].alias("block_id"), F.get(same, F.lit(0))["position"].alias("position"),
                F.flatten(F.transform(same, lambda r: r["fields"])).alias("fields"),
            )

        # ids named twice are rare
        return text.let(
            F.array_distinct(ids),
            lambda names: F.when(F.size(names) == F.size(found), found).otherwise(
                F.transform(names, lambda n: text.let(F.filter(found, lambda r: r["block_id"] == n), one))
            ),
        )

    return text.let(text.let(marked, runs), merged)


def metadata_of(callout: Column) -> Column:
    """Metadata of the block ids of a callout: array of structs, see :func:`block_metadata`; NULL without a callout."""

    def record(block: Column) -> Column:
        def latest(key: str) -> Column:
            return F.try_element_at(F.filter(block["fields"], lambda e: e["key"] == key), F.lit(-1))["raw"]

        def read(given: Column) -> Column:
            return F.struct(
                block["block_id"].alias("block_id"), block["position"].alias("position"),
                F.size(block["fields"]).cast("bigint").alias("field_count"),
                source_items(given["sources"]).alias("sources"),
                scalar(given["sources"]).isNotNull().alias("sources_given"),
                *[given[key].isNotNull().alias(f"{key}_given") for key in ("status", "confidence")],
                *[scalar(given[key]).alias(key) for key in NAMED_FIELDS],
            )

        return text.let(F.struct(*[latest(key).alias(key) for key in ("sources", *NAMED_FIELDS)]), read)

    usable = F.when(callout["form"] != "other", callout["entries"])
    return F.transform(_block_fields(usable), record)


def block_metadata(with_callouts: DataFrame) -> DataFrame:
    """One row per (page, block id) named in a callout.

    Columns: path, block_id, position, the named fields, ``sources`` (array), ``sources_given``,
    ``status_given`` / ``confidence_given``, ``field_count``.
    """
    return with_callouts.select(
        "path", F.explode_outer(metadata_of(F.col("callout"))).alias("m")
    ).where("m IS NOT NULL").select("path", "m.*")


def ids_in(content: Column) -> Column:
    """Block ids outside fences, in order, repeats kept."""
    found = F.regexp_extract_all(text.outside_fences(text.lines(content)), F.lit(BLOCK_ID), F.lit(1))
    # the substring test spares pages without a mark the line split
    return F.when(content.contains("^"), found).otherwise(F.array().cast("array<string>"))


def occurrences(ids: Column) -> Column:
    """How often each of some strings occurs: array<struct(block_id, occurrences)>."""

    def counted(ordered: Column) -> Column:
        first = F.transform(ordered, lambda v, i: F.when((i == 0) | (v != F.get(ordered, i - 1)), i))
        return text.let(
            F.filter(first, lambda i: i.isNotNull()),
            lambda starts: F.transform(
                starts,
                lambda at, i: F.struct(
                    F.get(ordered, at).alias("block_id"),
                    (F.coalesce(F.get(starts, i + 1), F.size(ordered)) - at).cast("bigint").alias("occurrences"),
                ),
            ),
        )

    return text.let(F.sort_array(ids), counted)


# validation ------------------------------------------------------------------------------------
def _issue(when: Column, code: str, message: Column, severity: str = "error") -> Column:
    return F.when(
        when,
        F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(severity).alias("severity")),
    )


_ISSUES = "array<struct<block_id:string,code:string,message:string,severity:string>>"


def _date(value: Column) -> Column:
    return F.try_to_date(value, "yyyy-M-d")


def _issues_of(named, in_text: Column, minimal_stamp: Column) -> Column:
    """Issues of the metadata of one block: array<struct(code, message, severity)>; ``named(key)`` gives its columns."""
    block = named("block_id")
    status, confidence = named("status"), named("confidence")
    listed = named("sources").isNotNull()

    def says(*pieces) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("None")) for p in pieces])

    def some(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    def bad_date(key: str) -> Column:
        value = named(key)
        return _issue(
            some(value) & (_date(value).isNull() | ~value.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z")),
            "invalid-date", says(key, " for '", block, "' must use YYYY-MM-DD."),
        )

    issues = F.array(
        _issue(
            ~in_text, "missing-block-id",
            says("Provenance references '", block, "', but no matching block ID exists."),
        ),
        _issue(
            named("sources_given") & ~listed, "invalid-sources",
            says("Sources for '", block, "' must be a list."),
        ),
        _issue(
            ~minimal_stamp & status.isin(vocab.CLAIM_STATUSES)
            & (F.coalesce(F.size(named("sources")), F.lit(0)) <= 0),
            "missing-sources",
            says("Block '", block, "' asserts status '", status, "' but lists no sources."), "warning",
        ),
        _issue(
            status.isNotNull() & ~status.isin(vocab.STATUSES), "invalid-status",
            says("Status '", status, "' is not allowed."),
        ),
        _issue(
            confidence.isNotNull() & ~confidence.isin(vocab.CONFIDENCES), "invalid-confidence",
            says("Confidence '", confidence, "' is not allowed."),
        ),
        _issue(
            (status == "superseded") & ~some(named("superseded_by")), "missing-superseded-by",
            says("Superseded block '", block, "' must name superseded_by."),
        ),
        bad_date("observed"),
        bad_date("checked"),
        _issue(
            _date(named("observed")) > _date(named("checked")), "date-order",
            says("observed must not be later than checked for '", block, "'."),
        ),
    )
    return F.filter(issues, lambda i: i.isNotNull())


def metadata_issues(metadata: DataFrame) -> DataFrame:
    """Issues of metadata rows, one output row per issue, without a shuffle.

    Needs the columns of :func:`block_metadata` plus ``in_text`` (the id occurs in the page) and
    ``minimal_stamp``.
    """
    issues = _issues_of(F.col, F.col("in_text"), F.col("minimal_stamp"))
    return metadata.select(
        "path", "block_id", F.explode_outer(issues).alias("issue")
    ).where("issue IS NOT NULL").select("path", "block_id", "issue.*")


def validate(pages: DataFrame, content: str = "content") -> DataFrame:
    """All issues of a set of pages: path, block_id, code, message, severity."""
    callout = F.col("callout")

    def located(block: Column, issue: Column) -> Column:
        return F.struct(block.alias("block_id"), *[issue[key].alias(key) for key in ("code", "message", "severity")])

    def duplicates(ids: Column) -> Column:
        def issue(o: Column) -> Column:
            return F.struct(
                o["block_id"].alias("block_id"), F.lit("duplicate-block-id").alias("code"),
                F.concat(
                    F.lit("Block ID '"), o["block_id"], F.lit("' appears "), o["occurrences"].cast("string"), F.lit(" times."),
                ).alias("message"),
                F.lit("error").alias("severity"),
            )

        return F.transform(F.filter(occurrences(ids), lambda o: o["occurrences"] > 1), issue)

    page_level = F.filter(
        F.array(
            _issue(
                callout.isNotNull() & ~F.col("callout.schema").eqNullSafe(vocab.PROVENANCE_SCHEMA), "invalid-schema",
                F.lit(f"Expected schema '{vocab.PROVENANCE_SCHEMA}'."),
            ),
            _issue(
                F.col("callout.form") == "other", "invalid-blocks",
                F.lit("Provenance callout must contain a blocks mapping."),
            ),
        ),
        lambda i: i.isNotNull(),
    )

    def of_blocks(ids: Column, minimal: Column) -> Column:
        def of(block: Column) -> Column:
            return F.transform(
                _issues_of(lambda key: block[key], F.array_contains(ids, block["block_id"]), minimal),
                lambda i: located(block["block_id"], i),
            )

        found = F.flatten(F.transform(metadata_of(callout), of))
        return F.coalesce(found, F.array().cast(_ISSUES))

    def issues(page: Column) -> Column:
        return F.concat(
            duplicates(page["ids"]), F.transform(page_level, lambda i: located(F.lit(None).cast("string"), i)),
            of_blocks(page["ids"], page["minimal"]),
        )

    minimal = F.coalesce(F.col("callout.migration_status") == vocab.MINIMAL_MIGRATION, F.lit(False))
    page = F.struct(ids_in(F.col(content)).alias("ids"), minimal.alias("minimal"))
    found = callouts(pages, content).select("path", F.explode_outer(text.let(page, issues)).alias("issue"))
    return found.where("issue IS NOT NULL").select("path", "issue.*")


def lint_summary(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: files, issues, errors, warnings."""
    files = pages.agg(F.count(F.lit(1)).alias("files"))
    counts = issues.agg(
        F.count(F.lit(1)).alias("issues"),
        F.count_if(F.coalesce("severity", F.lit("error")) == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    return counts.select(files.scalar().alias("files"), "issues", "errors", "warnings")
