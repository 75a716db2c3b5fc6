"""Link extraction, resolution, broken links and suggested fixes.

Resolution never compares a link with every file.  Each distinct target is turned into a few
``(scope, key)`` rows, each file into the keys under which it can be found, and one semi-join
decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter, links, names, paths, text, vocab
from ..functions.skew import shuffled
from ..session import checkpointed


def extract(notes: DataFrame, images: bool = False, skip_front_matter: bool = False) -> DataFrame:
    """Links of notes (path, content): path, line, position, type, raw, target, in_front_matter."""
    # only notes with a bracket can hold a link; the line split runs once per note
    rows = notes.where(F.col("content").contains("[")).select(
        "path", text.lines(F.col("content")).alias("_lines")
    )
    # computed before the explode, which would otherwise repeat it for every link
    rows = rows.withColumn("_front_end", frontmatter.closing_line_number(F.col("_lines")))
    # a row for each line and then for each match: what is computed for it is compiled, which a lambda over an array is not;
    # the outer forms keep Spark from adding filters that would parse every note again
    split = rows.select("path", "_front_end", F.posexplode_outer("_lines").alias("_at", "_text")).where(F.col("_text").contains("["))
    kinds = links.in_line(F.col("_text"), images)
    names_ = [f"_raws{i}" for i in range(len(kinds))]
    counts = [f"_n{i}" for i in range(len(kinds))]
    matched = split.select("path", "_front_end", (F.col("_at") + 1).alias("line"), *[k.alias(n) for k, n in zip(kinds, names_)]).select(
        "path", (F.col("line") <= F.col("_front_end")).alias("in_front_matter"), "line", *[F.size(n).alias(c) for n, c in zip(names_, counts)],
        F.posexplode_outer(F.flatten(F.array(*names_))).alias("position", "raw"),
    ).where("raw IS NOT NULL")
    kind, target = links.kind_and_target(F.col("raw"), F.col("position"), [F.col(c) for c in counts])
    found = matched.select("path", "line", "position", kind.alias("type"), "raw", target.alias("target"), "in_front_matter")
    return found.where(~F.col("in_front_matter")) if skip_front_matter else found


#: Scopes in which a file is found.  file / dir: full path; noext: full path without a linkable extension; top_*: the same below
#: wiki/ or raw/; stem: stem of a scanned page; suffix: every trailing run of components with straight quotes.
_SCOPES = ("file", "dir", "noext", "top_file", "top_dir", "top_noext", "stem", "suffix")


def _key(value: Column, scopes: dict[str, Column | None]) -> Column:
    """(key, scopes): ``value`` without ``.md``, and a bit for each scope whose condition holds (none: always).

    Where ``.md`` was cut the bits are others, so that all spellings of a path have one key, and two sides that
    share a key and a bit have equal texts in an equal scope.
    """
    md = value.endswith(".md")
    bits = F.lit(0)
    for scope, when in scopes.items():
        bit = F.lit(1 << 2 * _SCOPES.index(scope))
        bits = bits.bitwiseOR(bit if when is None else F.when(when, bit).otherwise(0))
    return F.struct(
        F.when(md, F.left(value, F.length(value) - 3)).otherwise(value).alias("key"),
        F.when(md, F.shiftleft(bits, 1)).otherwise(bits).alias("scopes"),
    )


def file_keys(files: DataFrame) -> DataFrame:
    """Keys under which the files of a vault can be found, one row each: key, scopes; ``files``: path.

    A path's trailing runs are its keys; the other scopes of a plain page are bits of the same rows.
    """
    path, straight, below, linkable, stem = (F.col(c) for c in ("path", "_straight", "_below", "_linkable", "_stem"))
    ext = F.regexp_extract(path, r"(?s)[^/](\.[^./]+)\z", 1)

    def cut(value: Column) -> Column:
        return F.regexp_replace(value, r"\.[^./]+\z", "")

    def bit(scope: str, md: Column) -> Column:
        return F.when(md, 2 << 2 * _SCOPES.index(scope)).otherwise(1 << 2 * _SCOPES.index(scope))

    def bits(when: Column, value: Column) -> Column:
        return F.when(when, value).otherwise(0)

    top = path.startswith("wiki/") | path.startswith("raw/")
    # columns of their own, so that what several keys share is computed once
    forms = files.select(
        "path", names.straight_quotes(path).alias("_straight"), path.endswith(".md").alias("_ends"),
        F.when(top, F.substring(path, F.locate("/", path) + 1, F.length(path))).otherwise("").alias("_below"),
        ext.isin(vocab.LINKABLE_EXTENSIONS).alias("_linkable"), F.when(paths.is_scanned_page(path), paths.stem(path)).alias("_stem"),
    ).withColumn("_plain", straight == path).withColumns({
        "_cut": F.when(linkable, cut(path)),
        # a path that is one ``.md`` longer than its cut
        "_page": F.col("_plain") & F.col("_ends") & linkable & ~path.endswith(".md.md"),
    })
    plain, page, whole = F.col("_plain"), F.col("_page"), F.col("_cut")
    under = linkable & (below != "")
    forms = forms.withColumns({
        "_tails": paths.trailing_paths(F.when(F.col("_ends"), F.left(straight, F.length(straight) - 3)).otherwise(straight)),
        "_suffix": bit("suffix", F.col("_ends")),
        "_first": bits(plain, bit("file", F.col("_ends"))).bitwiseOR(bits(page, bit("noext", F.lit(False)))),
        "_second": bits(plain & (below != ""), bit("top_file", F.col("_ends"))).bitwiseOR(bits(page & under, bit("top_noext", F.lit(False)))),
        "_last": bits(page & stem.isNotNull(), bit("stem", F.lit(False))),
        "_others": F.array(
            F.when(~plain, _key(path, {"file": None})), F.when(linkable & ~page, _key(whole, {"noext": None})),
            F.when(~plain & (below != ""), _key(below, {"top_file": None})),
            F.when(under & ~page, _key(cut(below), {"top_noext": None})), F.when(stem.isNotNull() & ~page, _key(stem, {"stem": None})),
        ),
    })

    def tail(value: Column, at: Column) -> Column:
        scopes = F.col("_suffix").bitwiseOR(bits(at == 0, F.col("_first"))).bitwiseOR(bits(at == 1, F.col("_second")))
        return F.struct(value.alias("key"), scopes.bitwiseOR(bits(at == F.size("_tails") - 1, F.col("_last"))).alias("scopes"))

    others = F.when(page, F.array().cast("array<struct<key: string, scopes: int>>")).otherwise(F.col("_others"))
    rows = forms.select(F.explode_outer(F.concat(F.transform("_tails", tail), others)).alias("k")).where("k IS NOT NULL").select("k.*")
    return rows.unionByName(_folder_keys(files)).groupBy("key").agg(F.bit_or("scopes").alias("scopes"))


def _folder_keys(files: DataFrame) -> DataFrame:
    """Keys of the folders that hold files, at every depth."""

    def leading(components: Column) -> Column:
        n = F.sequence(F.lit(1), F.size(components))
        return F.transform(n, lambda i: F.array_join(F.slice(components, F.lit(1), i), "/"))

    inner = F.regexp_replace("path", r"/[^/]*+\z", "")
    holding = files.where(F.col("path").contains("/")).select(inner.alias("_folder")).distinct()
    every = holding.select(F.explode_outer(text.let(F.split("_folder", "/"), leading)).alias("_folder")).where("_folder IS NOT NULL")
    below = F.regexp_extract("_folder", r"(?s)\A(?:wiki|raw)/(.+)\z", 1)
    both = F.array(_key(F.col("_folder"), {"dir": None}), F.when(below != "", _key(below, {"top_dir": None})))
    return every.select(F.explode_outer(both).alias("k")).where("k IS NOT NULL").select("k.*")


def _with_md(c: Column, resolved: Column) -> Column:
    """``paths.resolved`` of a path with ``.md`` behind it, ``resolved`` being that of the path."""
    odd_end = c.rlike(r"(?:\A|/)\.{0,2}\z")
    return F.when(odd_end, paths.resolved(F.concat(c, F.lit(".md")))).otherwise(F.concat(resolved, F.lit(".md")))


def _with_forms(targets: DataFrame, column: str = "target") -> DataFrame:
    """Forms of a target that several keys share, computed once."""
    target = F.col(column)
    return targets.withColumns({"_full": paths.resolved(target), "_known": paths.known_extension(target)}).withColumns(
        {
            "_md": _with_md(target, F.col("_full")),
            # a path that needs no folding is tidy
            "_nested": F.when(F.col("_full") == target, target.contains("/")).otherwise(paths.tidy(target).contains("/")),
        }
    )


def _target_keys(targets: DataFrame) -> DataFrame:
    """Keys that prove the targets of links exist: wiki_style, target, _folder, key, scopes.

    A Markdown target stands next to the note in ``_folder``, then at the root.
    """
    target, wiki = F.col("target"), F.col("wiki_style")
    loose = names.straight_quotes(F.when(target.startswith("./"), F.substring(target, 3, 1 << 30)).otherwise(target))
    near = F.when(wiki, target).when(F.col("_folder") == "", F.col("_other")).otherwise(F.concat("_folder", F.lit("/"), "_other"))
    forms = targets.withColumn("_other", F.when(wiki, loose).otherwise(paths.url_decoded(target))).withColumn("_near", near)
    forms = _with_forms(forms, "_near").withColumns({
        "_root": F.when(~wiki, paths.resolved(F.col("_other"))),
        "_stem": F.when(wiki & F.col("_known"), paths.stem(target)).when(wiki, paths.name(target)),
    })
    forms = forms.withColumn("_root_md", F.when(~wiki, _with_md(F.col("_other"), F.col("_root"))))
    full, md, known, folder, other = (F.col(c) for c in ("_full", "_md", "_known", "_nested", "_other"))
    inside = ~target.startswith("/")
    open_end = ~known & ~target.endswith("/")

    def either(as_wiki: Column, as_md: Column) -> Column:
        return F.when(wiki, as_wiki).otherwise(as_md)

    keys = [
        either(
            F.when(inside, _key(full, {
                "file": None, "dir": None, "noext": open_end, "top_file": folder, "top_dir": folder, "top_noext": open_end & folder,
            })),
            _key(full, {"file": None}),
        ),
        either(F.when(inside & known, _key(md, {"file": None, "top_file": folder})), _key(md, {"file": None})),
        either(_key(other, {"suffix": None}), _key(F.col("_root"), {"file": None})),
        either(_key(F.concat(other, F.lit(".md")), {"suffix": None}), _key(F.col("_root_md"), {"file": None})),
        F.when(wiki & ~folder, _key(F.col("_stem"), {"stem": None})),
    ]
    return _each_key_once(forms, ["wiki_style", "target", "_folder"], keys)


def _each_key_once(targets: DataFrame, kept: list[str], keys: list[Column]) -> DataFrame:
    """Columns ``kept`` with a row for each key (key, scopes); equal keys of a target are one row with the scopes of all."""
    n = range(len(keys))
    # columns of their own: fields of a struct would be computed again wherever they are named
    held = {f"_key{i}": keys[i]["key"] for i in n} | {f"_scopes{i}": keys[i]["scopes"] for i in n}
    merged = []
    for i in n:
        key, scopes, seen = F.col(f"_key{i}"), F.col(f"_scopes{i}"), F.lit(False)
        for j in n:
            same = F.coalesce(F.col(f"_key{j}") == key, F.lit(False))
            if j < i:
                seen = seen | same
            elif j > i:
                scopes = scopes.bitwiseOR(F.when(same, F.col(f"_scopes{j}")).otherwise(0))
        merged.append(F.when(key.isNotNull() & ~seen, F.struct(key.alias("key"), scopes.alias("scopes"))))
    rows = targets.select(*kept, *[value.alias(name) for name, value in held.items()]).select(
        *kept, F.explode_outer(F.array_compact(F.array(*merged))).alias("k")
    )
    return rows.where("k IS NOT NULL").select(*kept, "k.*")


def _existing(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keyed`` (key, scopes) that share a key and a scope with a file; ``keys``: see :func:`file_keys`."""
    known = keys.select(F.col("key").alias("_key"), F.col("scopes").alias("_scopes"))
    meets = (F.col("key") == F.col("_key")) & (F.col("scopes").bitwiseAND(F.col("_scopes")) != 0)
    return keyed.join(shuffled(known), meets, "left_semi")


def is_wiki_style(kind: Column, raw: Column) -> Column:
    return (kind == "wikilink") | ((kind == "image") & raw.contains("[["))


def checked_links(found: DataFrame) -> DataFrame:
    """Links that count: no empty and no anchor-only targets; ``external`` and ``wiki_style`` added."""
    return found.where((F.col("target") != "") & ~F.col("target").startswith("#")).withColumns(
        {
            "external": names.is_external(F.col("target")),
            "wiki_style": is_wiki_style(F.col("type"), F.col("raw")),
        }
    )


def broken(found: DataFrame, files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Links whose target is not in the vault, with the reason; ``keys``: :func:`file_keys` of the files where they are at hand.

    Every distinct target is resolved once, however many links share it.
    """
    local = checked_links(found).where("NOT external").withColumn(
        "_folder", F.when(F.col("wiki_style"), "").otherwise(paths.parent(F.col("path")))
    )
    keyed = _target_keys(local.select("wiki_style", "target", "_folder").distinct())
    resolved = _existing(keyed, file_keys(files) if keys is None else keys).select("wiki_style", "target", "_folder")
    missing = local.join(shuffled(resolved), ["wiki_style", "target", "_folder"], "left_anti")
    return missing.select(
        "path", "line", "position", "type", "raw", "target", "in_front_matter", "wiki_style",
        F.lit("file not found").alias("reason"),
    )


def suggestions(targets: DataFrame, files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Replacement for broken wikilink targets: target, suggested_fix, rule; ``keys``: see :func:`broken`.

    ``fuzzy``: the only page (or the page in the named folder) whose name is equal after
    normalisation.  ``space``: the file exists once blanks before the extension are removed.
    """
    target = F.col("target")
    known = paths.known_extension(target)
    named = targets.select("target").distinct().withColumns(
        {
            "_tidy": paths.tidy(target),
            "_key": names.fuzzy_name(F.when(known, paths.stem(target)).otherwise(paths.name(target))),
        }
    )
    # both rules read them; whatever gives the targets runs once
    wanted = checkpointed(named.select("target", "_key", paths.parent(F.col("_tidy")).alias("_folder")))
    pages = files.where(F.col("path").endswith(".md")).select(
        "path", paths.parent(F.col("path")).alias("_folder"), paths.stem(F.col("path")).alias("_stem"),
        names.fuzzy_name(paths.stem(F.col("path"))).alias("_key"),
    )
    unique = pages.where(paths.is_scanned_page(F.col("path"))).groupBy("_key").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_stem").alias("fuzzy")
    ).where("_n = 1").select(F.lit("").alias("_folder"), "_key", "fuzzy")
    in_folder = pages.where("_folder <> ''").groupBy("_folder", "_key").agg(F.min("_stem").alias("_stem"))
    placed = in_folder.select("_folder", "_key", F.concat("_folder", F.lit("/"), "_stem").alias("fuzzy"))
    # a bare name means the only page, a name in a folder the page there
    fuzzy = wanted.where("_key <> ''").join(shuffled(unique.unionByName(placed)), ["_folder", "_key"]).select("target", "fuzzy")

    spaced = wanted.where(
        (paths.suffix(target) != "") & paths.stem(target).rlike(rf"(?U)[^\s]{text.SPACE}+\z")
    ).withColumn(
        "_fixed",
        F.concat(
            F.when(F.col("_folder") == "", "").otherwise(F.concat("_folder", F.lit("/"))),
            text.rstrip(paths.stem(target)), paths.suffix(target),
        ),
    )
    is_md = F.lower(paths.suffix(target)) == ".md"
    keyed = _each_key_once(spaced, ["target", "_folder", "_fixed"], [_key(F.col("_fixed"), {"suffix": None})])
    space = _existing(keyed, file_keys(files) if keys is None else keys).select(
        "target",
        F.when(is_md & (F.col("_folder") == ""), paths.stem(F.col("_fixed"))).otherwise(F.col("_fixed")).alias("space"),
    )
    none = F.lit(None).cast("string")
    either = fuzzy.withColumn("space", none).unionByName(space.withColumn("fuzzy", none))
    return either.groupBy("target").agg(F.max("fuzzy").alias("fuzzy"), F.max("space").alias("space")).select(
        "target", F.coalesce("fuzzy", "space").alias("suggested_fix"),
        F.when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("space").alias("rule"),
    )


def resolve_to_page(targets: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """Unique file behind wikilink targets: target, path.

    In order: the exact file, with ``.md``, below wiki/ and below raw/ (for targets with a
    folder), the only page of that stem.  ``pages`` gives the stems.
    """
    target = F.col("target")
    full, md, known, folder = (F.col(c) for c in ("_full", "_md", "_known", "_nested"))
    inside = ~target.startswith("/")

    def candidate(order: int, scope: str, key: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(order).alias("order"), F.lit(scope).alias("scope"), key.alias("key")))

    def below(top: str, path: Column) -> Column:
        return F.concat(F.lit(f"{top}/"), path)

    # all candidates in one pass, so that whatever gives the targets runs once
    keyed = _with_forms(targets.select("target").distinct()).select(
        "target",
        F.explode_outer(
            F.filter(
                F.array(
                    candidate(1, "path", full, inside), candidate(2, "path", md, inside & ~known),
                    candidate(3, "path", below("wiki", full), inside & folder),
                    candidate(4, "path", below("wiki", md), inside & folder & ~known),
                    candidate(5, "path", below("raw", full), inside & folder),
                    candidate(6, "path", below("raw", md), inside & folder & ~known),
                    candidate(7, "stem", F.when(known, paths.stem(target)).otherwise(paths.name(target)), F.lit(True)),
                ),
                lambda c: c["key"].isNotNull(),
            )
        ).alias("c"),
    ).select("target", "c.*")
    stems = pages.groupBy(paths.stem(F.col("path")).alias("key")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("path").alias("path")
    ).where("_n = 1")
    known_keys = files.select(F.lit("path").alias("scope"), F.col("path").alias("key"), "path").unionByName(
        stems.select(F.lit("stem").alias("scope"), "key", "path")
    )
    return keyed.join(shuffled(known_keys), ["scope", "key"]).groupBy("target").agg(
        F.min_by("path", "order").alias("path")
    )


def counts_by_type(found: DataFrame, broken_links: DataFrame) -> DataFrame:
    """Found and broken links per type."""
    all_types = checked_links(found).groupBy("type").agg(F.count(F.lit(1)).alias("links"))
    bad = broken_links.groupBy("type").agg(F.count(F.lit(1)).alias("broken"))
    return all_types.join(bad, "type", "left").na.fill(0, ["broken"])


def source_context(entries: DataFrame, notes: DataFrame, around: int = 2) -> DataFrame:
    """Lines around each entry (path, line): path, line, context_line, text.

    Only notes with entries are split into lines, and only the lines asked for leave the row.
    """
    wanted = entries.groupBy("path").agg(F.collect_set("line").alias("_wanted"))  # lines of one note

    def near(all_lines: Column) -> Column:
        def of(line: Column) -> Column:
            first, last = F.greatest(line - around, F.lit(1)), F.least(line + around, F.size(all_lines))
            places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: F.struct(line.alias("line"), at.alias("context_line"), F.get(all_lines, at - 1).alias("text")))

        return F.flatten(F.transform(F.col("_wanted").cast("array<int>"), of))

    rows = notes.select("path", "content").join(shuffled(wanted), "path")
    found = rows.select("path", F.explode_outer(text.let(text.lines(F.col("content")), near)).alias("c"))
    return found.where("c IS NOT NULL").select("path", "c.line", "c.context_line", "c.text")
