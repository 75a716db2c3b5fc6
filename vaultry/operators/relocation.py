"""Moves: loose files into resource folders, and links that follow moved files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, paths
from ..functions.skew import shuffled


def loose_file_moves(loose: DataFrame, files: DataFrame) -> DataFrame:
    """Target of every loose file: old, new, note (its companion), note_exists.

    A taken name gets the first free number from 2, without a limit.
    """
    path = F.col("path")
    rows = loose.select(
        path.alias("old"), F.concat(paths.parent(path), F.lit("/_resources/")).alias("_folder"),
        paths.stem(path).alias("_stem"), paths.suffix(path).alias("_ext"),
    )
    taken = _taken_numbers(files.select(F.concat(paths.parent(path), F.lit("/")).alias("_folder"), paths.name(path).alias("_name")))
    key = ["_folder", "_stem", "_ext"]
    used = F.coalesce("_taken", F.array().cast("array<int>"))
    first = F.get(F.array_except(F.sequence(F.lit(1), F.size(used) + 1), used), F.lit(0))
    free = rows.join(shuffled(taken), key, "left").select("old", F.concat("_folder", _numbered("_stem", "_ext", first)).alias("new"))
    placed = rows.select("old").join(shuffled(free), "old", "left").withColumn(
        "note",
        F.concat(paths.parent(paths.parent(F.col("new"))), F.lit("/"), paths.stem(F.col("new")), F.lit(".md")),
    )
    known = files.select(F.col("path").alias("note"), F.lit(True).alias("note_exists"))
    return placed.join(shuffled(known), "note", "left").na.fill(False, ["note_exists"])


def _taken_numbers(names_: DataFrame) -> DataFrame:
    """Numbers in use for every (folder, stem, extension): the plain name counts as 1, ``stem 7`` as 7.

    Each name is one row; a name that ends in a number speaks for itself and for the stem without it.
    """
    stem, ext = paths.stem(F.col("_name")), paths.suffix(F.col("_name"))
    plain = names_.select("_folder", stem.alias("_stem"), ext.alias("_ext"), F.lit(1).alias("_n"))
    number = F.regexp_extract(stem, r"\A(?s:.*) ([1-9][0-9]{0,8})\z", 1)
    numbered = names_.where(number != "").select(
        "_folder", F.regexp_replace(stem, r" [0-9]+\z", "").alias("_stem"), ext.alias("_ext"), number.cast("int").alias("_n")
    )
    return plain.unionByName(numbered.where("_n > 1")).groupBy("_folder", "_stem", "_ext").agg(F.collect_set("_n").alias("_taken"))


def _numbered(stem: str, ext: str, n: Column) -> Column:
    return F.when(n == 1, F.concat(F.col(stem), F.col(ext))).otherwise(F.concat(F.col(stem), F.lit(" "), n.cast("string"), F.col(ext)))


def moved_targets(targets: DataFrame, moves: DataFrame) -> DataFrame:
    """New path for link targets that meant a moved file: target, folder, new_path.

    ``targets``: target, folder (of the linking note); ``moves``: old, new.  An exact path, a path
    below wiki/ or raw/ or one relative to the folder wins; otherwise the moved file whose old path
    ends in the target and shares most leading folders with the note, then the shortest, then the
    first in order.  Moved files and notes meet by tail and folder, where one file is the best: a name that many files have
    costs each note as many rows as its folder has parents.
    """
    loose = names.straight_quotes(F.regexp_replace("target", r"\A\./", ""))
    forms = targets.select("target", "folder").distinct().select(
        "target", "folder", F.posexplode(F.array(loose, F.concat(loose, F.lit(".md")))).alias("form", "path")
    )
    direct = forms.select(
        "target", "folder",
        F.posexplode(
            F.array(
                F.col("path"), F.concat(F.lit("wiki/"), "path"), F.concat(F.lit("raw/"), "path"),
                paths.resolved(F.concat("folder", F.lit("/"), "path")),
            )
        ).alias("way", "old"), (F.col("form") * 10).alias("form"),
    ).join(shuffled(moves), "old").select(
        "target", "folder", "new", (F.col("form") + F.col("way")).alias("order"), F.lit(0).alias("score"), "old"
    )
    # the best moved file for a tail below every folder above it; a note then asks for its own folders, the deepest first
    tails = moves.select(
        "old", "new", F.explode(paths.trailing_paths(names.straight_quotes(F.col("old")))).alias("path")
    ).join(shuffled(forms.select("path").distinct()), "path", "left_semi")
    nearest = F.struct(F.length("old").alias("l"), F.col("old").alias("o"))
    below = tails.select("path", "old", "new", F.posexplode(_leading_paths(F.col("old"))).alias("depth", "above"))
    best = below.groupBy("path", "above").agg(F.min_by(F.struct("old", "new"), nearest).alias("b"))
    asked = forms.select("target", "folder", "path", F.posexplode(_leading_paths(F.col("folder"))).alias("depth", "above"))
    by_tail = asked.join(shuffled(best), ["path", "above"]).select(
        "target", "folder", F.col("b.new").alias("new"), F.lit(100).alias("order"), F.col("depth").alias("score"), F.col("b.old").alias("old")
    )
    rank = F.struct("order", (-F.col("score")).alias("s"), F.length("old").alias("l"), F.col("old").alias("o"))
    return direct.unionByName(by_tail).groupBy("target", "folder").agg(F.min_by("new", rank).alias("new_path"))


def _leading_paths(path: Column) -> Column:
    """Every leading run of components, the empty one first."""
    components = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(components)), lambda i: F.array_join(F.slice(components, F.lit(1), i), "/"))


def files_after(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Paths of the vault once the moves are done."""
    return files.join(shuffled(moves.select(F.col("old").alias("path"), "new")), "path", "left").select(
        F.coalesce("new", "path").alias("path")
    )


def safe_names(files: DataFrame) -> DataFrame:
    """Renames of raw files whose names a shell or a link would trip over: old, new.

    The first file in path order keeps its safe name if no file has it; the others of that name get the first numbers from 2
    that neither a file of the folder nor another safe name uses.
    """
    path = F.col("path")
    folder, name = F.concat(paths.parent(path), F.lit("/")).alias("_folder"), paths.name(path).alias("_name")
    wanted = files.where(path.startswith("raw/")).select(
        path.alias("old"), folder, names.shell_safe_name(paths.name(path)).alias("_name")
    ).where(F.concat("_folder", "_name") != F.col("old"))
    there = files.select(folder, name, F.lit(True).alias("_there")).distinct()
    turn = F.row_number().over(Window.partitionBy("_folder", "_name").orderBy("old"))
    placed = wanted.withColumn("_turn", turn).join(shuffled(there), ["_folder", "_name"], "left").select(
        "old", "_folder", "_name", paths.stem(F.col("_name")).alias("_stem"), paths.suffix(F.col("_name")).alias("_ext"),
        # 0 keeps the name, n takes the n-th free number
        (F.col("_turn") - F.coalesce(F.col("_there"), F.lit(False)).eqNullSafe(False).cast("int")).cast("int").alias("_n"),
    )
    series = ["_folder", "_stem", "_ext"]
    taken = _taken_numbers(files.select(folder, name).unionByName(wanted.select("_folder", "_name")))
    needed = placed.groupBy(*series).agg(F.max("_n").alias("_most")).where("_most > 0").join(shuffled(taken), series, "left")
    used = F.coalesce("_taken", F.array().cast("array<int>"))
    free = F.slice(F.array_except(F.sequence(F.lit(2), F.size(used) + F.col("_most") + 1), used), F.lit(1), F.col("_most"))
    numbers = needed.select(*series, F.posexplode(free).alias("_at", "_number")).withColumn("_n", F.col("_at") + 1).drop("_at")
    return placed.join(shuffled(numbers), [*series, "_n"], "left").select(
        "old", F.concat("_folder", F.when(F.col("_n") == 0, F.col("_name")).otherwise(_numbered("_stem", "_ext", F.col("_number")))).alias("new")
    )
