"""Paths, scopes and the selection rules that decide which files belong to a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import stripped, suffix

DEFAULTS = ("follow", "include", "exclude")


def normalised(path: Column) -> Column:
    """A selection path with forward slashes and without outer ones; null if it isn't relative and sound."""
    s = F.replace(stripped(path), F.lit("\\"), F.lit("/"))
    parts = F.transform(F.split(F.regexp_replace(s, r"^/+|/+$", ""), "/", -1), stripped)
    bad = s.rlike(r"^(/|~|[A-Za-z]:)") | F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.when(~bad, F.array_join(parts, "/"))


def require_normalised(path: Column) -> Column:
    return F.coalesce(normalised(path), F.when(path.isNotNull(), F.raise_error(F.concat(F.lit("not a relative path inside the library: "), path))))


def _parts(rel: Column) -> Column:
    return F.split(F.regexp_replace(F.replace(rel, F.lit("\\"), F.lit("/")), r"^/+|/+$", ""), "/", -1)


def _entries(names: Column) -> Column:
    clean = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda e: F.regexp_replace(stripped(F.replace(e, F.lit("\\"), F.lit("/"))), r"^/+|/+$", ""))
    return F.filter(clean, lambda e: e != "")


def nearest_choice(chosen_in: Column, chosen_out: Column, rel: Column) -> Column:
    """The nearest explicit choice above or at rel: (action, depth, prefix), or null. Out goes first."""
    parts, none = _parts(rel), F.array().cast("array<string>")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix")))
    ins, outs = F.coalesce(chosen_in, none), F.coalesce(chosen_out, none)
    hits = F.filter(prefixes, lambda p: F.array_contains(ins, p["prefix"]) | F.array_contains(outs, p["prefix"]))
    first = F.get(hits, F.lit(0))
    return F.when(F.size(hits) > 0, F.struct(F.when(F.array_contains(outs, first["prefix"]), F.lit("out")).otherwise(F.lit("in")).alias("action"), first["depth"].alias("depth"), first["prefix"].alias("prefix")))


def excluded_depth(excluded: Column, rel: Column) -> Column:
    """Depth of the deepest path component that contains an excluded directory's name; 0 if none does."""
    names = _entries(excluded)
    depths = F.transform(_parts(rel), lambda p, i: F.when(F.exists(names, lambda e: F.contains(p, e)), i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(depths), F.lit(0))


def verdict(chosen_in: Column, chosen_out: Column, excluded: Column, rel: Column) -> Column:
    """(included: in, out or null; tie). The deeper of the nearest choice and the deepest exclusion wins;
    a choice for the very directory that is excluded is a tie and stays out."""
    choice, depth = nearest_choice(chosen_in, chosen_out, rel), excluded_depth(excluded, rel)
    same = F.array_contains(_entries(excluded), choice["prefix"])
    made = lambda what, tie: F.struct(F.lit(what).cast("string").alias("included"), F.lit(tie).alias("tie"))
    return (
        F.when(choice.isNull() & (depth > 0), made("out", False)).when(choice.isNull(), made(None, False)).when(choice["action"] == "out", made("out", False))
        .when(same, made("out", True)).when((depth == 0) | (choice["depth"] > depth), made("in", False)).otherwise(made("out", False))
    )


def file_name_excluded(names: Column, prefixes: Column, rel: Column) -> Column:
    name = F.substring_index(rel, "/", -1)
    return F.array_contains(names, name) | F.exists(prefixes, lambda p: F.startswith(name, p))


def directory_excluded(excluded: Column, absolute: Column) -> Column:
    """Whether any component of an absolute path contains an excluded directory's name."""
    return F.exists(F.split(absolute, "/"), lambda p: F.exists(excluded, lambda e: F.contains(p, e)))


def included(rel: Column, root: Column, chosen_in, chosen_out, excluded_dirs, excluded_names, excluded_prefixes, extensions, default: Column) -> Column:
    """The whole funnel: an explicit choice passes all but the verdict; else the library's default says
    whether the directory, name and format rules decide (follow, include) or nothing is in (exclude)."""
    v = verdict(chosen_in, chosen_out, excluded_dirs, rel)
    explicit = nearest_choice(chosen_in, chosen_out, rel).isNotNull()
    rules = ~directory_excluded(excluded_dirs, F.concat_ws("/", root, rel)) & ~file_name_excluded(excluded_names, excluded_prefixes, rel)
    known = F.array_contains(F.transform(extensions, lambda e: F.lower(e)), suffix(rel))
    return F.when(explicit, v["included"] == "in").when(default == "exclude", F.lit(False)).when(default == "include", rules).otherwise(rules & known)


def effective_state(rel: Column, chosen_in: Column, chosen_out: Column, extensions: Column, supported: Column, default: Column) -> Column:
    """Why a path is in or out: chosen_in, chosen_out, unsupported, default_out, format_in or format_out."""
    action = nearest_choice(chosen_in, chosen_out, rel)["action"]
    return (
        F.when(action == "in", "chosen_in").when(action == "out", "chosen_out").when(~F.array_contains(supported, suffix(rel)), "unsupported")
        .when(default == "exclude", "default_out").when(F.array_contains(extensions, suffix(rel)), "format_in").otherwise("format_out")
    )


def tree(listed: DataFrame) -> DataFrame:
    """listed: rel, included. (prefix, depth, files, included) for each folder and file of the tree."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(_parts(F.col("rel")))), lambda i: F.array_join(F.slice(_parts(F.col("rel")), F.lit(1), i), "/"))
    each = listed.select(F.posexplode(prefixes).alias("depth", "prefix"), "included")
    return each.groupBy("prefix", (F.col("depth") + 1).alias("depth")).agg(F.count("*").alias("files"), F.count_if("included").alias("included"))


def tree_states(listed: DataFrame, chosen_in: Column, chosen_out: Column, extensions: Column, supported: Column, default: Column) -> DataFrame:
    """The tree with each node's state: effective_state() of files, of folders the choice that holds there
    (chosen_in, chosen_out, or neutral)."""
    node = tree(listed)
    leaf = listed.select(F.col("rel").alias("prefix"), F.lit(True).alias("_leaf")).distinct()
    action = nearest_choice(chosen_in, chosen_out, F.col("prefix"))["action"]
    of_folder = F.when(action == "in", "chosen_in").when(action == "out", "chosen_out").otherwise("neutral")
    state = F.when(F.col("_leaf"), effective_state(F.col("prefix"), chosen_in, chosen_out, extensions, supported, default)).otherwise(of_folder)
    return node.join(leaf, "prefix", "left").withColumn("state", state).drop("_leaf")


def in_folder(rel: Column, folder: str) -> Column:
    """Whether rel is the folder, or below it; an empty folder holds everything."""
    f = folder.strip().replace("\\", "/").strip("/").strip()
    return F.lit(True) if not f else (rel == f) | rel.startswith(f + "/")


def scope(requested: list[str], excluded: list[str], defaults: list[str], known: list[str]) -> list[str]:
    """Libraries to search: those requested, else the defaults, else all, without the excluded ones."""
    unknown = [x for x in [*requested, *excluded] if x not in known]
    if unknown:
        raise ValueError(f"unknown libraries: {', '.join(unknown)}")
    wanted = requested or [d for d in defaults if d in known] or known
    return [x for x in dict.fromkeys(wanted) if x not in set(excluded)]


def collection_name(library: Column) -> Column:
    """A storage name: kb_ and the lower-cased name, other signs than letters, digits, dot and hyphen as
    underscores. Unless that begins and ends with a letter or digit and has no two underscores in a row,
    underscores are folded and 8 digits of the name's MD5 added."""
    base = F.regexp_replace(F.lower(library), r"[^a-zA-Z0-9._-]", "_")
    plain = F.substring(F.concat(F.lit("kb_"), base), 1, 63)
    clean = plain.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9._-]*[a-zA-Z0-9]$") & ~F.contains(plain, F.lit("__"))
    short = F.substring(F.regexp_replace(F.regexp_replace(base, "_+", "_"), r"^[._-]+|[._-]+$", ""), 1, 45)
    digest = F.substring(F.md5(library.cast("binary")), 1, 8)
    return F.when(clean, plain).when(short != "", F.concat_ws("_", F.lit("kb"), short, digest)).otherwise(F.concat_ws("_", F.lit("kb"), digest))


def valid_name(library: Column) -> Column:
    """1 to 64 characters, no outer blanks, none of the signs that file systems reserve."""
    return F.coalesce((F.length(library) > 0) & (stripped(library) == library) & (F.length(library) <= 64) & ~library.rlike(r'[/\\:*?"<>|]'), F.lit(False))
