"""Counts, states and rules about libraries, files and running jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped, suffix
from .ingest import REASONS, terminal

HEARTBEAT_TIMEOUT, STALL_TIMEOUT = 15, 25
PAGES_A_DAY = 800
MANY_LINKS = 3
#: Note names and folders that the naming rules leave alone.
EXEMPT_NAMES = ("log.md", "目录.md", "home.md", "agents.md", "readme.md")
EXEMPT_FOLDERS = ("templates", "TODO", "任务节点", "Clippings")
EXEMPT_ROOTS = ("00-Inbox", "90-Archive")
#: Names that are dates, names that look like code, Han signs, signs that names don't have.
DATED = r"^\d{4}[-_.]\d{2}[-_.]\d{2}"
CODE_LIKE = r"^[A-Za-z]?\d+[._-][A-Za-z0-9_.-]|^.*?[A-Z]{2,}.*?_\d|^[A-Z0-9]+_[A-Z0-9_]+$|^(?=[^一-龥]*$)(?=.*\d)(?=.*_)[A-Za-z0-9_]+$"
HAN = r"[\u4e00-\u9fff]"
BAD_SIGNS = r"[_:]| {2,}"
NUMBERS_ALONE = r"^\d+(\.\d+)*$"
#: What ends the first part of a title, and the most signs of a suggested name.
TITLE_STOPS = "—–；;，,。：:"
NAME_LENGTH = 24


def library_rollup(meta: DataFrame) -> DataFrame:
    """(lib, files, chunks) for each library and, with a null lib, for all."""
    return meta.rollup("lib").agg(F.count("*").alias("files"), F.sum(F.coalesce("chunks", F.lit(0))).cast("long").alias("chunks"))


def failures_by_reason(meta: DataFrame) -> DataFrame:
    """(lib, reason, n, place): place is the reason's in the fixed order, those without one last."""
    failed = meta.where(terminal(F.col("xfail"), F.col("tbd"))).groupBy("lib", F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    return failed.withColumn("place", F.when(place > 0, place).otherwise(F.lit(len(REASONS) + 1)).cast("int"))


def failure_rows(meta: DataFrame, signature: str | None = None) -> DataFrame:
    """(lib, rel, reason, will_retry): the next run tries those whose abilities have changed."""
    from .ingest import worth_retrying

    rows = meta.where(terminal(F.col("xfail"), F.col("tbd")))
    return rows.select("lib", "rel", F.coalesce("reason", F.lit("unknown")).alias("reason"), worth_retrying(F.col("xfail"), F.col("reason"), F.col("xsrc"), F.lit(signature)).alias("will_retry")).orderBy("lib", "rel")


def healthy_counts(meta: DataFrame) -> DataFrame:
    """(lib, healthy, failed): files that are indexed and files in a state without pieces."""
    bad = terminal(F.col("xfail"), F.col("tbd"))
    return meta.groupBy("lib").agg(F.count_if(~bad).alias("healthy"), F.count_if(bad).alias("failed"))


def page_status(pages: DataFrame) -> DataFrame:
    """(lib, files, pages, failed) of the page index."""
    bad = F.coalesce("failed", F.lit(False))
    return pages.groupBy("lib").agg(F.count_if(~bad).alias("files"), F.sum(F.when(~bad, F.coalesce("pages", F.lit(0))).otherwise(F.lit(0))).cast("long").alias("pages"), F.count_if(bad).alias("failed"))


def library_states(counts: DataFrame) -> DataFrame:
    """counts: lib, files, stale. Adds state (none, stale, ok) and overall."""
    state = F.when(F.col("files") == 0, "none").when(F.col("stale"), "stale").otherwise("ok")
    each = counts.withColumn("state", state)
    overall = each.agg(F.when(F.coalesce(F.bool_or(F.col("state") == "stale"), F.lit(False)), "stale").when(F.coalesce(F.bool_and(F.col("state") == "none"), F.lit(True)), "none").otherwise("ok").alias("overall"))
    return each.crossJoin(F.broadcast(overall))  # one row


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(F.lit(0.0))


def remaining_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    return F.when((done > 0) & (elapsed > 0), (total - done) / (done / elapsed))


def heartbeat(running: Column, phase: Column, pid: Column, updated: Column, advanced: Column, grace: Column, now: Column) -> Column:
    """idle, done, dead, running or stalled. A silent heartbeat is dead whatever the grace; converting
    files and a grace that hasn't ended excuse a standstill."""
    return (
        F.when(~F.coalesce(running, F.lit(False)), F.when((phase == "done") & pid.isNotNull(), "done").otherwise("idle"))
        .when(now - F.coalesce(updated, F.lit(0)) > HEARTBEAT_TIMEOUT, "dead").when(phase == "converting", "running").when(now < grace, "running")
        .when(now - F.coalesce(advanced, F.lit(0)) > STALL_TIMEOUT, "stalled").otherwise("running")
    )


def heartbeat_note(running: Column, phase: Column, updated: Column, advanced: Column, grace: Column, now: Column) -> Column:
    """(kind, quiet): what excuses a standstill, converting or grace, and since how many seconds nothing has
    moved in the latter; nothing excuses a heartbeat that is silent."""
    alive = F.coalesce(running, F.lit(False)) & (now - F.coalesce(updated, F.lit(0)) <= HEARTBEAT_TIMEOUT)
    kind = F.when(alive & (phase == "converting"), "converting").when(alive & (now < grace), "grace")
    return F.struct(kind.alias("kind"), F.when(kind == "grace", F.greatest(F.lit(0), now - F.coalesce(advanced, F.lit(0)))).cast("long").alias("quiet"))


def progress_text(p: dict) -> str:
    """One line on a job: state, phase, library, message, share done and error."""
    state = "running" if p.get("running") else {"done": "done", "error": "failed"}.get(p.get("phase"), "idle")
    done, total = p.get("done") or 0, p.get("total") or 0
    parts = [state, *(f"{k} {p[k]}" for k in ("phase", "library", "message") if p.get(k)), *([f"{done} of {total} ({min(100, 100 * done // total)} %)"] if total else []), *([f"error: {p['error']}"] if p.get("error") else [])]
    return "; ".join(parts)


def snapshot(meta: DataFrame, stale: DataFrame) -> DataFrame:
    """The dashboard: (lib, files, chunks, failed, state, overall, issues), libraries with nothing indexed
    too. issues: (reason, n) of its failures, reasons in their fixed order."""
    counts = meta.groupBy("lib").agg(F.count("*").alias("files"), F.sum(F.coalesce("chunks", F.lit(0))).cast("long").alias("chunks"), F.count_if(terminal(F.col("xfail"), F.col("tbd"))).alias("failed"))
    each = F.array_sort(F.collect_list(F.struct("place", "reason", "n")))  # a handful of reasons
    issues = failures_by_reason(meta).groupBy("lib").agg(F.transform(each, lambda x: F.struct(x["reason"].alias("reason"), x["n"].alias("n"))).alias("issues"))
    joined = stale.join(counts, "lib", "left").fillna(0, ["files", "chunks", "failed"]).join(issues, "lib", "left")
    return library_states(joined)


def daily_quota(log: DataFrame, limit: int = PAGES_A_DAY) -> DataFrame:
    """log: ts, files, pages. (day, files, pages, over)."""
    by_day = log.groupBy(F.to_date("ts").alias("day")).agg(F.sum("files").alias("files"), F.sum("pages").alias("pages"))
    return by_day.withColumn("over", F.col("pages") > limit)


# Note names


def exempt(rel: Column) -> Column:
    name = F.substring_index(rel, "/", -1)
    low, base = F.lower(name), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    parts = F.split(rel, "/")
    archived = low.rlike(r"^(log|agents|readme)-.+") & F.contains(rel, F.lit("90-Archive"))
    return (
        low.isin(*EXEMPT_NAMES) | low.rlike(r"^(_|moc-|graph-ignore-)") | archived | base.rlike(DATED) | base.rlike(CODE_LIKE)
        | F.arrays_overlap(parts, F.array(*map(F.lit, EXEMPT_FOLDERS))) | F.element_at(parts, 1).isin(*EXEMPT_ROOTS)
    )


def violations(rel: Column, body: Column, title: Column) -> Column:
    """Names of the rules that a note breaks: R1 no Han in its name, R2 signs in it, R3 no heading, R4 a
    heading of numbers alone, H1 first heading unlike the name, FM no title."""
    base = F.regexp_replace(F.substring_index(rel, "/", -1), r"(?<=.)\.[^.]*$", "")
    headings = F.regexp_extract_all(body, F.lit(r"(?m)^#{1,3}\s+(.+?)\s*$"), F.lit(1))
    plain = lambda s: F.lower(F.regexp_replace(s, r"[\s\-_]+", ""))
    first = plain(F.get(headings, F.lit(0)))
    rules = [
        F.when(~base.rlike(HAN), "R1"), F.when(base.rlike(BAD_SIGNS), "R2"), F.when(F.size(headings) == 0, "R3"),
        F.when(F.exists(headings, lambda h: h.rlike(NUMBERS_ALONE)), "R4"),
        F.when((F.size(headings) > 0) & (first != "") & (plain(base) != "") & (first != plain(base)), "H1"), F.when(F.coalesce(title, F.lit("")) == "", "FM"),
    ]
    return F.array_compact(F.array(*rules))


def suggested_name(base: Column, texts: list[Column], headings: Column) -> Column:
    """A note's name from what it says of itself: the first of its texts' parts (title, tags, ...) or else of
    its headings that has Han signs, up to the first stop and NAME_LENGTH signs. The old name follows, if
    it isn't in it."""
    said = F.split(F.array_join(F.array(*[F.coalesce(t, F.lit("")) for t in texts]), ","), ",")
    speaking = F.filter(F.concat(said, F.coalesce(headings, F.array().cast("array<string>"))), lambda x: x.rlike(HAN))
    first = F.regexp_extract(F.get(F.transform(speaking, stripped), F.lit(0)), rf"^[【\s]*([^{TITLE_STOPS}]*)", 1)
    head = stripped(F.left(stripped(F.regexp_replace(first, r"\s+", " ")), F.lit(NAME_LENGTH)))
    named = F.when(F.contains(F.lower(head), F.lower(base)), head).otherwise(stripped(F.concat_ws(" ", head, base)))
    return F.when(F.coalesce(head, F.lit("")) != "", named)


def note_report(notes: DataFrame, inlinks: DataFrame) -> DataFrame:
    """notes: rel, body, title. inlinks: target, sources. (rel, rules, inlinks, risky) of the notes that
    break a rule; renaming one with many links is risky."""
    checked = notes.where(~exempt(F.col("rel"))).select("rel", violations(F.col("rel"), F.col("body"), F.col("title")).alias("rules"), F.regexp_replace(F.substring_index("rel", "/", -1), r"(?<=.)\.[^.]*$", "").alias("target"))
    joined = checked.where(F.size("rules") > 0).join(inlinks, "target", "left").withColumn("inlinks", F.coalesce(F.size("sources"), F.lit(0)))
    return joined.select("rel", "rules", F.greatest("inlinks", F.lit(0)).alias("inlinks"), (F.col("inlinks") >= MANY_LINKS).alias("risky"))


# Formats and selections


def pending_formats(listing: DataFrame, approved: DataFrame, text_formats: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """(lib, ext, files) of formats that wait for approval."""
    rows = listing.select("lib", suffix(F.col("rel")).alias("ext")).where(~F.col("ext").isin(*text_formats))
    return rows.join(approved, ["lib", "ext"], "left_anti").groupBy("lib", "ext").agg(F.count("*").alias("files"))


def apply_choices(changes: DataFrame) -> DataFrame:
    """changes: lib, path, action, pos. The last action for each path: (lib, path, action); neutral ones vanish."""
    return changes.groupBy("lib", "path").agg(F.max_by("action", "pos").alias("action")).where(F.col("action").isin("in", "out"))


def bulk_format(chosen_in: Column, chosen_out: Column, extension: str, include: bool) -> Column:
    """(selection_in, selection_out) after a format is switched: entries of single files move, folders stay."""
    of = lambda p: F.lower(p).endswith("." + extension.lower().lstrip("."))
    if include:
        return F.struct(chosen_in.alias("selection_in"), F.array_sort(F.filter(chosen_out, lambda p: ~of(p))).alias("selection_out"))
    moved = F.array_sort(F.array_union(chosen_out, F.filter(chosen_in, of)))
    return F.struct(F.array_sort(F.filter(chosen_in, lambda p: ~of(p))).alias("selection_in"), moved.alias("selection_out"))


def keep_newest(files: DataFrame, group: str, order: str, key: str, keep: int) -> DataFrame:
    """Rows beyond the newest ``keep`` of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order), F.desc(key)))
    return files.withColumn("_n", rank).where(F.col("_n") > keep).drop("_n")


def older_than(files: DataFrame, modified: str, now: Column, hours: int = 24) -> DataFrame:
    return files.where(F.col(modified) < now - F.make_dt_interval(hours=F.lit(hours)))
