"""The engine as a user sees it: libraries that are indexed, searched, related and checked.

Tables (see tables.Tables), with a part for each library: file_meta, file_text, chunks, vectors, postings,
lengths, totals, index_states, and optionally page_vectors and page_meta; libraries, extractions and words are shared. Results are DataFrames with structured rows; small answers are dictionaries.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .control import LIBRARY, SUMMARY_LENGTH, Gate, Library, Registry, read_summary, summary_prompt
from .functions import paths
from .functions.text import inline_html_as_markdown, stem, stripped, suffix, tokens
from .models import Embedder, Extractor, HashedTokens, Reranker, embed
from .operators import bm25, diagnostics, graph, hanwords, ingest, neardup, retrieval, sampling
from .plans import hybrid
from .sources import bundle, config, extraction, files, package
from .sources.docx import Docx
from .storage import materialise
from .streaming import live
from .tables import WHOLE, Change, Tables

META = "lib string, rel string, size long, mtime_ns long, hash string, chunks int, xfail boolean, tbd boolean, reason string, xsrc string, links array<string>"
CHUNKS = "lib string, rel string, chunk int, heading string, title string, tags string, hp string, ctx string, body string, text string"
VECTORS = "lib string, rel string, chunk int, vec array<float>"
TEXT = "lib string, rel string, text string"
PAGES = "lib string, rel string, page int, vec array<float>"
POSTINGS = "lib string, term string, cid struct<lib:string,rel:string,chunk:int>, tf long, dl long"
TOTALS = "lib string, n long, avgdl double"
LENGTHS = "lib string, cid struct<lib:string,rel:string,chunk:int>, dl long"
STATES = "lib string, version int, indexed_at double"
WORDS = "word string, n long"
CACHE = "hash string, route string, version int, markdown string, sidecar string"
#: What a package holds of a library.
EXPORTED = {"file_meta": META, "file_text": TEXT, "chunks": CHUNKS, "vectors": VECTORS}
BLOCKS = "array<struct<type:string,text:string>>"
#: Files that are read by their paths; if more have changed, the folder is read as a whole.
LISTED_FILES = 10_000
#: A library with more segments is compacted after an index run.
SEGMENTS = 16
PAGE_META = "lib string, rel string, pages int, failed boolean, reason string, size long, mtime_ns long, signature string"


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, reranker: Reranker | None = None, show_code: Callable[[str], None] = print, extractor: Extractor | None = None):
        self.spark, self.tables = spark, Tables(spark, root, keys={"postings": ("cid.lib", "cid.rel"), "lengths": ("cid.lib", "cid.rel")})
        self.embedder, self.reranker, self.extractor = embedder or HashedTokens(), reranker, extractor or Docx()
        self.gate = Gate(show_code)
        self._refreshing: dict[str, threading.Thread] = {}
        self._progress: dict[str, dict] = {}
        self._cutter: tuple[str, hanwords.Segmenter] | None = None

    @property
    def signature(self) -> str:
        """What the engine can extract with: files that failed with something else are tried again."""
        return getattr(self.extractor, "signature", type(self.extractor).__name__)

    # Libraries

    def _registry(self) -> Registry:
        return Registry.of(self.tables.read("libraries", LIBRARY).collect())  # a row a library

    def _save(self, registry: Registry) -> None:
        self.tables.write("libraries", self.spark.createDataFrame(registry.rows(), LIBRARY))

    def add_library(self, name: str, path: str, **options) -> Library:
        registry = self._registry()
        made = registry.add(name, path, **options)
        self._save(registry)
        return made

    def remove_library(self, name: str) -> None:
        registry = self._registry()
        registry.remove(name)
        self._save(registry)

    def list_libraries(self) -> DataFrame:
        """(name, path, summary, options, files, chunks, failed, indexed_at)."""
        known = self.tables.read("libraries", LIBRARY).select("name", "path", "summary", "options")
        meta = self.tables.read("file_meta", META)
        counts = meta.groupBy(F.col("lib").alias("name")).agg(F.count("*").alias("files"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks"), F.count_if(ingest.terminal(F.col("xfail"), F.col("tbd"))).alias("failed"))
        states = self.tables.read("index_states", STATES).select(F.col("lib").alias("name"), "indexed_at")
        return known.join(counts, "name", "left").fillna(0, ["files", "chunks", "failed"]).join(states, "name", "left")

    # Selections and summaries, in two steps

    def get_selection(self, library: str) -> dict:
        x = self._registry().get(library)
        return {"in": x.selection_in, "out": x.selection_out, "default": x.selection_default}

    def propose_selection_changes(self, library: str, changes: list[tuple[str, str]]) -> str:
        Library("", "").choose(changes)  # raises what is wrong with them
        self._registry().get(library)
        return self.gate.propose(library, ("selection", changes))

    def apply_selection_changes(self, library: str, proposal: str, code: str) -> dict:
        _, changes = self.gate.confirm(library, proposal, code)
        registry = self._registry()
        registry.get(library).choose(changes)
        self._save(registry)
        return self.get_selection(library)

    def propose_library_summary(self, library: str, text: str) -> str:
        if not 0 < len(text.strip()) <= SUMMARY_LENGTH:
            raise ValueError(f"a summary has 1 to {SUMMARY_LENGTH} characters")
        self._registry().get(library)
        return self.gate.propose(library, ("summary", text.strip()))

    def apply_library_summary(self, library: str, proposal: str, code: str, source: str = "ai") -> None:
        _, text = self.gate.confirm(library, proposal, code)
        registry = self._registry()
        x = registry.get(library)
        print_of = ingest.fingerprint(self.tables.read("file_meta", META).where(F.col("lib") == library)).first()
        x.summary, x.summary_source, x.summary_at, x.summary_fingerprint = text, source, time.time(), print_of["fingerprint"] if print_of else ""
        self._save(registry)

    def suggest_library_summary(self, library: str, write: Callable[[str], str], k: int = 5) -> str:
        """Asks a model (any callable of a prompt) for a summary of a library's sample and proposes it; the
        number of the proposal. ValueError if the answer is empty."""
        titles = [r["rel"] for r in self.tables.read("file_meta", META, library).select("rel").orderBy("rel").limit(50).collect()]
        samples = [r["body"] for r in self.get_library_sample(library, k).collect()]  # k rows
        return self.propose_library_summary(library, read_summary(write(summary_prompt(library, samples, titles))))

    def get_library_sample(self, library: str, k: int = sampling.K) -> DataFrame:
        """Representative pieces of a library."""
        chunks = self.tables.read("chunks", CHUNKS).where(F.col("lib") == library).withColumn("cid", F.concat_ws("::", "rel", "chunk"))
        vectors = self.tables.read("vectors", VECTORS).where(F.col("lib") == library).withColumn("cid", F.concat_ws("::", "rel", "chunk"))
        chosen = sampling.farthest_points(vectors, "lib", "cid", "vec", k)
        return chosen.join(chunks.drop("lib"), "cid").select("step", "rel", "chunk", "heading", "title", "body").orderBy("step")

    # Index

    def listing(self, library: Library, approved: Sequence[str] | None = None) -> DataFrame:
        """(lib, rel, path, size, mtime_ns) of the files that the library's selection includes, contents
        unread. approved: formats that may be indexed beside text; others are left as they are."""
        o = config.effective(config.DEFAULTS, library.options)
        strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
        wanted = paths.included(
            F.col("rel"), F.lit(library.path), strings(library.selection_in), strings(library.selection_out), strings(o["exclude_dirs"]), strings(o["exclude_files"]),
            strings(o["exclude_patterns"]), strings(o["extensions"]), F.lit(library.selection_default),
        )
        found = files.listing(self.spark, library.path, library.name).where(wanted)
        return found if approved is None else found.where(suffix(F.col("rel")).isin(*files.TEXT_SUFFIXES, *approved))

    def _suspects(self, library: Library, listed: DataFrame, mine: DataFrame, everything: bool) -> DataFrame:
        """The listed files that may have changed, by size and time, or may succeed now, with contents."""
        old = mine.select("lib", "rel", F.col("size").alias("_size"), F.col("mtime_ns").alias("_time"), "xfail", "reason", "xsrc")
        known = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ns").eqNullSafe(F.col("_time"))
        again = ingest.worth_retrying(F.col("xfail"), F.col("reason"), F.col("xsrc"), F.lit(self.signature))
        doubtful = F.lit(True) if everything else ~F.coalesce(known & ~again, F.lit(False))
        suspects = listed.join(old, ["lib", "rel"], "left").where(doubtful).select("lib", "rel", "path")
        some = [r["path"] for r in suspects.select("path").limit(LISTED_FILES + 1).collect()]
        if not some:
            return files.read(self.spark, library.path, library.name).limit(0)
        if len(some) <= LISTED_FILES:
            return files.read(self.spark, library.path, library.name, some)
        return files.read(self.spark, library.path, library.name).join(suspects.select("lib", "rel"), ["lib", "rel"], "left_semi")

    def changes(self, library: str) -> DataFrame:
        """(lib, rel, status). Of files whose size and time are as they were no content is read."""
        x = self._registry().get(library)
        mine, listed = self.tables.read("file_meta", META, library), self.listing(x)
        read = self._suspects(x, listed, mine, False).select("lib", "rel", "hash")
        return ingest.diff(listed.join(read, ["lib", "rel"], "left"), mine, self.signature)

    def staleness(self, library: str) -> dict:
        """Numbers of files by status, and whether the folder is missing, is emptied, or the index is of
        another version. A missing or emptied folder is no reason to delete."""
        x = self._registry().get(library)
        if not files.exists(self.spark, x.path):
            return {"missing": True, "emptied": False, "version_upgrade": self._outdated(library)}
        mine = self.tables.read("file_meta", META, library)
        row = ingest.diff_counts(self.changes(library), mine).first()
        counts = row.asDict() if row else dict.fromkeys(("added", "removed", "changed", "retry", "same"), 0) | {"emptied": False}
        return {k: v for k, v in counts.items() if k not in ("lib", "stale")} | {"missing": False, "version_upgrade": self._outdated(library)}

    def is_stale(self, library: str) -> bool:
        """Whether files were added, removed or touched since the last index, by size and time alone. A
        library whose folder is missing is not."""
        x = self._registry().get(library)
        if not files.exists(self.spark, x.path):
            return False
        mine = self.tables.read("file_meta", META, library)
        listed = self.listing(x).withColumn("hash", F.lit(None).cast("string"))
        return self._outdated(library) or not ingest.diff(listed, mine, self.signature).where("status <> 'same'").isEmpty()

    def _outdated(self, library: str) -> bool:
        state = self.tables.read("index_states", STATES, library).first()
        return state is not None and state["version"] != ingest.META_VERSION

    def _healthy(self, library: str) -> bool:
        row = ingest.consistent(self.tables.read("file_meta", META, library), self.tables.read("chunks", CHUNKS, library)).first()
        return row is None or row["consistent"]

    def _markdown(self, new: DataFrame) -> DataFrame:
        """new with text, blocks and failed (a reason): what the extractor reads of files that aren't text,
        from the cache if it has been read before. Adds what is read now to the cache. Files that the
        extractor defers are left out."""
        cached = self.tables.read("extractions", CACHE)
        others = new.where("content IS NOT NULL").select("hash", "rel", "content", F.lit(self.signature).alias("route"))
        todo = extraction.missing(others, cached, ingest.META_VERSION).dropDuplicates(["hash"])
        read = materialise(extraction.extract(todo, self.extractor), "extracted")
        made = read.where("pages IS NOT NULL").select("hash", F.lit(self.signature).alias("route"), F.lit(ingest.META_VERSION).alias("version"), F.array_join("pages", "\n\n").alias("markdown"), "sidecar")
        if not made.isEmpty():
            self.tables.commit({"extractions": {uuid.uuid4().hex: made}})
            cached = self.tables.read("extractions", CACHE)
        known = cached.where((F.col("route") == self.signature) & (F.col("version") == ingest.META_VERSION)).groupBy("hash").agg(F.first("markdown").alias("markdown"), F.first("sidecar").alias("sidecar"))
        there = new.join(read.where("deferred").select("hash"), "hash", "left_anti")
        joined = there.join(known, "hash", "left").withColumn("markdown", F.when(stripped(F.col("markdown")) != "", F.col("markdown")))
        reason = F.when(F.col("text").isNull() & F.col("markdown").isNull(), F.when(F.col("hash") == ingest.UNREADABLE, ingest.UNREADABLE).when(F.col("content").isNull(), "empty").otherwise("extract-failed"))
        return joined.select("lib", "rel", "size", "mtime_ns", "hash", F.coalesce("text", "markdown").alias("text"), F.from_json("sidecar", BLOCKS).alias("blocks"), reason.alias("failed"))

    def index_progress(self, library: str) -> dict:
        """library, running, phase, done and total (files of the run), tasks and tasks_total (of the Spark jobs that run
        just now): of this engine's present or last index run of the library."""
        now = {"library": library, "running": False, "phase": "idle", "done": 0, "total": 0} | self._progress.get(library, {})
        tasks = live.task_progress(self.spark, f"reindex-{library}") if now["running"] else {"done": 0, "total": 0}
        return now | {"tasks": tasks["done"], "tasks_total": tasks["total"]}

    def _reached(self, library: str, phase: str, **more) -> None:
        self._progress[library] = self._progress.get(library, {}) | {"phase": phase, "running": True} | more

    def reindex_knowledge(self, library: str, approved: Sequence[str] | None = None) -> dict:
        """Indexes what has changed, see _reindex(); index_progress() tells how far it is."""
        context = self.spark.sparkContext
        self._progress[library] = {"running": True, "phase": "listing", "done": 0, "total": 0}
        context.setJobGroup(f"reindex-{library}", f"index of {library}")
        try:
            found = self._reindex(library, approved)
            self._progress[library] |= {"phase": "done", "done": self._progress[library]["total"]}
            return found
        except Exception:
            self._progress[library] |= {"phase": "error"}
            raise
        finally:
            self._progress[library] |= {"running": False}
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)

    def _reindex(self, library: str, approved: Sequence[str] | None) -> dict:
        """Indexes what has changed and commits all tables of the library at once. Contents are read of
        files whose size or time has changed only. A folder that is missing or lists nothing deletes nothing;
        an index of another version, or one that lost pieces, is built anew. approved: see listing()."""
        x = self._registry().get(library)
        if not files.exists(self.spark, x.path):
            return {"missing": True, "emptied": False}
        o = config.effective(config.DEFAULTS, x.options)
        read = lambda name, schema: self.tables.read(name, schema, library)
        allowed = (lambda d: d) if approved is None else (lambda d: d.where(suffix(F.col("rel")).isin(*files.TEXT_SUFFIXES, *approved)))
        mine, anew = allowed(read("file_meta", META)), self._outdated(library) or not self._healthy(library)
        listed = materialise(self.listing(x, approved), "listing")
        suspects = self._suspects(x, listed, mine, anew)
        hashes = materialise(suspects.select("lib", "rel", "hash"), "hashes")
        diffed = ingest.diff(listed.join(hashes, ["lib", "rel"], "left"), mine, self.signature)
        if anew:
            diffed = diffed.withColumn("status", F.when(F.col("status") == "same", "changed").otherwise(F.col("status")))
        diffed = materialise(diffed, "diff")
        counts = {r["status"]: r["count"] for r in diffed.groupBy("status").count().collect()}  # five rows at most
        emptied = bool(counts) and not sum(v for k, v in counts.items() if k != "removed")
        if not counts or emptied:
            return counts | {"emptied": emptied}
        wanted = diffed.where("status IN ('added', 'changed', 'retry')")
        self._reached(library, "extracting", total=sum(counts.get(k, 0) for k in ("added", "changed", "retry", "removed")))
        new = materialise(self._markdown(suspects.join(wanted, ["lib", "rel"], "left_semi")), "new-files")
        touched = new.select("lib", "rel").unionByName(diffed.where("status = 'removed'").select("lib", "rel"))
        deferred = wanted.join(new, ["lib", "rel"], "left_anti")
        counts |= {"deferred": n} if (n := deferred.count()) else {}
        texts = new.where("text IS NOT NULL").select("lib", "rel", "text", "blocks")
        self._reached(library, "chunking", done=counts.get("removed", 0))
        chunks, states = ingest.chunk_files(texts, o["chunk_char_limit"], o["short_doc_char_limit"], o["tbd_exclude_ratio"])
        chunks, states = materialise(chunks, "chunks"), materialise(states, "file-states")
        pieces = chunks.groupBy("lib", "rel").agg(F.count("*").cast("int").alias("chunks"))
        fresh = new.join(states, ["lib", "rel"], "left").withColumn("reason", F.coalesce("failed", "reason")).join(pieces, ["lib", "rel"], "left").select(
            "lib", "rel", "size", "mtime_ns", "hash", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.col("reason").isNotNull().alias("xfail"),
            F.lit(False).alias("tbd"), "reason", F.lit(self.signature).alias("xsrc"), "links",
        )
        vectors = chunks.select("lib", "rel", "chunk", embed(F.col("text"), self.embedder).alias("vec"))
        version = self.tables.current()
        index, words = hybrid.keyword_index(chunks, self._terms(version)), {("words", WHOLE): version.get("words", {}).get(WHOLE)}
        # files that were touched without a change: their size and time alone, in the rows of file_meta
        seen = listed.select("lib", "rel", F.col("size").alias("_size"), F.col("mtime_ns").alias("_time"))
        seen = seen.join(deferred.select("lib", "rel"), ["lib", "rel"], "left_anti").join(touched, ["lib", "rel"], "left_anti")  # deferred ones are looked at again
        moved = ~(F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ns").eqNullSafe(F.col("_time")))
        looked = read("file_meta", META).join(seen, ["lib", "rel"]).where(moved).withColumns({"size": F.col("_size"), "mtime_ns": F.col("_time")}).drop("_size", "_time")
        looked = materialise(looked, "looked-at")
        touched = materialise(touched.distinct(), "touched")
        by_file = touched.select(F.struct("lib", "rel").alias("_cid"))
        remaining = read("lengths", LENGTHS).withColumn("_cid", F.struct("cid.lib", "cid.rel")).join(by_file, "_cid", "left_anti").drop("_cid")
        totals = bm25.statistics(remaining.unionByName(index.lengths)).select("lib", "n", "avgdl")
        self._reached(library, "writing", done=states.count())
        state = self.spark.createDataFrame([(library, ingest.META_VERSION, time.time())], STATES)
        added = {"file_text": texts.drop("blocks"), "chunks": chunks, "vectors": vectors, "postings": bm25.stored(index.postings), "lengths": index.lengths}
        next_version = {name: Change(rows, touched) for name, rows in added.items()}
        next_version["file_meta"] = Change(fresh.unionByName(looked), touched.unionByName(looked.select("lib", "rel")))
        next_version |= {"totals": totals, "index_states": state}
        self.tables.commit({name: {library: rows} for name, rows in next_version.items()}, words)
        if self.tables.segments("chunks", library) > SEGMENTS:
            self.tables.compact(library)
        return counts | {"emptied": False}

    def _terms(self, version: dict) -> bm25.Terms:
        """What makes the terms of a version's keyword indexes: with the words of its dictionary, if it has one."""
        entries = version.get("words", {}).get(WHOLE)
        if not entries:
            return tokens
        key = json.dumps(entries)
        if self._cutter is None or self._cutter[0] != key:
            self._cutter = key, hanwords.segmenter(self.spark, self.tables.snapshot(version)("words", WORDS))
        return self._cutter[1].tokens

    def learn_words(self) -> int:
        """Learns the words of Han texts from the files of all libraries and makes the keyword indexes anew, with
        words beside the shingles, in one commit; later index runs and searches cut by the same dictionary.
        There is a Conflict if a library changes meanwhile. The number of words of two signs or more."""
        version, names = self.tables.current(), [x.name for x in self._registry()]
        read = self.tables.snapshot(version)
        learned = hanwords.learn(read("file_text", TEXT), "text")
        terms = hanwords.segmenter(self.spark, learned).tokens
        changes: dict[str, dict] = {"words": {WHOLE: learned}, "postings": {}, "lengths": {}, "totals": {}}
        for name in names:
            index = hybrid.keyword_index(read("chunks", CHUNKS, name), terms)
            lengths = materialise(index.lengths, "lengths")
            changes["postings"][name], changes["lengths"][name] = bm25.stored(index.postings), lengths
            changes["totals"][name] = bm25.statistics(lengths).select("lib", "n", "avgdl")
        self.tables.commit(changes, {("chunks", name): version.get("chunks", {}).get(name) for name in names} | {("words", WHOLE): version.get("words", {}).get(WHOLE)})
        return learned.where(F.length("word") > 1).count()

    def compact(self, library: str) -> int:
        """Writes the library's tables as one segment each; the number of tables that had several."""
        return self.tables.compact(library)

    def ensure_fresh(self, library: str) -> str:
        """Before a search: an empty index is built at once; a stale one is built in the background, while
        searches see the old one. Returns fresh, built, started or running."""
        thread = self._refreshing.get(library)
        if thread and thread.is_alive():
            return "running"
        if not self.is_stale(library):
            return "fresh"
        if self.tables.read("index_states", STATES, library).isEmpty():
            self.reindex_knowledge(library)
            return "built"
        self._refreshing[library] = InheritableThread(target=self.reindex_knowledge, args=(library,), session=self.spark, daemon=True)
        self._refreshing[library].start()
        return "started"

    def preview(self, path: str) -> dict:
        """What one file gives: text, reason, route, number of characters and seconds; nothing is stored."""
        began = time.perf_counter()
        new = files.read(self.spark, path.rsplit("/", 1)[0], "preview", [path])
        pages = extraction.extract(new.where("content IS NOT NULL"), self.extractor).select("hash", F.array_join("pages", "\n\n").alias("markdown"))
        row = new.join(pages, "hash", "left").select("hash", inline_html_as_markdown(F.coalesce("text", "markdown")).alias("text"), F.when(F.col("content").isNull(), "text").otherwise(self.signature).alias("route")).first()
        text = row["text"] if row else None
        reason = None if text else "empty" if row and row["route"] == "text" else "extract-failed"
        return {"text": text, "reason": reason, "route": row["route"] if row else None, "chars": len(text or ""), "seconds": time.perf_counter() - began}

    def collect_garbage(self) -> dict[str, int]:
        """Deletes the rows of libraries that are no longer registered and extractions that no file refers
        to. An empty registry deletes nothing: it is more likely lost than true."""
        names = {x.name for x in self._registry()}
        if not names:
            return {"parts": 0, "extractions": 0}
        per_library = ("file_meta", "file_text", "chunks", "vectors", "postings", "lengths", "totals", "index_states")
        now = self.tables.current()
        gone = {name: {part: None for part in now.get(name, {}) if part not in names} for name in per_library}
        live = self.tables.read("file_meta", META).where(F.col("lib").isin(*names)).select("hash").distinct()
        cached = self.tables.read("extractions", CACHE)
        orphaned = cached.join(live, "hash", "left_anti").count()
        changes = {name: parts for name, parts in gone.items() if parts}
        if orphaned:
            changes["extractions"] = {part: None for part in now.get("extractions", {})} | {"kept": materialise(cached.join(live, "hash", "left_semi"), "extractions-kept")}
        if changes:
            self.tables.commit(changes)
        self.tables.sweep_drafts()
        return {"parts": sum(map(len, gone.values())), "extractions": orphaned}

    def import_package(self, library: str, path: str) -> dict:
        """Takes the vectors of an export package (ids: rel::chunk) for a library's pieces. The number of rows
        and three samples must agree with what is written, else nothing is."""
        loaded = materialise(package.load(self.spark, path), "package")
        ids = F.concat_ws("::", "rel", "chunk")
        rows = self.tables.read("vectors", VECTORS, library).select("lib", "rel", "chunk", ids.alias("id"))
        taken = rows.join(loaded.select("id", F.col("embedding").cast("array<float>").alias("vec")), "id").select("lib", "rel", "chunk", "vec")
        taken = materialise(taken, "imported")
        expected, written = loaded.count(), taken.count()
        samples = package.same_vectors(loaded, taken.select(ids.alias("id"), F.col("vec").alias("embedding")))
        sound = expected == written and all(r["same"] for r in samples.collect())  # three rows
        if sound:
            others = self.tables.read("vectors", VECTORS, library).join(taken.select("rel", "chunk"), ["rel", "chunk"], "left_anti").select("lib", "rel", "chunk", "vec")
            self.tables.commit({"vectors": {library: others.unionByName(taken)}})
        return {"expected": expected, "written": written, "imported": sound}

    def export_library(self, library: str, path: str) -> dict:
        """Writes what can't be made anew without the files (metadata, texts, pieces, vectors) as a package. The
        number of rows of each table."""
        self._registry().get(library)
        self.spark.dataSource.register(bundle.Bundle)
        read, rows = self.tables.snapshot(), None
        for name, schema in EXPORTED.items():
            made = read(name, schema, library).select(F.lit(name).alias("table"), F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("json"))
            rows = made if rows is None else rows.unionByName(made)
        rows.repartitionByRange("table", "json").sortWithinPartitions("table", "json").write.format("corpusloom_bundle").mode("append").save(path)
        return self._packed(path)

    @staticmethod
    def _packed(path: str) -> dict:
        counts = dict.fromkeys(EXPORTED, 0)
        for part in bundle.manifest(path)["parts"]:
            for m in part["members"]:
                counts[m["name"].removeprefix("payload/").removesuffix(".jsonl.gz")] += m["rows"]
        return counts

    def import_library(self, library: str, path: str) -> dict:
        """Replaces a registered library by what a package holds, under its own name; the keyword index is made
        anew. Nothing is changed if a member is damaged or leaves the folder (bundle.Unsound, as the cause of
        Spark's error), if rows are missing, or if any of three samples' vectors isn't what was written."""
        self._registry().get(library)
        self.spark.dataSource.register(bundle.Bundle)
        held = materialise(self.spark.read.format("corpusloom_bundle").load(path), "package")
        expected, written = self._packed(path), {}
        taken = {}
        for name, schema in EXPORTED.items():
            parsed = held.where(F.col("table") == name).select(F.from_json("json", schema).alias("r")).select("r.*").withColumn("lib", F.lit(library))
            taken[name] = materialise(parsed, f"import-{name}")
            written[name] = taken[name].count()
        vectors = lambda d: d.select(F.concat_ws("::", "rel", "chunk").alias("id"), F.col("vec").alias("embedding"))
        packed = held.where("table = 'vectors'").select(F.from_json("json", EXPORTED["vectors"]).alias("r")).select("r.*")
        sound = expected == written and all(r["same"] for r in package.same_vectors(vectors(packed), vectors(taken["vectors"])).collect())  # three rows
        if sound:
            version = self.tables.current()
            index, words = hybrid.keyword_index(taken["chunks"], self._terms(version)), {("words", WHOLE): version.get("words", {}).get(WHOLE)}
            state = self.spark.createDataFrame([(library, ingest.META_VERSION, time.time())], STATES)
            made = taken | {"postings": bm25.stored(index.postings), "lengths": index.lengths, "totals": bm25.statistics(index.lengths).select("lib", "n", "avgdl"), "index_states": state}
            self.tables.commit({name: {library: rows} for name, rows in made.items()}, words)
        return {"expected": expected, "written": written, "imported": sound}

    def index_pages(self, library: str, render: Extractor, signature: str = "") -> dict:
        """The page index: an image text for each page of a PDF that is new, has changed, or failed under
        another signature; those that are gone go."""
        x = self._registry().get(library)
        listed = self.listing(x).where(suffix(F.col("rel")) == "pdf")
        old = self.tables.read("page_meta", PAGE_META, library)
        known = old.select("rel", F.col("size").alias("_size"), F.col("mtime_ns").alias("_time"), F.col("failed").alias("_failed"), F.col("signature").alias("_sig"))
        todo = F.col("_time").isNull() | ~(F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ns").eqNullSafe(F.col("_time"))) | (F.col("_failed") & ~F.col("_sig").eqNullSafe(F.lit(signature)))
        wanted = materialise(listed.join(known, "rel", "left").where(todo).select("lib", "rel", "path", "size", "mtime_ns"), "pages-todo")
        some = [r["path"] for r in wanted.select("path").limit(LISTED_FILES + 1).collect()]
        contents = files.read(self.spark, x.path, library, some if len(some) <= LISTED_FILES else None) if some else files.read(self.spark, x.path, library).limit(0)
        contents = contents.join(wanted.select("lib", "rel"), ["lib", "rel"], "left_semi").withColumn("hash", F.col("rel"))
        read = materialise(extraction.extract(contents, render).withColumnRenamed("hash", "rel"), "pages-read")
        vectors = read.where("pages IS NOT NULL").select(F.lit(library).alias("lib"), "rel", F.posexplode("pages").alias("page", "text"))
        vectors = vectors.select("lib", "rel", (F.col("page") + 1).alias("page"), embed(F.col("text"), self.embedder).alias("vec"))
        state = wanted.join(read, "rel", "left").select("lib", "rel", F.coalesce(F.size("pages"), F.lit(0)).alias("pages"), F.col("pages").isNull().alias("failed"), F.when(F.col("pages").isNull(), "render").alias("reason"), "size", "mtime_ns", F.lit(signature).alias("signature"))
        gone = old.join(listed.select("rel"), "rel", "left_anti").select("lib", "rel")
        touched = materialise(wanted.select("lib", "rel").unionByName(gone), "pages-touched")
        counts = {"rendered": read.where("pages IS NOT NULL").count(), "failed": read.where("pages IS NULL").count(), "removed": gone.count()}
        self.tables.commit({"page_meta": {library: ingest.publish(old, state, touched)}, "page_vectors": {library: ingest.publish(self.tables.read("page_vectors", PAGES, library), vectors, touched)}})
        return counts

    def index_status(self) -> DataFrame:
        meta = self.tables.read("file_meta", META)
        return ingest.consistent(meta, self.tables.read("chunks", CHUNKS)).join(diagnostics.library_rollup(meta).where("lib IS NOT NULL").select("lib", "files"), "lib", "left")

    def index_failures(self, library: str | None = None) -> DataFrame:
        return diagnostics.failure_rows(self.tables.read("file_meta", META, library), self.signature)

    def failure_overview(self) -> DataFrame:
        """(lib, healthy, failed) of all libraries."""
        return diagnostics.healthy_counts(self.tables.read("file_meta", META))

    def duplicate_report(self, library: str, threshold: float = neardup.THRESHOLD) -> str:
        return neardup.report(self.tables.read("file_text", TEXT, library), "rel", "text", threshold)

    # Questions

    def search_knowledge(self, query: str, top_k: int = 5, libraries=(), exclude=(), folder: str = "", include_body: bool = True, refresh: bool = False) -> DataFrame:
        """refresh: first look whether files have changed, see ensure_fresh()."""
        scoped = tuple(self._registry().scope(libraries, exclude))
        for name in scoped if refresh else ():
            self.ensure_fresh(name)
        corpus = self._corpus()
        options = hybrid.Options(top_k=top_k, folder=folder, libraries=scoped, with_body=include_body)
        return hybrid.search(corpus, query, options, self.embedder, self.reranker)

    def _corpus(self) -> hybrid.Corpus:
        """All libraries, in one version."""
        version = self.tables.current()
        read = self.tables.snapshot(version)
        index = bm25.Index(read("postings", POSTINGS), read("lengths", LENGTHS), read("totals", TOTALS))
        return hybrid.Corpus(read("chunks", CHUNKS), read("vectors", VECTORS), index, self._terms(version))

    def navigate_knowledge(self, query: str, top_k: int = 5, libraries=(), exclude=()) -> DataFrame:
        """The best pages of page images."""
        scoped = self._registry().scope(libraries, exclude)
        pages = self.tables.read("page_vectors", PAGES).where(F.col("lib").isin(*scoped)).withColumn("place", F.struct("rel", "page"))
        q = self.spark.createDataFrame([(self.embedder.encode([query])[0].astype(float).tolist(),)], "q array<double>")
        return retrieval.nearest_per_library(pages, "lib", "place", "vec", q, top_k).select("lib", "place.rel", "place.page", "score")

    def note_relations(self, path: str, library: str) -> DataFrame:
        """(rel, outlinks, inlinks) of a note, given by its path or stem."""
        notes = self.tables.read("file_meta", META).where(F.col("lib") == library)
        rows = graph.relations(notes.select("lib", "rel", F.col("rel").alias("pos"), F.coalesce("links", F.array().cast("array<string>")).alias("links")))
        return rows.where((F.col("rel") == path) | (stem(F.col("rel")) == path)).orderBy(F.col("rel") != path, F.desc("rel")).limit(1).select("rel", "outlinks", "inlinks")

    def read_document(self, library: str, path: str) -> DataFrame:
        """(rel, text): by path, else by stem whatever its case; the first one."""
        texts = self.tables.read("file_text", TEXT).where(F.col("lib") == library)
        hit = (F.col("rel") == path) | (F.lower(stem(F.col("rel"))) == path.rsplit("/", 1)[-1].lower().removesuffix(".md"))
        return texts.where(hit).orderBy(F.col("rel") != path, "rel").limit(1).select("rel", "text")

    def find_duplicates(self, library: str, threshold: float = neardup.THRESHOLD) -> DataFrame:
        """(rel, cluster) of near-duplicates in a library."""
        if not 0 < threshold <= 1:
            raise ValueError("threshold is above 0 and at most 1")
        return neardup.clusters(self.tables.read("file_text", TEXT).where(F.col("lib") == library), "rel", "text", threshold).withColumnRenamed("key", "rel")

    def page_status(self) -> DataFrame:
        return diagnostics.page_status(self.tables.read("page_meta", PAGE_META))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of all libraries; PDFs that are in the folders and not indexed are nodes too."""
        meta = self.tables.read("file_meta", META)
        pages = self.tables.read("page_meta", PAGE_META)
        on_disk = self.spark.createDataFrame([], "lib string, rel string")
        for x in self._registry():  # a listing for each registered folder, without contents
            on_disk = on_disk.unionByName(self.listing(x).where(suffix(F.col("rel")) == "pdf").select("lib", "rel"))
        nodes = graph.file_nodes(meta.withColumn("updated", F.col("mtime_ns")), on_disk, pages, self.signature)
        links = graph.link_edges(self._links(meta))
        edges = links.select(F.concat_ws("|", "lib", "a").alias("a"), F.concat_ws("|", "lib", "b").alias("b"), F.lit("link").alias("kind"))
        edges = edges.unionByName(graph.page_nodes(pages).select(F.col("parent").alias("a"), F.col("id").alias("b"), F.lit("page").alias("kind")))
        return graph.mark_hubs(nodes, edges), edges

    def graph_counts(self) -> DataFrame:
        """(lib, nodes, edges) of the links between files."""
        meta = self.tables.read("file_meta", META)
        return graph.counts(meta.select("lib"), graph.link_edges(self._links(meta)))

    @staticmethod
    def _links(meta: DataFrame) -> DataFrame:
        return meta.select("lib", "rel", F.col("rel").alias("pos"), F.coalesce("links", F.array().cast("array<string>")).alias("links"))
