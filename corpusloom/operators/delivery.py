"""What is delivered of the candidates: sections once, few pieces of a file, whole sections around hits.

A candidate is dropped for low confidence first, then folded into its section, then capped by file, and
only then counted; as windows over the candidates' order that is the same as walking through them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem, suffix, title_key, truncate_at_line

STRONG, WARN, DROP = 0.75, 0.30, 0.0
FILE_CAP = 3
SECTION_LEAST = 300
RETURN_LIMIT = 2000
#: Fixed value: what ends a text that was cut.
MARK = "… [本块已截断，完整内容见源文件]"
#: Words that make a query a question, and the longest keyword query.
QUESTION_WORDS = ("怎么", "如何", "为什么", "哪些", "什么", "是否", "能不能")
KEYWORD_LENGTH = 12


#: What each rule of advice() tells the one who searched.
ADVICE = {
    "all_weak": "All hits are weak: the libraries may have no direct answer. Search with words that the notes use, or list candidates first.",
    "single_strong": "Only one hit is strong: rely on this one, and read its whole document for more.",
    "medium_only": "The best hit is related but no direct answer: read it in its document, or ask more precisely.",
    "same_title": "Notes of the same title lie in different places: they are different notes, so name them by their paths.",
    "foreign_library": "Some hits are from libraries beside the default ones: name the libraries to search if these aren't wanted.",
    "many_strong": "Several strong hits: a larger top_k gives more of this subject.",
    "one_file": "Most hits are from one file: leave it out or raise top_k to compare others.",
    "office_files": "There are PDF or Word files among the hits: their text can be read, their figures are on the pages.",
    "backfilled": "Whole sections are delivered, each once: read the document for the rest.",
    "list_mode": "This is a list of candidates without texts: read one to three of them.",
    "few_hits": "There are few hits: try other words, or more libraries.",
    "keyword_query": "The query is a list of words: a whole question finds more by meaning.",
}


def advice_text(names: Column) -> Column:
    """The sentences of the rules that advice() names."""
    known = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return F.transform(names, lambda name: F.element_at(known, name))


def whole_sections(chunks: DataFrame, least: int = SECTION_LEAST) -> DataFrame:
    """(lib, rel, hp, parent): the text of each section that was cut in several pieces and is longer than
    least. chunks: lib, rel, hp, chunk, body."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "body")))
    bodies = F.filter(F.transform(ordered, lambda x: x["body"]), lambda b: b.isNotNull() & (b != ""))
    made = chunks.where("hp IS NOT NULL AND hp <> ''").groupBy("lib", "rel", "hp").agg(F.count("*").alias("_n"), F.array_join(bodies, "\n\n").alias("parent"))
    return made.where((F.col("_n") > 1) & (F.length("parent") > least)).drop("_n")


def tier(confidence: Column, warn: float = WARN, strong: float = STRONG) -> Column:
    return F.when(confidence >= strong, F.lit("strong")).when(confidence >= warn, F.lit("medium")).when(confidence.isNotNull(), F.lit("weak"))


def piece_position(chunks: DataFrame) -> DataFrame:
    """(lib, rel, total): pieces of each file."""
    return chunks.groupBy("lib", "rel").agg(F.count("*").alias("total"))


def deliver(candidates: DataFrame, sections: DataFrame, limit: int, cap: int = FILE_CAP, drop: float = DROP) -> DataFrame:
    """candidates: lib, rel, chunk, hp, body, score (null: none), pos (their order). Returns those that
    are delivered, with delivered (1..limit), backfilled, and the text, whole section or piece.

    Candidates are a window of a few times the limit, so the windows here are small.
    """
    joined = candidates.where(F.col("score").isNull() | (F.col("score") >= drop)).join(sections, ["lib", "rel", "hp"], "left")
    in_section = F.row_number().over(Window.partitionBy("lib", "rel", "hp").orderBy("pos"))
    once = joined.withColumn("_fold", in_section).where(F.col("parent").isNull() | (F.col("_fold") == 1))
    in_file = F.row_number().over(Window.partitionBy("lib", "rel").orderBy("pos"))
    few = once.withColumn("_file", in_file).where(F.col("_file") <= cap)
    top = few.orderBy("pos").limit(limit)
    text = truncate_at_line(F.coalesce("parent", "body"), RETURN_LIMIT, MARK)
    return top.select("lib", "rel", "chunk", "hp", "score", "pos", F.row_number().over(Window.orderBy("pos")).alias("delivered"), F.col("parent").isNotNull().alias("backfilled"), text.alias("text"))


def advice(hits: DataFrame, query: str = "", mode: str = "body", top_k: int | None = None, folded: int = 0, defaults: tuple[str, ...] = (), warn: float = WARN, strong: float = STRONG, most: int = 2) -> DataFrame:
    """One row: advice, the names of up to ``most`` rules that apply, in order of priority.

    hits: lib, rel, title, score, backfilled, delivered: what one search delivered.
    """
    h = hits.withColumn("_key", F.when(title_key(F.col("title")) != "", title_key(F.col("title"))).otherwise(title_key(stem(F.col("rel")))))
    whole = h.agg(
        F.count("*").alias("n"), F.max("score").alias("top"), F.count_if(F.col("score") >= strong).alias("strong"),
        F.count_if(~F.col("lib").isin(*defaults) if defaults else F.lit(False)).alias("foreign"),
        F.count_if(suffix(F.col("rel")).isin("pdf", "docx")).alias("office"), F.count_if(F.col("backfilled")).alias("filled"),
    )
    same = h.groupBy("_key").agg(F.count_distinct("lib", "rel").alias("places")).agg(F.coalesce(F.max("places"), F.lit(0)).alias("places"))
    most_of = h.groupBy("lib", "rel").agg(F.count("*").alias("m")).agg(F.coalesce(F.max("m"), F.lit(0)).alias("m"))
    w = whole.crossJoin(same).crossJoin(most_of)  # one row each
    n, top, n_strong = F.col("n"), F.col("top"), F.col("strong")
    q = query.strip()
    keywordish = bool(q) and not any(c in q for c in "?？") and len(q) <= KEYWORD_LENGTH and not any(x in q for x in QUESTION_WORDS)
    full = (top >= 0.90) & (n >= top_k) if top_k else F.lit(False)
    rule = lambda name, when: F.when(when, F.lit(name))
    first = F.when(top < warn, F.lit("all_weak")).when((n_strong == 1) & (n > 1), F.lit("single_strong")).when((top < strong) & (n_strong == 0), F.lit("medium_only"))
    rules = [
        first, rule("same_title", F.col("places") > 1), rule("foreign_library", F.col("foreign") > 0),
        rule("many_strong", top.isNotNull() & ((n_strong >= 3) | ((n_strong >= 1) & full))),
        rule("one_file", (n >= 3) & (F.col("m") >= F.greatest(F.lit(2), F.bround(n * F.lit(0.6)).cast("long")))),
        rule("office_files", F.col("office") > 0), rule("backfilled", F.lit(folded > 0) | (F.col("filled") > 0)), rule("list_mode", F.lit(mode == "list")),
        rule("few_hits", (n <= 2) & (top.isNull() | (top >= warn))), rule("keyword_query", F.lit(keywordish)),
    ]
    return w.select(F.when(n > 0, F.slice(F.array_compact(F.array(*rules)), 1, most)).otherwise(F.array().cast("array<string>")).alias("advice"))
