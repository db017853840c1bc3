"""BM25 over a written index of posting blocks.

Documents are dealt into parts of about `per_part` documents of similar length. A block holds one
term's postings in one part, so the most that a document of a part can score is the sum, over a query's
terms, of the largest contribution in that term's block; a very common term has a block in
every part and none of them is large. Blocks are dealt by term and part, and each file is sorted by term, which
lets a search skip row groups; their heads (count, largest contribution) are columns of their own, so
bounds are computed without reading a posting.

A search joins the queries' terms with the heads, scores each query's most promising parts first, and takes the k-th best
score found there as the query's floor; parts whose bound is under the floor are passed over, and the blocks
of the others alone are read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import spread, write_text

#: As many distinct terms are looked up in a literal set while documents are read; more are joined.
LITERAL_TERMS = 1 << 14


@dataclass(frozen=True)
class Index:
    """blocks: term, part, n, peak, postings (array of doc_id, share); share: what a repeat of the term adds per unit of idf."""

    blocks: DataFrame
    n_docs: int

    @property
    def heads(self) -> DataFrame:
        return self.blocks.select("term", "part", "n", "peak")

    @property
    def document_frequency(self) -> DataFrame:
        return self.blocks.select("term", "n").groupBy("term").agg(F.sum("n").alias("df"))


@dataclass(frozen=True)
class Tokens:
    """A corpus, tokenised and written once.

    words: doc_id, dl (all tokens), size (a class of lengths) and tokens; terms: what tokens still have to be joined with, if
    anything; classes: documents by class of lengths.
    """

    words: DataFrame
    terms: DataFrame | None
    n_docs: int
    average: float
    classes: dict[int, int]

    def postings(self, *extra: str) -> DataFrame:
        """(term, doc_id, dl, tf) and the extra columns of words."""
        each = self.words.select("doc_id", "dl", *extra, F.explode("tokens").alias("term"))
        if self.terms is not None:
            each = each.join(self.terms.select("term").distinct(), "term", "left_semi")
        return each.groupBy("term", *extra, "doc_id", "dl").agg(F.count("*").alias("tf"))

    @property
    def document_frequency(self) -> DataFrame:
        """(term, df): a document counts a term once, before anything is shuffled."""
        each = self.words.select(F.explode(F.array_distinct("tokens")).alias("term"))
        if self.terms is not None:
            each = each.join(self.terms.select("term").distinct(), "term", "left_semi")
        return each.groupBy("term").agg(F.count("*").alias("df"))

    def share(self, k1: float, b: float) -> Column:
        """What a posting adds per unit of idf."""
        return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(self.average)))


def write_tokens(corpus: DataFrame, path: str, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Tokens:
    """Tokenise a corpus once, for the given terms only, if any are, and write the tokens under path."""
    spark = corpus.sparkSession
    words = spread(corpus.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"), X.tokenize(F.coalesce(text_col, F.lit(""))).alias("tokens")).withColumn("dl", F.size("tokens"))
    if terms is not None:
        few = [r[0] for r in terms.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
        if len(few) <= LITERAL_TERMS:
            words, terms = words.withColumn("tokens", F.expr(f"filter(tokens, t -> t IN ({X.quoted(few)}))") if few else F.array().cast("array<string>")), None
    words.withColumn("size", F.floor(F.log2(F.col("dl") + 1)).cast("int")).write.parquet(path)
    words = spark.read.parquet(path)
    # lengths fall into a few dozen classes, however many documents there are
    classes = words.groupBy("size").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).collect()
    n_docs, total = sum(r["n"] for r in classes), sum(r["total"] for r in classes)
    return Tokens(words, terms, n_docs, total / n_docs if total else 1.0, {r["size"]: r["n"] for r in classes})


def write_index(corpus: DataFrame, path: str, terms: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text", per_part: int = 128) -> Index:
    """Write the index (of the given terms only, if any are) under path; texts are tokenised once."""
    spark, known = corpus.sparkSession, write_tokens(corpus, f"{path}/tokens", terms, id_col, text_col)
    many = F.create_map(*(F.lit(x) for size, n in known.classes.items() for x in (size, -(-n // per_part)))) if known.classes else F.lit(None).cast("map<int,int>")
    part = F.col("size").cast("long") * (1 << 40) + F.pmod(F.xxhash64("doc_id"), many[F.col("size")])
    parted = replace(known, words=known.words.withColumn("part", part))
    posts = parted.postings("part").withColumn("share", known.share(k1, b))
    blocks = posts.groupBy("term", "part").agg(F.count("*").alias("n"), F.max("share").alias("peak"), F.collect_list(F.struct("doc_id", "share")).alias("postings"))
    # the aggregation has dealt them by term and part, so sorting shuffles nothing
    blocks.sortWithinPartitions("term", "part").write.parquet(f"{path}/blocks")
    write_text(spark, f"{path}/about", json.dumps({"n_docs": known.n_docs, "k1": k1, "b": b, "average": known.average}))
    return Index(spark.read.schema(blocks.schema).parquet(f"{path}/blocks"), known.n_docs)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index written before."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return Index(spark.read.parquet(f"{path}/blocks"), about["n_docs"])


def ask(queries: DataFrame, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, term, qtf) of the queries' terms."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(X.tokenize(F.coalesce(query_text, F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def weigh(asked: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, term, weight): repeats times idf, for terms that some document holds."""
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"))


def part_bounds(index: Index, weighted: DataFrame) -> DataFrame:
    """(query_id, part, bound): the most that a document of the part can score."""
    return weighted.join(index.heads, "term").groupBy("query_id", "part").agg(F.sum(F.col("weight") * F.col("peak")).alias("bound"))


def score_parts(index: Index, weighted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of all documents of the given (query_id, part) that hold a term of the query."""
    wanted = pairs.select("query_id", "part").join(weighted, "query_id")
    hit = wanted.join(index.blocks.select("term", "part", "postings"), ["term", "part"]).select("query_id", "weight", F.explode("postings").alias("p"))
    return hit.groupBy("query_id", F.col("p.doc_id").alias("doc_id")).agg(F.sum(F.col("weight") * F.col("p.share")).alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The first k of each query, with their rank; ties go by document."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")  # sums differ in their last bits
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def plan_search(index: Index, asked: DataFrame, k: int, first: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weighted terms, pairs scored first, other pairs whose bound reaches the floor)."""
    weighted = weigh(asked, index.document_frequency, index.n_docs)
    bounds = part_bounds(index, weighted)
    w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "part")
    early = bounds.withColumn("place", F.row_number().over(w)).where(F.col("place") <= first).select("query_id", "part")
    floor = best(score_parts(index, weighted, early), k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("found")).where(F.col("found") == k).drop("found")
    late = bounds.join(floor, "query_id", "left").where("floor is null or bound >= floor - 1e-6").join(early, ["query_id", "part"], "left_anti")
    return weighted, early, late.select("query_id", "part")


def search(index: Index, asked: DataFrame, k: int = 3, first: int = 4) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents of each query."""
    weighted, early, late = plan_search(index, asked, k, first)
    scored = score_parts(index, weighted, early).unionByName(score_parts(index, weighted, late))
    return best(scored, k).select("query_id", "rank", "doc_id", "score")


def search_once(known: Tokens, asked: DataFrame, k: int = 3, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """search without an index: all postings of the asked terms are scored, which is less work where a corpus is searched once."""
    weighted = weigh(asked, known.document_frequency, known.n_docs)
    scored = known.postings().withColumn("share", known.share(k1, b)).join(weighted, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("share")).alias("score"))
    return best(scored, k).select("query_id", "rank", "doc_id", "score")
