"""Enrichment: metrics -> quartile labels (-> text, embeddings, neighbours).

The order matters as in the reference: summaries read quartile fields and
the neighbour lists read embeddings. Metrics are narrow projections plus two
partially aggregated joins; quartiles are one global aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.metrics import add_metrics, add_quartiles
from ..session import release


def enrich_metrics(issues: DataFrame, comments: DataFrame, reactions: DataFrame | None = None,
                   quantile_method: str = "exact", materialize: bool = False) -> DataFrame:
    """Metrics and quartile labels. ``materialize`` stores the metrics table
    (in ``spark.checkpoint.dir``) so the quantile passes and the labelling read it
    once instead of re-running the joins."""
    from ..operators.embed import _written

    m = add_metrics(issues, comments, reactions)
    if materialize:
        m = _written(m, "metrics")
    out = add_quartiles(m, method=quantile_method)
    if "summary" not in out.columns:
        out = out.withColumn("summary", F.lit(None).cast("string"))
    return out


def orders_corpus(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "issues": fx.orders_issues(spark, sf_dir),
        "comments": fx.orders_comments(spark, sf_dir),
        "reactions": fx.event_reactions(spark, sf_dir),
        "xrefs": fx.orders_xrefs(spark, sf_dir),
        "recs": fx.label_recs(spark, sf_dir),
    }


def orders_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = orders_corpus(spark, sf_dir)
    return add_metrics(c["issues"], c["comments"], c["reactions"])


def orders_enriched(spark: SparkSession, sf_dir: str, quantile_method: str = "exact",
                    reuse: bool = True) -> DataFrame:
    """Metrics + quartiles of the order issues. With ``reuse`` the table is
    written once per session (``plans.materialize``) and read by later queries,
    as tools read the stored enriched collection."""
    def build() -> DataFrame:
        c = orders_corpus(spark, sf_dir)
        # the metrics table is stored before the global quantile step, so
        # the quantile passes and the labelling read it instead of re-joining
        return enrich_metrics(c["issues"], c["comments"], c["reactions"], quantile_method=quantile_method,
                              materialize=True)

    if not reuse:
        return build()
    from .materialize import stored
    return stored(spark, f"orders-enriched-{quantile_method}-{sf_dir}", build)


def orders_with_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched orders whose first numbers carry the ``embeddings`` rows with the
    same id (``vec_id = number``); the rest have no embedding."""
    emb = fx.vectors(spark, sf_dir).select("number", "embedding")
    return orders_enriched(spark, sf_dir).join(emb, "number", "left")


def orders_documents(spark: SparkSession, sf_dir: str, reuse: bool = True, lines: DataFrame | None = None) -> DataFrame:
    """Nested order-issues (J1) whose ``number_of_comments`` is the count the
    source claimed: distinct line numbers. Orders with repeated line numbers
    therefore carry a comment-count mismatch, like pages that overlapped.
    With ``reuse`` the document collection is stored once per session. ``lines``
    are the lines placed in their orders (``fixtures.stored_lines``)."""
    from ..operators.assemble import assemble_issues

    def build(lines: DataFrame | None) -> DataFrame:
        claim = (fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("number"))
                 .agg(F.count_distinct("l_linenumber").cast("bigint").alias("_claim")))
        docs = assemble_issues(fx.orders_issues(spark, sf_dir), fx.orders_comments(spark, sf_dir, lines),
                               fx.orders_xrefs(spark, sf_dir, lines)).join(claim, "number", "left")
        return docs.withColumn("number_of_comments",
                               F.coalesce(F.col("_claim"), F.lit(0).cast("bigint"))).drop("_claim")

    if not reuse:
        return build(lines)
    from .materialize import from_lines, stored_path
    return spark.read.parquet(from_lines(spark, sf_dir, lambda lines: stored_path(
        spark, f"orders-documents-{sf_dir}", lambda: build(lines()))))


def enrich(issues: DataFrame, comments: DataFrame, reactions: DataFrame | None = None,
           embed_cache: DataFrame | None = None, embedder=None, completer=None, k: int = 4,
           quantile_method: str = "exact", materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """The whole enrichment (reference ``enrich`` command): conversation text,
    embedding (cached), metrics, quartile labels, summaries (after quartiles),
    k-NN lists. Returns ``(enriched issues, new embedding-cache rows)``.

    ``materialize`` stores the texts and metrics once, compressed, in the shared
    checkpoint folder, the conversations first, then the texts to embed, so the files
    of one shuffle are gone before the next. Later steps read the columns they need
    from there and make narrow tables by row; the texts are joined to them once, in
    the result."""
    from ..operators.conversation import conversation, embedding_text
    from ..operators.embed import TEXT_LEVEL, _written, _written_texts, embed_issues, summarize
    from ..operators.knn import knn_neighbors

    if not materialize:
        df = embedding_text(conversation(issues, comments, reactions), comments)
        df = df.drop("summary") if "summary" in df.columns else df
        df, new_cache = embed_issues(df, "embed_text", cache=embed_cache, embedder=embedder)
        df = enrich_metrics(df, comments, reactions, quantile_method=quantile_method)
        df, _new_summaries = summarize(df, completer=completer)
        return knn_neighbors(df, k, "cosine"), new_cache

    spark = issues.sparkSession
    df = conversation(issues, comments, reactions)
    df = df.drop("summary") if "summary" in df.columns else df
    row = "_row"
    while row in df.columns:
        row += "_"
    df = add_metrics(df, comments, reactions).withColumn(row, F.monotonically_increasing_id())
    df = _written_texts(df, "enriched", ["body", "conversation"])
    release(spark)
    texts = embedding_text(df.select(row, "repo", "number", "title", "body"), comments)
    texts = _written(texts.select(row, "number", "title", "embed_text"), "texts", TEXT_LEVEL)
    release(spark)
    df = add_quartiles(df, method=quantile_method)
    vectors, new_cache = embed_issues(texts, "embed_text", cache=embed_cache, embedder=embedder, row=row)
    vectors = _written(vectors.drop("embed_text"), "vectors")
    release(spark)
    near = knn_neighbors(vectors, k, "cosine")
    release(spark)
    near = near.select(row, *[c for c in near.columns if c not in vectors.columns])
    made = vectors.select(row, "embedding").join(near, row).join(texts.select(row, "embed_text"), row)
    if completer is None:
        df, _new_summaries = summarize(df)
    else:
        summaries, _new_summaries = summarize(df, completer=completer)
        made = made.join(summaries.select(row, "summary"), row)
    columns = [c for c in df.columns if c != row]
    at = columns.index("conversation") + 1
    out = df.join(made, row)
    return out.select(*columns[:at], "embed_text", *columns[at:], *[c for c in made.columns if c not in (row, "embed_text")]), new_cache
