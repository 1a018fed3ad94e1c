"""How distinctive a term is for a record: divergence from randomness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators.joins import join_key_stats
from skeinwork.session import stage


def divergence_scores(tf: DataFrame, document: str, term: str, frequency: str, c: float = 1.0) -> DataFrame:
    """``tf`` with a ``score`` per row: information content under a geometric model, times Laplace's after-effect gain.

    ``tf`` has one row per document and term. With F the frequency of the term in the collection, N the number of documents
    and lambda = F / N, a frequency t is worth  -log2(1 / (1 + lambda)) - t * log2(lambda / (1 + lambda))  bits, times
    1 / (t + 1). t is the frequency normalised to the mean length: frequency * log2(1 + c * mean / length). Added columns:
    ``n_docs`` (documents with the term), ``term_total`` (F), ``doc_length``, ``score``.

    Frequencies are combined on the map side; statistics of terms and documents return to the rows by joins that are
    balanced for hot terms and hot documents.

    Defined results: rows with a null document, term or frequency, or a frequency of 0 or less, are left out; repeated rows
    count each; an empty table gives no rows; a table of one document gives finite scores; further columns are kept, but one
    with the name of an added column gives way to it.
    """
    added = {"n_docs", "term_total", "doc_length", "score", "__terms"}
    if clash := added & {document, term, frequency}:
        raise ValueError(f"document, term and frequency can't be named {sorted(clash)}")
    rows = tf.drop(*added).where(F.col(document).isNotNull() & F.col(term).isNotNull() & (F.col(frequency) > 0))
    terms = stage(rows.groupBy(term).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(frequency).alias("term_total")), "terms")
    docs = stage(rows.groupBy(document).agg(F.count(F.lit(1)).alias("__terms"), F.sum(frequency).alias("doc_length")), "documents")
    n, length, total = docs.agg(F.count(F.lit(1)), F.sum("doc_length"), F.sum("__terms")).first()
    rows = join_key_stats(rows, terms, [term], "n_docs", total or 0)
    rows = join_key_stats(rows, docs, [document], "__terms", total or 0).drop("__terms")
    mean = float(length or 0) / max(n, 1)
    t = F.col(frequency) * F.log2(1 + F.lit(c * mean) / F.col("doc_length"))
    lam = F.col("term_total") / F.lit(float(max(n, 1)))
    bits = F.log2(1 + lam) + t * F.log2((1 + lam) / lam)
    return rows.withColumn("score", bits / (t + 1))


def placed_terms(scores: DataFrame, document: str, term: str) -> DataFrame:
    """All rows with their ``place`` within the document, from 1, by falling score (ties: by term)."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(document).orderBy(F.col("score").desc(), F.col(term))))


def leading_terms(scores: DataFrame, document: str, term: str, k: int) -> DataFrame:
    """The ``k`` rows of each document with the highest score (ties: by term), and their ``place`` from 1.

    The limit is pushed below the shuffle (window group limit), so no task gets all terms of a large document.
    """
    return placed_terms(scores, document, term).where(F.col("place") <= k)
