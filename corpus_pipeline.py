"""From raw documents to training tokens: the stages, each written and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all documents that the one before kept and
returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merrow.llm.bpe import bpe_encode
from merrow.llm.decontaminate import find_benchmark_passages
from merrow.llm.language import UNKNOWN, identify, learn
from merrow.llm.line_dedup import dedup_lines
from merrow.llm.near_copies import link_near_copies
from merrow.llm.queries import bpe_digests, tokenizer_path
from merrow.llm.shared import discard, small, table, written


#: Columns that the stages read or count anew. All others are set apart under names of their own
#: while an operator works, so that none of its results takes their place.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its other columns renamed, and their names by the new ones."""
    names = {c: f"__other_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    return docs.withColumnsRenamed(names), {new: c for c, new in names.items()}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those whose text is null, empty or without a letter go, as do ones of
    a language that can't be told. Where no row has a language to learn from, all with a letter stay.
    Repeated rows and rows without an id each stay, a text of any length is read whole, an empty
    table stays empty; no column of the input is lost or changed, whatever its name."""
    model = learn(docs)
    if not model.knows:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows, names = _apart(docs)
    return identify(rows, model).where(F.col("lang_pred") != UNKNOWN).select(rows.columns).withColumnsRenamed(names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that others, or they themselves, have before; one of which
    nothing is left goes. A null or empty text stays as it is. n_chars is counted anew. Of several
    documents that have a passage, that of the smallest id keeps it; rows of equal id and text are
    one document, and each stays. Texts of any length are read whole, and other columns stay,
    whatever their names. An empty table stays empty."""
    rows, names = _apart(docs)
    left = dedup_lines(rows, passages=True).where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in rows.columns]).withColumnsRenamed(names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (shingles of five words,
    a similarity of 0.8); documents without an id stay, as do null and empty texts. Rows of equal id
    stay or go together. Texts of any length are compared whole, other columns stay, whatever their
    names, and an empty table stays empty."""
    linked = link_near_copies(docs.select("doc_id", "text"))
    copies = written(linked.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "copies")
    return docs.join(small(copies), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no passages of the benchmark contaminate. Null and empty texts stay, and so
    does everything if the benchmark is empty. Texts of any length are scanned whole, repeated rows
    each stay or go, and other columns stay, whatever their names."""
    rows, names = _apart(docs)
    found = find_benchmark_passages(rows, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(rows.columns).withColumnsRenamed(names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document and the text that they decode to, as counts and digests; a
    null text counts as an empty one. One row for each row, whatever its text's length, id and
    further columns; none for an empty table."""
    return bpe_digests(bpe_encode(docs, tokenizer_path(), decoded_col="decoded", keep=["doc_id"]))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The language stage is a trained model, which SQL can't express; tests hold the rows against a
#: brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``. A stage's table goes once the next one's is written;
    ``merrow.scratch.clear`` removes what is left when the result is saved."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
